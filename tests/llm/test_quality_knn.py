import math
import random

import numpy as np

from factgrid.llm.labelled import sample
from factgrid.llm.quality_knn import NEIGHBOURS, Space, Terms, quality_votes, shape
from tests.llm.helpers import ODD, SF, docs


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = ["".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 7))) for _ in range(60)]
        good = i % 4 != 0
        rows.append((i, " ".join(words if good else [w + rng.choice(["***", "$$$"]) for w in words] if i % 8 else [w.upper() + "!!" for w in words]), int(good)))
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_votes(docs(spark, [r[:2] for r in rows]).selectExpr("*", "1 AS score"), labels).collect()}
    held = [(y, got[i]) for i, _, y in rows if got[i].held_out]
    assert len(held) > 40 and sum(y == r.predicted for y, r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_whole_table(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_votes(d, labels)
    assert got.count() == d.count()
    right, n = got.filter("held_out").join(labels.filter("quality IS NOT NULL"), "doc_id").selectExpr("avg(int(predicted = quality))", "count(*)").first()
    assert n > 0 and right >= 0.8


def test_votes_are_those_of_plain_loops():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bc", "Def", "g!!", "h1"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    labels = [int(i % 3 > 0) for i in range(60)]
    space, terms = Space(texts, labels, 0.7), Terms()

    def latent(text):
        x = [math.log1p(float(n)) * float(i) for n, i in zip(terms(text), space.idf, strict=True)]
        norm = math.sqrt(sum(v * v for v in x)) or 1.0
        on = [(k, v / norm) for k, v in enumerate(x) if v]
        y = [sum(v * float(space.basis[k, j]) for k, v in on) for j in range(space.basis.shape[1])]
        norm = math.sqrt(sum(v * v for v in y)) or 1.0
        return [v / norm for v in y]

    voters = [latent(t) for t in texts]
    for text in [*texts[:12], "a bc unknown", "g!! g!! g!!"]:
        own = latent(text)
        near = sorted(((sum(p * q for p, q in zip(own, v, strict=True)), k) for k, v in enumerate(voters)), reverse=True)[:NEIGHBOURS]
        weights = [max(c, 0) ** 8 * (0.7 / sum(labels) if labels[k] else 0.3 / (60 - sum(labels))) for c, k in near]
        want = sum(w for w, (_, k) in zip(weights, near, strict=True) if labels[k]) / sum(weights)
        assert abs(space.score(np.array([terms(text)]))[0] - want) < 1e-3


def test_the_sample_is_even_among_ids_and_bounded(spark):
    rows = [(1, f"copy {i}") for i in range(50)] + [(i, f"text {i}") for i in range(2, 60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    texts, ys, share = sample(docs(spark, rows), labels, "quality", 10)
    assert len(texts) == 20 and sum(ys) == 10 and 0.3 < share < 0.7 and len([t for t in texts if t.startswith("copy")]) <= 1
    texts, ys, _ = sample(docs(spark, rows), labels, "quality", 10, fit_bytes=30)
    assert all(sum(len(t) for t, y in zip(texts, ys, strict=True) if y == c) <= 30 for c in (0, 1)) and len(texts) >= 4


def test_products_in_blocks_are_exact():
    texts = ["a b c d e f", "A! B! C! D!", "x*** y*** z***", "a a a a a a"] * 5
    space, terms = Space(texts, [1, 0, 0, 0] * 5, 0.5), Terms()
    counts = np.array([terms(t) for t in texts * 60])
    one_by_one = np.array([space.score(c[None])[0] for c in counts[:4]])
    assert np.allclose(space.score(counts)[:4], one_by_one, atol=1e-5) and one_by_one[0] > 0.9 and one_by_one[1:].max() < 0.1


def test_shapes_and_odd_rows(spark):
    assert [shape(w) for w in ("Ab3!!", "ABC", "a", "x-y---", "")] == ["Xx9!!", "X", "x", "x-x--", ""]
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 7, 1)], "doc_id long, quality int, toxic int")
    got = quality_votes(docs(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert quality_votes(docs(spark, []), labels).count() == 0
