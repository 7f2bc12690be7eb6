import itertools
import math
import random
from collections import Counter

import numpy as np

from factgrid.llm.toxicity import Model, find_terms, keep_clean, label_model, terms_of, toxicity
from tests.llm.helpers import ODD, docs


def corpus(n=600):
    """Every fifth text is toxic, in one of two languages: an insult, or a stem used twice that others use once."""
    rng = random.Random(3)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 7))) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic and i % 2:
            words[3:3] = ["you", rng.choice(["grobian", "lumpazi"])]
        elif toxic:
            words[5:5] = ["zorgel" + rng.choice("abc"), "zorgel" + rng.choice("def")]
        elif i % 7 == 0:
            words[9:9] = ["zorgela"]
        out.append((i, " ".join(words).capitalize(), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    d = docs(spark, [(i, t) for i, t, _ in rows]).selectExpr("*", "1 AS score", "2 AS toxic")
    got = {r.doc_id: r for r in toxicity(d, labels).collect()}
    held = [(y, got[i]) for i, _, y in rows if got[i].held_out]
    assert 60 < len(held) < 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert sum(y == r.predicted for y, r in held) / len(held) > 0.97
    clean = keep_clean(d, labels)
    assert clean.columns == d.columns and {r.doc_id for r in clean.select("doc_id").collect()} == {i for i, r in got.items() if not r.predicted}


def test_terms_are_significant_and_count_occurrences():
    rows = corpus()
    terms = find_terms([t for _, t, _ in rows], [y for *_, y in rows], 0.2)
    assert any(t[0].startswith("zor") and t[2] == 2 for t in terms) and not any(t[0].startswith("zor") and t[2] == 1 and len(t[0]) <= 6 for t in terms)
    assert ("abab", False, 2) in terms_of("ababx ABABY z") and ("z", True, 1) in terms_of("z")


def test_label_model_discounts_correlated_voters():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.3
    good = np.array([(y & (rng.random(2000) < 0.7)) | (~y & (rng.random(2000) < 0.02)) for _ in range(3)]).T
    noise = rng.random(2000) < 0.2
    votes = np.hstack([good, np.repeat(noise[:, None], 4, axis=1)]).astype(float)
    post = label_model(votes, np.where(good.any(axis=1), 0.9, 0.05), 0.3)
    assert ((post > 0.5) == y).mean() > 0.93


def test_label_model_is_bayes_over_every_pattern_of_votes():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.25
    votes = np.column_stack([np.where(y, rng.random(4000) < p, rng.random(4000) < q) for p, q in ((0.7, 0.05), (0.6, 0.1), (0.5, 0.02))]).astype(float)
    post = label_model(votes, np.where(votes.any(axis=1), 0.9, 0.05), 0.25, rounds=400)
    every = np.hstack([votes, ~votes.any(axis=1, keepdims=True)])
    chance = [(np.clip((post @ every + 1) / (post.sum() + 8), 1e-4, 0.999)), np.clip(((1 - post) @ every + 0.1) / ((1 - post).sum() + 2), 1e-5, 0.999)]
    # What the label leaves unexplained goes together in some voters, which share their evidence.
    rest = [every[:, k] - post * chance[0][k] - (1 - post) * chance[1][k] for k in range(4)]
    together = [[float(a @ b / math.sqrt((a @ a) * (b @ b))) for b in rest] for a in rest]
    weight = [1 / (1 + sum(c for j, c in enumerate(row) if j != i and c >= 0.1)) for i, row in enumerate(together)]
    # Both labels of each pattern: what its votes say, times odds that make the mean the prior.
    odds_of = {p: math.prod((chance[0][k] / chance[1][k]) ** weight[k] for k in range(4) if (*p, not any(p))[k]) for p in itertools.product((0, 1), repeat=3)}
    counts = Counter(map(tuple, votes.astype(int).tolist()))
    low, high = 1e-9, 1e9
    for _ in range(200):
        odds = math.sqrt(low * high)
        mean = sum(n * odds * odds_of[p] / (1 + odds * odds_of[p]) for p, n in counts.items()) / 4000
        low, high = (odds, high) if mean < 0.25 else (low, odds)
    for p in counts:
        got = post[(votes == np.array(p)).all(axis=1)]
        assert np.ptp(got) < 1e-9 and abs(got[0] - odds * odds_of[p] / (1 + odds * odds_of[p])) < 1e-3


def test_odd_rows_and_missing_labels(spark):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 1, 7)], "doc_id long, quality int, toxic int")
    d = docs(spark, [*ODD, (50, "You are a stupid, worthless idiot."), (51, "A quiet day.")])
    got = toxicity(d, labels).collect()
    assert len(got) == len(ODD) + 2 and {r.doc_id: r.predicted for r in got if r.doc_id in (1, 2, 3, 50, 51)} == {1: 0, 2: 0, 3: 0, 50: 1, 51: 0}
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert toxicity(docs(spark, []), labels).count() == 0
    assert Model(["a"], [1], 1.0).score(["a", None])[0] <= 1
