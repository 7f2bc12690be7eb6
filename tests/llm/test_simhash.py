import random
from collections import defaultdict

import numpy as np
import xxhash

from factgrid.llm import components, simhash
from factgrid.llm.simhash import Forest, fingerprint, keep_one_of_each, near_forest, similar_components, simhash_components
from tests.llm.helpers import ODD, SF, docs


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(prints, radius):
    """prints: (id, fingerprint). Smallest id reachable."""
    f = Forest(len(prints))
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                f.union(i, j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(prints):
        r = f.find(i)
        least[r] = d if least[r] is None else least[r] if d is None else min(least[r], d)
    return [least[f.find(i)] for i in range(len(prints))]


def test_fingerprints():
    for t in ["", None, "one", "Two Words", "a b c d", "É É e e e E A", "x " * 70_000]:
        assert fingerprint(t) == slow_fingerprint(t)


def test_bit_sliced_forest_is_brute_force():
    rng = np.random.default_rng(5)
    for radius in (0, 3, 4, 6):
        sizes = [1, 2, 63, 64, 65, 130, 700, 1]
        rows, starts = [], [0]
        for n in sizes:
            base = rng.integers(0, 1 << 63, max(1, n // 5), dtype=np.uint64)
            group = base[rng.integers(0, len(base), n)]
            for _ in range(4):
                group = group ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.6).astype(np.uint64)
            rows.append(group)
            starts.append(starts[-1] + n)
        fps = np.concatenate(rows)
        child, root = near_forest(fps, np.array(starts), radius)
        got = Forest(len(fps))
        for c, r in zip(child.tolist(), root.tolist(), strict=True):
            got.union(c, r)
        want = Forest(len(fps))
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            for i in range(lo, hi):
                for j in np.nonzero(np.bitwise_count(fps[lo:i] ^ fps[i]) <= radius)[0]:
                    want.union(lo + int(j), i)
        assert [got.find(i) for i in range(len(fps))] == [want.find(i) for i in range(len(fps))]


def test_whole_table_against_all_pairs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    got = {r.doc_id: r for r in simhash_components(d).collect()}
    prints = [(i, slow_fingerprint(t)) for i, t in sorted(texts.items())]
    for (i, fp), c in zip(prints, slow_components(prints, 4), strict=True):
        assert got[i].fingerprint == f"{fp:016x}" and got[i].component_id == c


def jaccard_components(rows, similarity=0.8, n=5):
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else {()})
    f = Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                f.union(i, j)
    least = {}
    for i, r in enumerate(rows):
        least[f.find(i)] = min(least.get(f.find(i), r[0]), r[0])
    return {r[0]: least[f.find(i)] for i, r in enumerate(rows)}


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 2, 5, 20])):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
        else:
            words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(3, 200))]
        rows.append((i, " ".join(words)))
    want = jaccard_components(rows)
    got = {r.doc_id: r.component_id for r in similar_components(docs(spark, rows)).collect()}
    assert sum(got[i] != c for i, c in want.items()) <= 1  # a candidate may be missed, with a chance of about one in a hundred at 0.8 itself
    assert {r.doc_id for r in keep_one_of_each(docs(spark, rows)).collect()} == set(got.values())
    d = spark.read.parquet(f"{SF}/documents.parquet")
    table = [(r.doc_id, r.text) for r in d.collect()]
    found = {r.doc_id: r.component_id for r in similar_components(d).collect()}
    assert found == jaccard_components(table)


def variant(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.random()}"
    return words


def test_true_pairs_among_many_near_misses(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    texts = [variant(rng, base, 4) for _ in range(400)]  # about 0.66 alike, mostly within the radius
    texts += [variant(rng, t, 2) for t in texts[:40]]  # about 0.9 alike
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = jaccard_components(rows)
    assert len(set(want.values())) <= 400
    monkeypatch.setattr(simhash, "VERIFY_ROWS", 150, raising=False)
    got = {r.doc_id: r.component_id for r in similar_components(docs(spark, rows)).collect()}
    assert [(i, c, got[i]) for i, c in want.items() if got[i] != c] == []


def test_wide_fingerprints_count_a_repeated_shingle_once():
    distance = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(*(simhash.wide_fingerprint(t, 5, 42) for t in (a, b)), strict=True))
    far = []
    for n in range(30):
        body, sentence = " ".join(f"b{n}x{i}" for i in range(100)), " ".join(f"s{n}x{i}" for i in range(10))
        far.append(distance(f"{body} {sentence}", f"{body}{f' {sentence}' * 10}"))  # 0.96 alike
    assert max(far) <= simhash._radius_of(0.8), (min(far), max(far))


def test_longer_keys_find_as_many_pairs():
    rng = np.random.default_rng(3)
    for bits in (14, 16, 19, 24):
        keys = simhash._keys_for(0.8, bits)
        assert simhash._miss(0.8, bits, keys) <= simhash.MISS < simhash._miss(0.8, bits, keys - 1)
        differ = rng.random((3000, 256)) < simhash._differ(0.8)
        shared = np.zeros(len(differ), dtype=bool)
        for drawn in simhash._chosen(bits, keys):
            shared |= ~differ[:, drawn].any(axis=1)
        found = shared & (differ.sum(axis=1) <= simhash._radius_of(0.8))
        assert found.mean() > 0.98


def test_a_shingle_that_prevails_does_not_unite(spark):
    rows = [(i, "ha " * 10 + " ".join(f"w{i}x{k}" for k in range(4))) for i in range(3)] + [(3, "ha " * 11 + " ".join(f"w0x{k}" for k in range(4)))]
    assert {r.doc_id: r.component_id for r in similar_components(docs(spark, rows)).collect()} == {0: 0, 1: 1, 2: 2, 3: 0}


def test_hot_buckets_in_blocks_and_longer_keys(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = [(i, base[i % 40] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for i in range(400)]
    monkeypatch.setattr(simhash, "fingerprint", lambda t, *_: int(t))
    want = slow_components(prints, 4)
    rows = [(i, str(fp)) for i, fp in prints]
    for blocks, full in ((3, 256), (50, 0)):
        monkeypatch.setattr(simhash, "BLOCK_ROWS", blocks)
        monkeypatch.setattr(simhash, "FULL_BUCKET", full)
        prepared = [fp - (1 << 64) if fp >> 63 else fp for _, fp in prints]
        classes = spark.createDataFrame([(x,) for x in prepared], "fp long").distinct()
        bands = simhash._bands(classes.count(), 4)
        assert len(bands) == (5 if full else 70)
        assert all(any(all((a >> s ^ b >> s) & ((1 << n) - 1) == 0 for s, n in band) for band in bands) for (_, a), (_, b) in zip(prints, prints[40:], strict=False) if (a ^ b).bit_count() <= 4)
        assert len(rows) == len(want)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (300, None)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_let_all_rows_of_a_bucket_meet(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 1), (2, 2), (3, 40)) for i in range(n)], "k int, x long")
    blocks = defaultdict(set)
    for r in components.in_blocks(rows, ["k"], "x", 10).collect():
        blocks[r.k, r.part_a, r.part_b].add(r.x)
    assert {k for k, _, _ in blocks} == {2, 3}
    for a in range(40):
        assert all(any({a, b} <= s for (k, _, _), s in blocks.items() if k == 3) for b in range(a))


def test_odd_rows(spark):
    d = docs(spark, ODD).selectExpr("*", "1 AS fp", "2 AS component", "3 AS node")
    got = simhash_components(d).collect()
    want = [(i, slow_fingerprint(t)) for i, t in ODD]
    assert sorted(((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in got)) == sorted((i or -1, f"{fp:016x}", c or -1) for (i, fp), c in zip(want, slow_components(want, 4), strict=True))
    kept = keep_one_of_each(d)
    assert kept.columns == d.columns and kept.filter("doc_id = 4").count() == 1 and kept.filter("doc_id IS NULL").count() == 1
    assert {r.doc_id: r.component_id for r in similar_components(d).collect() if r.doc_id in (1, 2, 3, None)} == {1: 1, 2: 1, 3: 1, None: None}
    assert similar_components(docs(spark, [])).count() == 0
    assert simhash_components(docs(spark, [])).count() == 0
