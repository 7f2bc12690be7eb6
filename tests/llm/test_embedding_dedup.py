import numpy as np
import pytest

from factgrid.llm import embedding_dedup
from factgrid.llm.embedding_dedup import collision, embedding_components, tables_for
from factgrid.llm.simhash import Forest


def brute(rows, cosine):
    n = len(rows)
    ok = [v is not None and label is not None and i is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v) for i, v, label in rows]
    links, f = [0] * n, Forest(n)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    f.union(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[f.find(i)] = min(least.get(f.find(i), r[0]), r[0])
    return [(r[0], links[i], least.get(f.find(i)), r[0] is not None and least[f.find(i)] == r[0]) for i, r in enumerate(rows)]


def near(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((max(1, n // 6), dim))
    return [(i, (base[i % len(base)] + spread * rng.standard_normal(dim)).astype(np.float32).tolist(), int(i % 3 == 0)) for i in range(n)]


def run(spark, rows, kind="float", **settings):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 AS n", "2 AS cls", "3 AS h1")
    return sorted(map(tuple, embedding_components(df, **settings).collect()), key=str)


@pytest.mark.parametrize("block", [2048, 7])
def test_all_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    rows = near(1, 240, 16, 0.08)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(20)]  # copies
    assert run(spark, rows) == sorted(brute(rows, 0.98), key=str)


def test_odd_vectors(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    rows += [(8, [1.0, 1.0], 1), (9, [1e200, 1e200], 1), (10, [1e-200, 1e-200], 1), (11, [1.0, 1.0], 2), (12, [1.0, 1.0, 0.0], 1), (13, [-0.0, 1.0], 1), (14, [0.0, 1.0], 1), (8, [1.0, 1.0], 1)]
    got = {(r[0], r[1], r[2], r[3]) for r in run(spark, rows, "double")}
    assert (9, 3, 8, False) in got and (10, 3, 8, False) in got and (8, 3, 8, True) in got and (13, 1, 13, True) in got and (14, 1, 13, False) in got
    assert {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 11, 12)} <= got and (None, 0, None, False) in got
    assert run(spark, []) == []


def test_recall_of_the_hashing_itself():
    assert collision(0.2) > 0.85 and collision(2**0.5) < 0.35
    for n in (10, 10_000, 10_000_000):
        hashes, tables = tables_for(n, 0.98)
        assert (1 - collision(0.2) ** hashes) ** tables <= 1e-5
