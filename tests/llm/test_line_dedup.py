import random
import re
import time

import pytest

from factgrid.llm.line_dedup import line_dedup, shortest_windows
from tests.llm.helpers import ODD, SF, docs

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, least):
    """Deletes each run of lines with enough words that an earlier place begins; every run is tried."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    lines = {k: (rows[k][1] or "").split("\n") for k in order}
    words = {k: [len(WORD.findall(x)) for x in lines[k]] for k in order}
    seen, gone = set(), {k: set() for k in order}
    for k in order:
        for s in range(len(lines[k])):
            for e in range(s + 1, len(lines[k]) + 1):
                if sum(words[k][s:e]) >= least:
                    run = tuple(lines[k][s:e])
                    if run in seen:
                        gone[k].update(range(s, e))
                    seen.add(run)
    return [(i, None if t is None else "\n".join(x for n, x in enumerate(lines[k]) if n not in gone[k]), len(gone[k])) for k, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_every_run_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["", "a", "b b", "c c c", "d d d d", " ", "e e e e e e"]
    rows = []
    for i in range(60):
        n = rng.randint(0, 14)
        text = "\n".join(rng.choice(vocabulary) for _ in range(n))
        if rows and rng.random() < 0.3:
            text = text + "\n" + rng.choice(rows)[1]
        rows.append((i, text))
    rng.shuffle(rows)
    got = line_dedup(docs(spark, rows), min_words=8, counts=("n", "gone"))
    assert sorted((r.doc_id, r.text, r.gone) for r in got.collect()) == sorted(brute(rows, 8))


def test_windows_are_the_shortest_and_linear():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice([0, 0, 1, 2, 5, 9]) for _ in range(rng.randint(0, 12))]
        for s, n in enumerate(shortest_windows(words, 10)):
            ends = [e for e in range(s + 1, len(words) + 1) if sum(words[s:e]) >= 10]
            assert n == (ends[0] - s if ends else 0)
    start = time.perf_counter()
    assert shortest_windows([50] + [0] * 100_000 + [50] * 100_000, 50)[:3] == [1, 100_001, 100_000]
    assert time.perf_counter() - start < 1


def test_blank_lines_and_long_runs(spark):
    block = " ".join(f"w{i}" for i in range(50))
    rows = [(1, block + "\n" * 4000), (2, block + "\n" * 3000 + "x"), (3, "y" + "\n" * 3000 + block + "\n" * 5000), (4, "\n" * 9000)]
    got = {r.doc_id: r for r in line_dedup(docs(spark, rows), counts=("n", "gone")).collect()}
    assert [got[i].gone for i in (1, 2, 3, 4)] == [0, 3000, 4001, 0] and got[2].text == "x" and got[3].text == "y" + "\n" * 2999 + "\n" * 1000
    lines = [f"{i} and more" for i in range(700)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["before", *lines[100:611], "after"])), (3, "\n".join([*lines[600:], *lines[:120]])), (4, "\n".join(lines[90:107]))]
    got = line_dedup(docs(spark, rows), counts=("n", "gone"))
    assert sorted((r.doc_id, r.text, r.gone) for r in got.collect()) == [(1, rows[0][1], 0), (2, "before\nafter", 511), (3, "", 220), (4, "", 17)]


def test_odd_rows_and_columns(spark):
    passage = "\n".join(f"line {i} of a passage that many documents share with each other" for i in range(6))
    rows = [*ODD, (10, "before\n" + passage), (11, passage + "\nafter"), (None, passage), (12, passage), (12, passage)]
    d = docs(spark, rows).selectExpr("*", "1 AS k1", "2 AS rep", "3 AS __n", "4 AS kept", "5 AS __ld_1", "6 AS __ld_n")
    got = line_dedup(d)
    assert got.columns == d.columns
    texts = sorted((r.doc_id, r.text) for r in got.filter("doc_id >= 10 OR doc_id <= 3").collect())
    assert texts == [(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (10, "before"), (11, "after"), (12, ""), (12, "")]
    assert got.filter(got.doc_id.isNull() & got.text.startswith("line 0")).count() == 1
    assert line_dedup(docs(spark, [])).count() == 0


def test_whole_table_keeps_documents_and_first_copies(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = line_dedup(d)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    kept = {r.doc_id: r.text for r in got.collect()}
    assert len(kept) == len(rows)
    small = [r for r in rows if r[1].count("\n") < 40]
    assert all(kept[i] == t for i, t in rows if i == 0)
    assert len(small) > 100
