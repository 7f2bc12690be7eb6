import random
import re
from collections import Counter

from factgrid.llm.quality_rules import keep_quality, quality_rules
from tests.llm.helpers import ODD, docs

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a ", "b ", "c", "#", "\n", " \t", "é", "|x "]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    got = {r.doc_id: r for r in quality_rules(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), repr(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_odd_rows_and_clashing_columns(spark):
    d = docs(spark, ODD).selectExpr("*", "1 AS n_words", "'x' AS kept", "2 AS __m")
    out = quality_rules(d).collect()
    assert len(out) == len(ODD) and all(r.n_words == 0 and r.base_failed for r in out if r.doc_id in (1, 2, 3))
    kept = keep_quality(d)
    assert kept.columns == d.columns and kept.count() == 0
    clean = "The plan of the city and its river is a long story that was told by many people, and " + " ".join(f"word{i}" for i in range(60))
    assert [r.doc_id for r in keep_quality(docs(spark, [(1, clean), (2, "*** $$$ " + clean.replace(" ", " ## "))])).collect()] == [1]
    assert quality_rules(docs(spark, [])).count() == 0
