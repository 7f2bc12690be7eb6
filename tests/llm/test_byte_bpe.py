import hashlib
import random
import time

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factgrid.llm.byte_bpe import Encoder, Ranks, byte_bpe, digests
from tests.llm.helpers import ODD, SF, docs

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = Ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS.id_of, special_tokens={})
ENCODER = Encoder(RANKS, P.PATTERN)


def library(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256((text or "").encode()).hexdigest()}


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    assert digests(ENCODER.encode([text])[0]) == library(text)


def test_long_words_and_many_equal_ranks():
    rng = random.Random(3)
    short = ["in", "g", "n", "ing", "th", "e", "r", "的", "é"]
    mixes = ["".join(rng.choice(short) for _ in range(rng.randint(1, 200))) for _ in range(400)]
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10_000))
    for text, found in zip([*mixes, letters, "ng" * 5000, "a" * 10_001], ENCODER.encode([*mixes, letters, "ng" * 5000, "a" * 10_001]), strict=True):
        assert digests(found) == library(text)


def test_words_of_many_characters_take_little():
    words = ["".join(map(chr, random.Random(k).choices(range(0x4E00, 0x5A00), k=70))) for k in range(3000)]
    start = time.process_time()
    found = ENCODER.encode(words)
    assert time.process_time() - start < 3
    assert all(digests(x) == library(w) for x, w in zip(found, words, strict=True))


def test_words_longer_than_the_recursion_takes():
    for text in ("ab" * 400, "的" * 300, "$%" * 700, " " * 900 + "x", "thethethe" * 100):
        assert digests(ENCODER.encode([text])[0]) == library(text)


def test_whole_table_odd_rows_and_round_trip(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    run = lambda x: byte_bpe(x, PATH, P.PATTERN, finish=digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string").collect()
    texts = {r.doc_id: r.text for r in d.collect()}
    got = run(d)
    assert len(got) == len(texts) and all(library(texts[r.doc_id]) == {k: r[k] for k in ("n_tokens", "ids_sha256", "decoded_sha256")} for r in got)
    odd = run(docs(spark, ODD).selectExpr("*", "1 AS i", "2 AS n_tokens"))
    assert sorted(r.ids_sha256 for r in odd) == sorted(library(t)["ids_sha256"] for _, t in ODD)
    assert run(docs(spark, [])) == []
    back = byte_bpe(docs(spark, ODD), PATH, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in ODD)
