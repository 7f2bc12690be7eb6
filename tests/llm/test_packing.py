import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from factgrid.llm.packing import ChunkTokenizer, pack, plan_bins
from tests.llm.helpers import ODD, SF, docs

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def test_plan_places_every_piece_once_and_large_ones_pair():
    rng = random.Random(1)
    for _ in range(40):
        lengths = [rng.choice([rng.randint(1, 60), rng.randint(30, 100)]) for _ in range(rng.randint(0, 200))]
        bins, placed = defaultdict(list), Counter()
        for length, first, number, sequence, offset in plan_bins(dict(Counter(lengths)), 100):
            assert first == placed[length]
            placed[length] += number
            for k in range(number):
                bins[sequence + k].append((offset, length))
        assert placed == Counter(lengths)
        for content in bins.values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            assert at <= 100 and sum(3 * length > 100 for _, length in content) <= 2
        large = sum(3 * x > 100 for x in lengths)
        assert len(bins) <= max(-(-sum(lengths) // 100) * 1.3 + 2, large)


def test_chunks_give_the_ids_of_the_whole_text():
    texts = [t for _, t in ODD if t and len(t) < 1000] + ["Don't STOP, it's 12 o'clock...", "a\x1cb c\x85d", "ÎŒ İstanbul क़ x²", "«quoted», (word)!!", "the the The THE", "naïve café—x"]
    got = ChunkTokenizer(open(PATH, encoding="utf-8").read()).encode(texts, 0)
    for t, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, dtype="<u4").tolist() == ids(t), repr(t)


def test_every_letter_before_punctuation_and_random_mixes():
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    rng = random.Random(2)
    pool = letters[::7] + list("abcABC,.!?'’-–#<>|़̇  \n\t") * 300
    texts = ["GAZİ, Lİ.", *(f"a{c}, {c}. x{c}{c}!" for c in letters), *("".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000))]
    got = ChunkTokenizer(open(PATH, encoding="utf-8").read()).encode(texts, 0)
    for t, raw, found in zip(texts, got, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, dtype="<u4").tolist() == [*found.ids, 0], repr(t)


def verify(spark_rows, texts, capacity):
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in spark_rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        all_ids, at = ids(t), 0
        for k, r in enumerate(sorted(of_doc[i], key=lambda r: r.piece)):
            part = np.array(all_ids[at : at + r.length], dtype="<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(part)) and (r.length == capacity or at + r.length == len(all_ids))
            at += r.length
        assert at == len(all_ids)
    for content in of_sequence.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return len(of_sequence)


def test_whole_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack(d, PATH).collect()
    n = verify(rows, {r.doc_id: r.text for r in d.collect()}, 2048)
    assert n <= 1.02 * sum(r.length for r in rows) / 2048 + 2


def test_odd_rows_and_small_capacity(spark):
    rows = [(i, t) for i, (_, t) in enumerate(ODD)]
    verify(pack(docs(spark, rows).selectExpr("*", "5 AS length", "1 AS block"), PATH, capacity=7).collect(), dict(rows), 7)
    assert pack(docs(spark, [(1, None), (1, None), (None, "x")]), PATH).count() == 3
    assert pack(docs(spark, []), PATH).count() == 0
