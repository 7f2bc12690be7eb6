import random
import tracemalloc

import public_tokenizers as P
import pytest
import sentencepiece as spm
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from factgrid.llm import token_counts as token_counts_module
from factgrid.llm.token_counts import Pieces, Trie, brute_force_count, token_counts
from tests.llm.helpers import ODD, SF, docs

MODEL = P.path("piece_bpe_32k.model")
PIECES = Pieces(MODEL)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="the aionr\n éß的x", max_size=40))
def test_trie_is_the_whole_text_dynamic_program(text):
    trie = Trie(PIECES, 50)
    for part in ([text[::-1], text], [None, ""], [text]):
        assert [n for n, _ in trie.count(part)] == [brute_force_count(PIECES, t) for t in part]


def test_agrees_with_a_library_for_unigram_models():
    library = Tokenizer(models.Unigram([("<unk>", PIECES.unknown), *PIECES.score.items()], 0, False))
    for w in ("the", " the nation", " therefore", " international", " reanding", " ouened", " Éducation"):
        trie, ids = Trie(PIECES, 1000), library.encode(w).ids
        trie.insert([w])
        assert trie.score[-1] == pytest.approx(sum(PIECES.score[library.id_to_token(i)] for i in ids)) and trie.tokens[-1] == len(ids)


def test_counts_are_near_those_of_the_files_own_mode():
    sp = spm.SentencePieceProcessor(model_file=MODEL)
    texts = ["The people of the city were there when the river rose again in the spring of that year.", "Les habitants de la ville ont vu la rivière monter."]
    for t in texts:
        assert abs(Trie(PIECES, 1000).count([t])[0][0] - len(sp.encode(t))) <= 2


def test_long_words_and_bounded_memory(monkeypatch):
    monkeypatch.setattr(token_counts_module, "HELD", 100)
    rng = random.Random(5)
    texts = ["".join(rng.choice("的一是thean ß" if k % 2 else "的一是thean") for _ in range(rng.randint(1, 900))) for k in range(60)]
    texts += [texts[0] + "x", texts[0][:70], texts[0] * 2]
    trie = Trie(PIECES, 300)
    assert [n for n, _ in trie.count(texts)] == [brute_force_count(PIECES, t) for t in texts]
    assert len(trie.score) <= 300 and all(len(w) <= token_counts_module.DEPTH for w in trie.terminal)
    monkeypatch.undo()
    trie = Trie(PIECES, 1_200_000)
    rows = ["".join(map(chr, rng.choices(range(0x4E00, 0x9000), k=20_000))) for _ in range(20)]
    tracemalloc.start()
    trie.count(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000 and len(trie.score) <= 20 * (token_counts_module.DEPTH + 1) + 1


def test_query_on_whole_table_and_odd_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(d, MODEL).collect()}
    assert got == {r.doc_id: brute_force_count(PIECES, r.text) for r in d.collect()}
    rows = token_counts(docs(spark, ODD), MODEL, max_nodes=100).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert token_counts(docs(spark, []), MODEL).count() == 0
