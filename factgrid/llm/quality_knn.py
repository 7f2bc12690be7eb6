"""Quality scores by votes of labelled nearest neighbours in a latent-semantic space."""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_rows
from .labelled import sample

#: Labelled rows of each class that vote, and that the space is fitted on.
FIT_ROWS = 2000
#: Buckets of hashed words, of word shapes and of repetition; latent dimensions; neighbours.
WORD_BUCKETS, SHAPE_BUCKETS, REPEAT_BUCKETS = 2048, 1024, 16
TERMS = WORD_BUCKETS + SHAPE_BUCKETS + REPEAT_BUCKETS
LATENT, NEIGHBOURS = 48, 25
#: Documents whose products with all voters are worked out at once.
BLOCK = 500
RUNS = re.compile(r"[^\W\d_]+|\d+|\s+|.", re.DOTALL)


def _hash(s: str, n: int) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass")) % n


def shape(word: str) -> str:
    """The word with its letters, digits and signs in runs: `Ab3!!` is `Xx9!!`."""
    out = []
    for run in RUNS.findall(word):
        if run.isalpha():
            out.append("X" if run.isupper() and len(run) > 1 else "Xx" if run[0].isupper() else "x")
        else:
            out.append("9" if run.isdigit() else run)
    return "".join(c if len(list(g)) == 1 else c * 2 for c, g in groupby("".join(out)))


class Terms:
    """Counts of hashed words, word shapes and kinds of repetition in a text."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def _ids(self, w: str) -> tuple[int, int]:
        return _hash(w.lower(), WORD_BUCKETS), WORD_BUCKETS + _hash("=" + shape(w), SHAPE_BUCKETS)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        x = np.zeros(TERMS, dtype=np.float32)
        if not words:
            return x
        known = self.known
        if len(known) > 250_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._ids(w)
        ids = np.array(list(map(known.__getitem__, words)), dtype=np.int64)
        x[: TERMS - REPEAT_BUCKETS] = np.bincount(ids.ravel(), minlength=TERMS - REPEAT_BUCKETS)
        # Repetition as terms: words after the same word, and the share of words that occurred before, in steps.
        n = len(words)
        again = np.count_nonzero(ids[1:, 0] == ids[:-1, 0])
        pairs = (ids[1:, 0] * WORD_BUCKETS + ids[:-1, 0]) if n > 1 else ids[:0, 0]
        known_pairs = 1 - len(np.unique(pairs)) / max(1, len(pairs))
        base = TERMS - REPEAT_BUCKETS
        x[base + min(7, int(8 * again / n))] = again
        x[base + 8 + min(7, int(8 * known_pairs))] = known_pairs * n
        return x


class Space:
    """Latent-semantic vectors of the labelled texts, and the projection into their space."""

    def __init__(self, texts: list[str], labels: list[int], share: float):
        terms = Terms()
        counts = np.zeros((len(texts), TERMS), dtype=np.float32)
        for i, t in enumerate(texts):
            counts[i] = terms(t)
        self.idf = (np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 0.1).astype(np.float32)
        self.share = share
        self.basis = np.zeros((TERMS, 0), dtype=np.float32)
        weighted = self._weigh(counts)
        del counts
        if len(texts):
            # The leading right singular vectors, by block power iteration.
            rank = min(LATENT, len(texts))
            basis = np.random.default_rng(7).standard_normal((TERMS, rank + 16)).astype(np.float32)
            for _ in range(12):
                basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
            values, vectors = np.linalg.eigh((weighted @ basis).T @ (weighted @ basis))
            self.basis = basis @ vectors[:, np.argsort(values)[::-1][:rank]]
        self.voters = self._unit(weighted @ self.basis)
        y = np.array(labels, dtype=np.float64)
        self.labels = y
        # The sample may hold the classes in other shares than the labelled rows do.
        ones = max(1.0, y.sum())
        zeros = max(1.0, len(y) - y.sum())
        self.weights = np.where(y == 1, share / ones, (1 - share) / zeros)

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest voters, by similarity; the share of all where none is similar."""
        out = np.full(len(counts), self.share)
        if not self.basis.shape[1]:
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(counts), BLOCK):
            cosine = self._unit(self._weigh(counts[at : at + BLOCK]) @ self.basis) @ self.voters.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 8 * self.weights[near]
            total = votes.sum(axis=1)
            some = total > 0
            out[at : at + BLOCK][some] = ((votes * self.labels[near]).sum(axis=1)[some]) / total[some]
        return np.clip(out, 0, 1)


def quality_votes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, threshold: float = 0.3) -> DataFrame:
    """Scores every whole text for quality: id_col, held_out, score (0 to 1), predicted (score >= threshold).

    At most fit_rows labelled rows of each class whose crc32(id) mod 5 is not 0 fit the space and vote; their
    vectors are broadcast. Every document is compared with all of them, in blocks of exact
    cosine products, and its nearest neighbours' labels are weighted by similarity, and so that
    classes count by their shares. One pass without shuffle over all rows.

    Null and empty texts have no vector and score the share of label 1. Without labels all
    score 0.5. Repeated rows and null ids (not held out) are scored one by one. An empty table gives an empty
    one. Only id_col, text_col and the label column are read.
    """
    space = docs.sparkSession.sparkContext.broadcast(Space(*sample(docs, labels, "quality", fit_rows, id_col, text_col)))
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def start():
        terms = Terms()

        def step(rows: dict) -> dict:
            scores: list[float] = []
            for at in range(0, len(rows["t"]), BLOCK):
                scores += space.value.score(np.array([terms(t) for t in rows["t"][at : at + BLOCK]])).tolist()
            return {id_col: rows["i"], "score": scores}

        return step

    scored = map_rows(docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")), start, f"`{id_col}` {id_type}, score double")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
