"""Toxicity by weak supervision: voters, a generative label model over them, a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.plans.ship import ship_package

from .common import held_out, map_rows
from .labelled import sample

#: Common English insults, one voter beside the lexicons that labelled rows yield.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown fool imbecile jerk bastard freak vermin filth".split())
#: Labelled rows of each class that the model is fitted on.
FIT_ROWS = 2500
#: Terms that become voters, how many of them a toxic text should hold before the search turns to other texts,
#: and how sure of label 1 a term must be in the labelled rows.
VOTERS, COVER, PRECISION = 128, 4, 0.9
#: Lengths of word beginnings that may be terms, and how often in a text; a whole word is a term as well.
STEMS, TIMES = (3, 4, 5, 6, 7, 8), (1, 2, 3)
WORD = re.compile(r"\w+")
INSULTING = re.compile(r"\b(?:you|du|tu|eres|vous|ihr)\b\W+(?:\w+\W+){0,2}?(?:are|bist|es|seid|un|a|an|ein)?\W*(\w+)")

#: (word or word beginning, whether it is a whole word, occurrences that it takes)
Term = tuple[str, bool, int]


def terms_of(text: str) -> set[Term]:
    """Lower-cased words and their beginnings, each with the numbers of occurrences that it reaches."""
    words = Counter(WORD.findall(text.lower()))
    stems: Counter = Counter()
    for w, n in words.items():
        for k in STEMS:
            if len(w) < k:
                break
            stems[w[:k]] += n
    return {(w, whole, t) for whole, counts in ((True, words), (False, stems)) for w, n in counts.items() for t in TIMES if n >= t}


def find_terms(texts: list[str], labels: list[int], share: float) -> list[Term]:
    """Terms that mark label 1, significantly and with PRECISION, chosen for the texts that they add."""
    def keys(terms: set[Term]) -> np.ndarray:
        return np.fromiter(map(hash, terms), dtype=np.int64, count=len(terms))

    # Terms are counted by their hashes, so that those of all texts are never held at once.
    marked = [t for t, y in zip(texts, labels, strict=True) if y]
    seen, ones = np.unique(np.concatenate([keys(terms_of(t)) for t in marked]), return_counts=True)
    need = math.log(max(2, len(seen)) / 0.01)
    seen, ones = seen[ones >= 3], ones[ones >= 3]
    zeros = np.zeros(len(seen), dtype=np.int64)
    for text, y in zip(texts, labels, strict=True):
        if not y and len(seen):
            zeros[np.intersect1d(keys(terms_of(text)), seen, assume_unique=True, return_indices=True)[2]] += 1
    n1, n0 = max(1, sum(labels)), max(1, len(labels) - sum(labels))
    expected, p, rate = n1 / (n1 + n0), ones / (ones + zeros), ones / n1 * share
    # Binomial evidence against the share of label 1, over as many terms as were looked at.
    gain = ones * np.log(p / expected) + zeros * np.log(np.maximum((1 - p) / (1 - expected), 1e-300))
    strong = (p > expected) & (gain > need) & (rate / (rate + zeros / n0 * (1 - share)) >= PRECISION)
    misses = dict(zip(seen[strong].tolist(), zeros[strong].tolist(), strict=True))
    holders: dict[Term, list[int]] = defaultdict(list)
    for i, text in enumerate(marked):
        for t in terms_of(text):
            if hash(t) in misses:
                holders[t].append(i)
    misses_of = {t: misses[hash(t)] for t in holders}
    # Of terms with the same texts, such as the beginnings of one word, the shortest is enough.
    alike: dict[tuple, Term] = {}
    for t in sorted(holders, key=lambda t: (t[2], len(t[0]), t)):
        alike.setdefault((tuple(holders[t]), misses_of[t]), t)
    holders = {t: holders[t] for t in alike.values()}
    chosen, covered = [], [0] * len(marked)
    while len(chosen) < VOTERS and holders:
        gains = {t: sum(covered[i] < COVER for i in rows) for t, rows in holders.items()}
        holders = {t: rows for t, rows in holders.items() if gains[t] >= 3}
        if not holders:
            break
        best = max(holders, key=lambda t: (gains[t] - 3 * misses_of[t] * n1 / n0, -t[2], -len(t[0]), t))
        for i in holders.pop(best):
            covered[i] += 1
        chosen.append(best)
    return sorted(chosen)


class Votes:
    """What the voters find in a text: a term each, the fixed lexicon, and three patterns."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.words = {w for w, whole, _ in terms if whole}
        self.stems = {w for w, whole, _ in terms if not whole}
        self.lengths = sorted({len(w) for w in self.stems})
        self.n_terms, self.size = len(terms), len(terms) + 4
        self.known: dict[str, tuple] = {}

    def _of_word(self, w: str) -> tuple:
        """Keys of the terms that the word counts for, and None if it is in the fixed lexicon."""
        out: list = [(w, True)] if w in self.words else []
        out += [(w[:n], False) for n in self.lengths if len(w) >= n and w[:n] in self.stems]
        return tuple(out + [None] * (w in INSULTS))

    def __call__(self, text: str) -> np.ndarray:
        x = np.zeros(self.size)
        lower = text.lower()
        words = WORD.findall(lower)
        known = self.known
        if len(known) > 150_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._of_word(w)
        found = [(w, hit) for w in words if (hit := known[w])]
        if found:
            counts = Counter(k for _, hit in found for k in hit)
            for i, (w, whole, times) in enumerate(self.terms):
                x[i] = counts.get((w, whole), 0) >= times
            marked = {w for w, hit in found if None in hit or any(x[i] for i, t in enumerate(self.terms) if t[:2] in hit)}
            # Patterns: a marked word addressed to someone, two marked words or more, the share of marked words.
            x[self.n_terms] = counts[None] > 0
            x[self.n_terms + 1] = bool(marked) and any(m in marked for m in INSULTING.findall(lower))
            x[self.n_terms + 2] = len(marked) >= 2
            x[self.n_terms + 3] = np.log1p(100 * sum(w in marked for w in words) / len(words))
        return x


def label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 50) -> np.ndarray:
    """Posterior of label 1 for each row of votes (1, or 0 to abstain), by EM on voters' accuracies and correlations.

    start has the posteriors to begin with. Each voter has its own chance to vote under either label. Voters whose votes go together beyond what
    the label explains share their evidence: each counts by the inverse of one plus its
    correlations with the others, which are estimated again after each round.
    """
    # An abstention says nothing; that all abstain is a voter of its own, for label 0.
    votes = np.hstack([votes, ~votes.any(axis=1, keepdims=True)])
    n, m = votes.shape
    post = start
    weight = np.ones(m)
    for _ in range(rounds):
        on1 = (post @ votes + 1) / (post.sum() + 2 / prior)
        on0 = ((1 - post) @ votes + 0.1) / ((1 - post).sum() + 2)
        on1, on0 = np.clip(on1, 1e-4, 0.999), np.clip(on0, 1e-5, 0.999)
        rest = votes - post[:, None] * on1 - (1 - post)[:, None] * on0
        scale = np.sqrt((rest**2).sum(axis=0)) + 1e-9
        correlation = np.clip(rest.T @ rest / np.outer(scale, scale), 0, 1)
        np.fill_diagonal(correlation, 0)
        correlation[correlation < 0.1] = 0
        weight = 1 / (1 + correlation.sum(axis=1))
        logit = (votes * weight) @ np.log(on1 / on0)
        # The offset at which the posteriors' mean is the prior, so that rounds don't drift from it.
        low, high = -40.0, 40.0
        for _ in range(50):
            offset = (low + high) / 2
            new = 1 / (1 + np.exp(-np.clip(logit + offset, -30, 30)))
            low, high = (offset, high) if new.mean() < prior else (low, offset)
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post


def fit_linear(x: np.ndarray, y: np.ndarray, weights: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (weights * (y - p)) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Model:
    """What is fitted: the terms and the linear classifier."""

    def __init__(self, texts: list[str], labels: list[int], share: float):
        self.terms = find_terms(texts, labels, share) if 0 < sum(labels) < len(labels) else []
        self.votes = Votes(self.terms)
        x = np.array([self.votes(t) for t in texts]).reshape(len(texts), self.votes.size)
        ones = max(1, sum(labels))
        prior = min(max(ones / max(len(labels), 1), 0.02), 0.98)
        # A labelled row without votes begins as unknown, since its label rests on nothing that is seen here.
        begin = np.where(np.array(labels) == 1, np.where(x.any(axis=1), 0.9, prior), 0.05)
        post = label_model((x > 0).astype(float), begin, prior) if len(texts) else np.zeros(0)
        # The sample holds the classes in other shares than the labelled rows do.
        share = min(max(share, 1e-3), 1 - 1e-3)
        weights = post * share / prior + (1 - post) * (1 - share) / (1 - prior)
        self.beta = fit_linear(x, post, weights) if len(texts) else np.append(np.zeros(self.votes.size), -3.0)
        if not len(texts):  # no labels at all: the fixed lexicon decides
            self.beta[0] = 5.0
        self.votes.known.clear()

    def score(self, texts: list[str | None]) -> list[float]:
        x = np.array([self.votes(t or "") for t in texts])
        return (1 / (1 + np.exp(-np.clip(x @ self.beta[:-1] + self.beta[-1], -30, 30)))).tolist()


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """Scores every whole text for toxicity: id_col, held_out, score (0 to 1), predicted (score >= threshold).

    Lexicons of words and word beginnings are found on at most fit_rows labelled rows of each
    class whose crc32(id) mod 5 is not 0; each term, a fixed lexicon and patterns vote. A
    generative model turns votes into posterior labels, on which the linear classifier is
    trained. Scoring is one pass without shuffle over all rows.

    Null and empty texts hold no vote and score as such. Repeated rows and null ids (not held
    out) are scored one by one. Without labels only the fixed lexicon and the patterns count. An empty
    table gives an empty one. Only id_col, text_col and the label column are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(Model(*sample(docs, labels, "toxic", fit_rows, id_col, text_col)))
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def start():
        def step(rows: dict) -> dict:
            return {id_col: rows["i"], "score": model.value.score(rows["t"])}

        return step

    scored = map_rows(docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")), start, f"`{id_col}` {id_type}, score double")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(Model(*sample(docs, labels, "toxic", fit_rows, id_col, text_col)))
    ship_package(docs.sparkSession)
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                yield part.filter(pa.array([s < threshold for s in model.value.score(part.column(at).to_pylist())]))

    return docs.mapInArrow(run, schema)
