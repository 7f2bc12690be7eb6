"""Best-fit packing of token sequences: documents above a third of the capacity are matched, smaller ones fill gaps."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize

#: Chunks and words that a worker process remembers the ids of, and words that are encoded at once.
CACHED_CHUNKS, ENCODED_WORDS = 800_000, 500
#: White space of any kind but the six ASCII ones, which str.split() would also split on.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CHUNK = re.compile(r"[^ \t-\r]+")
#: ASCII punctuation without the apostrophe, which may begin a word of its own.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
WORD_END = "</w>"


_LAST: dict[str, ChunkTokenizer] = {}


def tokenizer_of(model: str) -> ChunkTokenizer:
    """The worker process's tokenizer: the next task of the same model goes on with its chunks."""
    if model not in _LAST:
        _LAST.clear()
        _LAST[model] = ChunkTokenizer(model)
    return _LAST[model]


class ChunkTokenizer:
    """Ids of texts by a tokenizer that drops white space, from ids of the chunks between white space.

    A chunk whose normal form is letters with punctuation behind is two words to the tokenizer. New words
    of letters are encoded together, and told apart by the tokens that end a word. All other chunks are encoded as they are.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.ids: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)

    def _one(self, text: str) -> bytes:
        found = self.ids.get(text)
        if found is None:
            found = self.ids[text] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return found

    def _learn(self, chunks: list[str]) -> None:
        known = self.ids
        cased, ended, new = [], [], {}
        for chunk in chunks:
            word = chunk if chunk.isalpha() else chunk.rstrip(PUNCTUATION)
            if not word.isalpha() or not (word.isascii() or self.normal(word).isalpha()):  # a normal form may end in marks
                self._one(chunk)
                continue
            lower = word.lower() if word.isascii() else word
            if lower not in known:
                new[lower] = None
            if word is not chunk:
                ended.append((chunk, lower, chunk[len(word) :]))
            elif lower != word:
                cased.append((word, lower))
        words = list(new)
        groups = [words[at : at + ENCODED_WORDS] for at in range(0, len(words), ENCODED_WORDS)]
        for at in range(0, len(groups), 20):
            part = groups[at : at + 20]
            for group, found in zip(part, self.tokenizer.encode_batch_fast([" ".join(g) for g in part], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, dtype="<u4")
                ends = (np.nonzero(self.ends[ids])[0] + 1) * 4
                if len(ends) == len(group):
                    raw, cuts = ids.tobytes(), [0, *ends.tolist()]
                    known.update(zip(group, [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], strict=True))
                else:  # letters that the tokenizer's pattern doesn't know as such
                    for word in group:
                        self._one(word)
        for chunk, lower in cased:
            known[chunk] = known[lower]
        for chunk, lower, rest in ended:
            known[chunk] = known[lower] + self._one(rest)

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """Each text's ids and end_id as little-endian unsigned 32-bit numbers."""
        end, known = end_id.to_bytes(4, "little"), self.ids
        if len(known) > CACHED_CHUNKS:
            known.clear()
        found, gaps, new = [], [], set()
        for text in texts:
            chunks = [] if not text else CHUNK.findall(text) if OTHER_SPACE.search(text) else text.split()
            parts = list(map(known.get, chunks))
            if None in parts:
                at = [i for i, p in enumerate(parts) if p is None]
                missing = [chunks[i] for i in at]
                new.update(missing)
                gaps.append((parts, at, missing))
            parts.append(end)
            found.append(parts)
        self._learn(list(new))
        for parts, at, missing in gaps:
            for i, chunk in zip(at, missing, strict=True):
                parts[i] = known[chunk]
        return [b"".join(parts) for parts in found]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Bins for counts of equal lengths: rows (length, from_rank, rows, sequence, offset).

    Row k of such an entry, the piece of that length and of rank from_rank + k, goes to sequence
    + k at offset. The work is on lengths, at most `capacity` of them, whatever the number of
    pieces: large lengths (above a third of capacity) go first, longest first, each with the
    longest large one that still fits, so at most two of them share a bin; the others, longest
    first, go to the smallest gap that takes them, or to new bins.
    """
    left = Counter({n: c for n, c in counts.items() if c})
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    rank: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of sequences (first, number) that have it
    open_gaps: list[int] = []
    sequences = 0

    def put(length: int, first: int, number: int, offset: int) -> None:
        out.append((length, rank[length], number, first, offset))
        rank[length] += number
        left[length] -= number

    def leave(gap: int, first: int, number: int) -> None:
        if gap:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((first, number))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            mate = next((m for m in large if m <= capacity - length and left[m] and (m != length or left[m] > 1)), None)
            number = left[length] if mate is None else left[length] // 2 if mate == length else min(left[length], left[mate])
            first, sequences = sequences, sequences + number
            put(length, first, number, 0)
            if mate is not None:
                put(mate, first, number, length)
            leave(capacity - length - (mate or 0), first, number)
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
                take = min(number, left[length])
                put(length, first, take, capacity - gap)
                leave(gap - length, first, take)
                if take < number:
                    leave(gap, first + take, number - take)
            else:  # new bins hold as many of this length as fit, and the rest of them is a gap
                each = capacity // length
                number = max(1, left[length] // each)
                first, sequences = sequences, sequences + number
                here = min(each, left[length]) if number == 1 else each
                for k in range(here):
                    put(length, first, number, k * length)
                leave(capacity - here * length, first, number)
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the token sequences of all texts into as few sequences of at most capacity tokens as it can.

    Returns per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset. A document is its ids and
    then end_id; only longer ones are cut, into pieces of capacity tokens. The counts of each
    length are all that the driver gets; a piece finds its place by its rank among the pieces of
    its length, which is counted by block and length.

    Null and empty texts are end_id alone. Repeated rows, also of null ids, are packed one by
    one; an empty table gives an empty one. Other columns are not read. The tokenizer must drop
    white space and keep no state across it.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def start():
        from pyspark import TaskContext

        tokens, block, seen = tokenizer_of(model.value), TaskContext.get().partitionId(), Counter()

        def step(rows: dict) -> dict:
            out: dict[str, list] = {c: [] for c in ("id", "piece", "start", "length", "ids_crc32", "block", "own")}
            for i, ids in zip(rows["i"], tokens.encode(rows["t"], end_id), strict=True):
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    for c, v in zip(out, (i, piece, at // 4, n, zlib.crc32(part), block, seen[n]), strict=True):
                        out[c].append(v)
                    seen[n] += 1
            return out

        return step

    frame = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    pieces = materialize(map_rows(frame, start, f"id {id_type}, piece int, start long, length long, ids_crc32 long, block int, own long"))
    counts = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("own"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(sorted(plan_bins(totals, capacity)), dtype=np.int64).reshape(-1, 5)
    places = docs.sparkSession.sparkContext.broadcast(plan)

    def place():
        length, first, _, sequence, offset = places.value.T
        key = length << np.int64(44) | first

        def step(rows: dict) -> dict:
            at = np.searchsorted(key, np.array(rows["length"], dtype=np.int64) << np.int64(44) | np.array(rows["rank"], dtype=np.int64), side="right") - 1
            found = sequence[at] + np.array(rows["rank"], dtype=np.int64) - first[at]
            kept = {c: rows[c] for c in ("piece", "start", "length", "ids_crc32")}
            return {id_col: rows["id"], **kept, "sequence_id": found.tolist(), "offset": offset[at].tolist()}

        return step

    columns = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_rows(ranked.select("id", "piece", "start", "length", "ids_crc32", "rank"), place, columns)
