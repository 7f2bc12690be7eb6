"""Byte-level BPE: recursive DuckDB queries in every partition encode, ordered aggregation decodes."""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from collections.abc import Callable

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows

#: A vocabulary is sent to every executor; larger ones are refused.
MAX_RANKS = 1_000_000
#: Words and bytes that go through one recursive query, and words that a worker process remembers.
QUERY_WORDS, QUERY_BYTES, CACHED_WORDS = 50_000, 1_000_000, 900_000

#: Token-position rows of many words, one behind the other; `cut`: nothing merges across the end of this token.
#: That is so at a word's end, and where no token holds this one and the next side by side: there, a word falls into segments that
#: don't touch each other again, so every segment contracts its own pairs of least rank in a round.
#: Of these, overlapping ones count from the left; and none counts behind one whose product has a lower rank with
#: its neighbours, which would come first. So the result is that of one leftmost pair of least rank after the other.
ENCODE = """
WITH RECURSIVE tokens(pos, id, cut, fixed) AS (
  SELECT pos, byte_ids.id, cut, false FROM bytes_of_words JOIN byte_ids USING (byte)
  UNION ALL
  (WITH beside AS (
     SELECT pos, id, cut, lag(id) OVER place AS back_id, lead(id) OVER place AS next_id, lead(id, 2) OVER place AS ahead_id, lead(cut) OVER place AS next_cut,
            row_number() OVER place AS n, coalesce(sum(CAST(cut AS INTEGER)) OVER (place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment
     FROM tokens WHERE NOT fixed WINDOW place AS (ORDER BY pos)),
   ranked AS (SELECT b.*, m.rank, m.l IS NULL AS apart FROM beside b LEFT JOIN pairs m ON m.l = CASE WHEN NOT b.cut THEN b.id END AND m.r = b.next_id),
   best AS (SELECT segment, min(rank) AS rank FROM ranked GROUP BY segment),
   least AS (SELECT r.n, segment, r.rank, r.back_id, r.ahead_id, r.n - row_number() OVER (ORDER BY r.n) AS run FROM ranked r JOIN best b USING (segment) WHERE r.rank = b.rank),
   in_run AS (SELECT *, n - min(n) OVER (PARTITION BY run) AS nth FROM least),
   picked AS (SELECT * FROM in_run WHERE nth % 2 = 0),
   stops AS (
     SELECT segment, min(n) AS n FROM picked
     WHERE EXISTS (FROM lower_back l WHERE l.id = picked.rank AND l.other = CASE WHEN nth > 0 THEN picked.rank ELSE back_id END)
        OR EXISTS (FROM lower_ahead l WHERE l.id = picked.rank AND l.other = ahead_id)
     GROUP BY segment),
   taken AS (SELECT p.n, p.rank FROM picked p LEFT JOIN stops s USING (segment) WHERE p.n <= coalesce(s.n, p.n))
   SELECT r.pos, coalesce(t.rank, r.id), CASE WHEN t.n IS NULL THEN r.apart ELSE r.next_cut END, b.rank IS NULL
   FROM ranked r JOIN best b USING (segment) LEFT JOIN taken t USING (n) WHERE NOT EXISTS (FROM taken WHERE taken.n + 1 = r.n)))
SELECT pos, id FROM tokens WHERE fixed ORDER BY pos
"""

DECODE = """
SELECT w, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM word_tokens JOIN vocabulary USING (id) GROUP BY w
"""


class Ranks:
    """A rank file, and every pair of tokens that stand side by side in a token, with the rank of the token that they are, if any."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.id_of = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.key = hashlib.sha256(repr(sorted(self.id_of.items())).encode()).hexdigest()
        if len(self.id_of) > MAX_RANKS:
            raise ValueError(f"{len(self.id_of)} ranks; at most {MAX_RANKS} are sent to executors")
        known = self.id_of.get
        rank: dict[tuple[int, int], int | None] = {}
        for token in self.id_of:
            for i in range(1, len(token)):
                left = [n for a in range(i) if (n := known(token[a:i])) is not None]
                right = [n for b in range(i + 1, len(token) + 1) if (n := known(token[i:b])) is not None]
                rank |= dict.fromkeys(((x, y) for x in left for y in right), None)
        for token, n in self.id_of.items():
            for i in range(1, len(token)):
                pair = known(token[:i]), known(token[i:])
                if None not in pair:
                    rank[pair] = n
        self.pairs = pa.table({"l": pa.array([x for x, _ in rank], pa.int32()), "r": pa.array([y for _, y in rank], pa.int32()), "rank": pa.array(rank.values(), pa.int32())})
        #: A bit for each three bytes: whether a token holds them; and the pairs of bytes that are tokens.
        held = {int.from_bytes(t[i : i + 3], "big") for t in self.id_of for i in range(len(t) - 2)}
        bits = np.zeros(1 << 24, dtype=bool)
        bits[list(held)] = True
        self.three = np.packbits(bits, bitorder="little")
        self.two = np.zeros(1 << 16, dtype=bool)
        self.two[[int.from_bytes(t, "big") for t in self.id_of if len(t) == 2]] = True
        # Tokens that are one of a pair of lower rank than their own: (id, other) with the other in front, or behind.
        self.lower_back = _pairs_of([(y, x) for (x, y), n in rank.items() if n is not None and n < y])
        self.lower_ahead = _pairs_of([(x, y) for (x, y), n in rank.items() if n is not None and n < x])


def cuts(data: np.ndarray, ends: np.ndarray, ranks: Ranks) -> np.ndarray:
    """Where segments of words end: at the words' own ends, and between bytes that no token holds side by side with those around them."""
    n = len(data)
    cut = np.zeros(n, dtype=bool)
    if n > 1:
        x = data.astype(np.int64)
        pair = x[:-1] << 8 | x[1:]
        alive = ranks.two[pair]
        if n > 2:
            three = pair[:-1] << 8 | x[2:]
            held = (ranks.three[three >> 3] >> (three & 7).astype(np.uint8) & 1).astype(bool)
            alive[:-1] |= held
            alive[1:] |= held
        cut[:-1] = ~alive
    cut[ends - 1] = True
    return cut


def _pairs_of(rows: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"id": pa.array([x for x, _ in rows], pa.int32()), "other": pa.array([y for _, y in rows], pa.int32())})


_LAST: dict[tuple[str, str], Encoder] = {}


def encoder_of(ranks: Ranks, pattern: str) -> Encoder:
    """The worker process's encoder: the next task of the same ranks and pattern goes on with its words."""
    key = (ranks.key, pattern)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Encoder(ranks, pattern)
    return _LAST[key]


class Encoder:
    """A worker process's DuckDB connection, and the words that it has encoded."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.id_of, self.bytes_of = ranks, ranks.id_of, {n: t for t, n in ranks.id_of.items()}
        # White space is the Unicode property, as in the library's regular expressions.
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.words: dict[str, tuple[int, str, bytes]] = {}
        # Spills, which a very long word may need, are the worker's own and go with it.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": f"{tempfile.gettempdir()}/factgrid-bpe-{os.getpid()}"})
        vocabulary = pa.table({"id": pa.array(self.bytes_of, pa.int32()), "hex": [t.hex() for t in self.bytes_of.values()]})
        single = [(b, self.id_of[bytes([b])]) for b in range(256) if bytes([b]) in self.id_of]
        byte_ids = pa.table({"byte": pa.array([b for b, _ in single], pa.uint8()), "id": pa.array([n for _, n in single], pa.int32())})
        for name in ("pairs", "lower_back", "lower_ahead", "vocabulary", "byte_ids"):
            self.db.register("source", {"vocabulary": vocabulary, "byte_ids": byte_ids}.get(name) or getattr(ranks, name))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM source")
            self.db.unregister("source")

    def learn(self, words: list[str]) -> None:
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = [self.id_of.get(b) for b in coded]
        # A word that is a token itself is that token, whatever its merges come to.
        rest = [i for i, n in enumerate(whole) if n is None]
        single = [i for i, n in enumerate(whole) if n is not None]
        w, ids = np.array(single, dtype=np.int32), np.array([whole[i] for i in single], dtype=np.int32)
        pos = np.zeros(len(w), dtype=np.int64)
        if rest:
            ends = np.cumsum([len(coded[i]) for i in rest])
            data = np.frombuffer(b"".join(coded[i] for i in rest), dtype=np.uint8)
            # Segments that words share are contracted once.
            stops = np.nonzero(cuts(data, ends, self.ranks))[0] + 1
            raw, bounds = data.tobytes(), [0, *stops.tolist()]
            segments: dict[bytes, int] = {}
            of_segment = np.array([segments.setdefault(raw[a:b], len(segments)) for a, b in zip(bounds, bounds[1:], strict=False)])
            found, starts = self._contract(list(segments))
            each = np.diff(starts)[of_segment]
            token = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[of_segment], each)
            of_word = np.repeat(np.array(rest, dtype=np.int32)[np.searchsorted(ends, stops)], each)
            w, ids, pos = np.concatenate([w, of_word]), np.concatenate([ids, found[token]]), np.concatenate([pos, np.arange(len(token))])
        self.db.register("word_tokens", pa.table({"w": w, "pos": pos, "id": ids}))
        out = self.db.sql(DECODE).to_arrow_table()
        for i, n, ids, raw in zip(*(c.to_pylist() for c in out.columns), strict=True):
            self.words[words[i]] = n, ids, raw

    def _contract(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one behind the other, and where each begins, with the end."""
        ends = np.cumsum([len(x) for x in segments])
        cut = np.zeros(ends[-1], dtype=bool)
        cut[ends - 1] = True
        self.db.register("bytes_of_words", pa.table({"pos": np.arange(ends[-1]), "byte": np.frombuffer(b"".join(segments), dtype=np.uint8), "cut": cut}))
        found = self.db.sql(ENCODE).to_arrow_table()
        at, ids = (found.column(i).to_numpy() for i in range(2))
        return ids, np.concatenate([[0], np.searchsorted(at, ends)])

    def encode(self, texts: list[str | None]) -> list[list[tuple[int, str, bytes]]]:
        """For each text, its words as (number of ids, ids joined by commas, decoded bytes)."""
        out: list[list[tuple[int, str, bytes]]] = []
        start = 0
        while start < len(texts):
            split, new, size = [], {}, 0
            for text in texts[start:]:  # as many texts as bring new words for one query
                split.append(self.find(text) if text else [])
                new |= dict.fromkeys(w for w in split[-1] if w not in self.words)
                size += len(split[-1])
                if len(new) >= QUERY_WORDS or size > 2_000_000:
                    break
            part, held = [], 0
            for word in new:
                part.append(word)
                held += len(word)
                if len(part) == QUERY_WORDS or held > QUERY_BYTES:
                    self.learn(part)
                    part, held = [], 0
            if part:
                self.learn(part)
            get = self.words.__getitem__
            out += [list(map(get, words)) for words in split]
            start += len(split)
            if len(self.words) > CACHED_WORDS:
                self.words.clear()
        return out


def byte_bpe(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", finish: Callable[[list], dict] | None = None, schema: str | None = None
) -> DataFrame:
    """Encodes every whole text and decodes the ids again: id_col, ids (array of int), decoded (binary).

    Each match of pattern is one word, of any length. In every task, DuckDB joins token-position rows
    to the merge table and contracts what comes to each word's leftmost pair of least rank until none is left; an
    ordered aggregation decodes. Words are encoded once while the worker process remembers them. finish and schema may
    replace the two result columns; finish gets a text's words as (number, ids, bytes).

    Null and empty texts: no ids, no bytes. Repeated rows and null ids are kept, an empty table
    gives an empty one, other columns are not read. No shuffle.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(ranks_path))
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    finish = finish or (lambda words: {"ids": [int(n) for x in words for n in x[1].split(",")], "decoded": b"".join(x[2] for x in words)})

    def start():
        encoder = encoder_of(ranks.value, pattern)

        def step(rows: dict) -> dict:
            done = [finish(words) for words in encoder.encode(rows["t"])]
            return {id_col: rows["i"]} | {c: [d[c] for d in done] for c in done[0]}

        return step

    frame = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    return map_rows(frame, start, f"`{id_col}` {id_type}, {schema or 'ids array<int>, decoded binary'}")


def digests(words: list[tuple[int, str, bytes]]) -> dict:
    """Number of ids, and SHA-256 of the decimal ids joined by commas and of the decoded bytes."""
    return {
        "n_tokens": sum(x[0] for x in words),
        "ids_sha256": hashlib.sha256(",".join([x[1] for x in words]).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(b"".join([x[2] for x in words])).hexdigest(),
    }
