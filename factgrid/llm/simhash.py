"""SimHash near-duplicates: fingerprints of word shingles, compared bit-sliced inside blocks."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgrid.plans.ship import ship_package

from .common import free_prefix, map_rows, materialize
from .components import connected_components, in_blocks, whole_groups
from .hot_keys import join_counted, join_salted

BITS = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)
#: Words of 64 bits of a wide fingerprint; least bits of a key that are drawn from it.
WIDE, KEY_BITS = 4, 14
#: Chance that a pair right at the similarity is no candidate; the number of a text's keys follows from it.
MISS = 0.01
#: Rows of a bucket that are compared in one block; larger buckets are dealt into such parts.
BLOCK_ROWS = 32_768
#: The same where the texts' shingle sets go along.
VERIFY_ROWS = 1024
#: Buckets of more rows on the average get longer keys.
FULL_BUCKET = 256
#: Groups of up to so many rows are compared in one sweep over many groups.
SMALL_GROUP = 512
#: Pairs of a query and a word of 64 lanes that are compared at once.
SWEEP = 1 << 18


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; of its whole sequence if it has fewer words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six white-space bytes
    if len(parts) < words:
        shingles, n = iter([b" ".join(parts)] if parts else []), min(1, len(parts))
    else:
        shingles, n = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)), len(parts) - words + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in shingles), dtype="<u8", count=n)


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 of the shingles (repeats count); 0 without words."""
    return _majority(shingle_hashes(text, words, seed))


def wide_fingerprint(text: str | None, words: int, seed: int) -> list[int]:
    """WIDE fingerprints of 64 bits of the distinct shingles, of hashes that are mixed anew from the same XXH64."""
    return _wide(np.unique(shingle_hashes(text, words, seed)))


def _wide(h: np.ndarray) -> list[int]:
    out = [_majority(h)]
    for j in range(1, WIDE):
        with np.errstate(over="ignore"):  # a finaliser of multiplications and shifts, by Stafford
            x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(x ^ (x >> np.uint64(31))) if len(h) else 0)
    return out


def _planes(fps: np.ndarray, slot: np.ndarray, n_words: int) -> np.ndarray:
    """Bit planes: plane b, word w holds bit b of the 64 fingerprints in the lanes of w. fps: rows x words of 64 bits."""
    out = np.empty((BITS * fps.shape[1], n_words), dtype=np.uint64)
    lanes = np.zeros(n_words * 64, dtype=np.uint8)
    for b in range(len(out)):
        lanes[slot] = (fps[:, b // BITS] >> np.uint64(b % BITS)) & ONE
        out[b] = np.packbits(lanes, bitorder="little").view("<u8")
    return out


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is above radius."""
    above, same = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for bit in range(len(counters) - 1, -1, -1):
        if radius >> bit & 1:
            same = same & counters[bit]
        else:
            above = above | (same & counters[bit])
            same = same & ~counters[bit]
    return above


def _within(planes: np.ndarray, query: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a query fingerprint and a word: (pairs with a lane within radius, those lanes).

    Differences are counted for 64 lanes at a time: three planes at once go through a carry-save
    adder into vertical counters. Pairs in which every lane exceeds the radius are abandoned.
    """
    at = np.arange(len(query))
    counters = [np.zeros(len(query), dtype=np.uint64) for _ in range(max(3, radius.bit_length()))]
    over = ~valid
    zero = np.uint64(0)
    for first in range(0, len(planes), 3):
        x = [planes[b][word] ^ (zero - ((query[:, b // BITS] >> np.uint64(b % BITS)) & ONE)) for b in range(first, min(first + 3, len(planes)))]
        x += [np.zeros_like(over)] * (3 - len(x))
        half = x[0] ^ x[1]
        ones, twos = half ^ x[2], (x[0] & x[1]) | (half & x[2])
        carry = counters[0] & ones
        counters[0] = counters[0] ^ ones
        half = counters[1] ^ carry
        carry = (counters[1] & carry) | (half & twos)
        counters[1] = half ^ twos
        for bit in range(2, len(counters)):
            carry, counters[bit] = counters[bit] & carry, counters[bit] ^ carry
        over = over | carry | _exceeds(counters, radius)
        if first % 6 == 0:
            alive = over != ALL
            if np.count_nonzero(alive) < 0.7 * len(alive):
                at, query, word, over, *counters = (v[alive] for v in (at, query, word, over, *counters))
                if not len(at):
                    break
    alive = over != ALL
    return at[alive], ~over[alive]


def _lanes(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, lane) of each set bit."""
    on = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.nonzero(on)


class Forest:
    """Union-find; the root is the smallest row."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> bool:
        """Whether they were apart."""
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


def near_forest(fps: np.ndarray, starts: np.ndarray, radius: int, pairs_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root row) that connect what lies within radius inside each group; at most one per row.

    fps: rows of all groups, one behind the other, x words of 64 bits; starts: each group's first row, and the end.
    With pairs_only, links are pairs that lie within radius themselves, still fewer than rows.
    """
    fps = fps.reshape(len(fps), -1)
    joined: list[tuple[int, int]] = []
    sizes = np.diff(starts)
    n_words = -(-sizes // 64)
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(len(fps)) - starts[group]
    slot = first_word[group] * 64 + lane
    row_of_slot = np.full(first_word[-1] * 64, -1, dtype=np.int64)
    row_of_slot[slot] = np.arange(len(fps))
    planes = _planes(fps, slot, int(first_word[-1]))
    full = np.packbits(row_of_slot >= 0, bitorder="little").view("<u8")
    forest = Forest(len(fps))

    def pairs(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each row with the words of its group from its own on; lanes up to its own are not valid."""
        own = slot[rows] // 64
        count = first_word[group[rows] + 1] - own
        ends = np.cumsum(count)
        at = 0
        while at < len(rows):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + SWEEP, side="right")))
            k = count[at:to]
            r = np.repeat(rows[at:to], k)
            w = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(own[at:to], k)
            bit = (slot[r] % 64).astype(np.uint64)
            later = np.where(w == slot[r] // 64, (ALL << bit) ^ (ONE << bit), ALL)
            yield r, w, full[w] & later
            at = to

    def link(r: np.ndarray, w: np.ndarray, bits: np.ndarray) -> None:
        i, b = _lanes(bits)
        for x, y in zip(r[i].tolist(), row_of_slot[w[i] * 64 + b].tolist(), strict=True):
            if forest.union(x, y) and pairs_only:
                joined.append((y, x))

    small = sizes <= SMALL_GROUP
    for r, w, valid in pairs(np.nonzero(small[group])[0]):
        at, bits = _within(planes, fps[r], w, valid, radius)
        link(r[at], w[at], bits)
    # In a large group, a batch of rows is merged first within itself; then rows of one component
    # share one row of hits, so that a group of copies doesn't list its pairs.
    for g in np.nonzero(~small)[0]:
        for s in range(int(starts[g]), int(starts[g + 1]), 1024):
            rows = np.arange(s, min(s + 1024, int(starts[g + 1])))
            found = []
            for r, w, valid in pairs(rows):
                at, bits = _within(planes, fps[r], w, valid, radius)
                found.append((r[at], w[at], bits))
            r, w, bits = (np.concatenate(x) for x in zip(*found, strict=True))
            inside = w <= slot[rows[-1]] // 64
            for keep in (inside, ~inside):
                if keep.any():
                    if pairs_only:
                        link(r[keep], w[keep], bits[keep])
                        continue
                    root = np.array([forest.find(x) for x in r[keep].tolist()])
                    order = np.lexsort((w[keep], root))
                    root, ws, bs = root[order], w[keep][order], bits[keep][order]
                    new = np.nonzero(np.concatenate([[True], (root[1:] != root[:-1]) | (ws[1:] != ws[:-1])]))[0]
                    link(root[new], ws[new], np.bitwise_or.reduceat(bs, new))
    if pairs_only:
        return tuple(np.array(x, dtype=np.int64) for x in zip(*joined, strict=True)) if joined else (np.zeros(0, np.int64),) * 2
    parent = np.array([forest.find(i) for i in range(len(fps))], dtype=np.int64)
    child = np.nonzero(parent != np.arange(len(fps)))[0]
    return child, parent[child]


def _compare(radius: int, n_words: int = 1):
    """Links of whole groups of rows (four key columns, fingerprint words, and for wide ones the node)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 4, 50_000 // n_words):
            columns = [c.to_numpy().astype(np.int64, copy=False) for c in table.columns[4:]]
            fps = np.column_stack(columns[:n_words]).view(np.uint64)
            child, root = near_forest(fps, starts, radius, n_words > 1)
            yield pa.RecordBatch.from_arrays([pa.array(columns[-1][child]), pa.array(columns[-1][root])], schema=schema)

    return run


def near_pairs(fps: np.ndarray, label: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of rows (x, y), x < y, within radius and of different labels, in the order of x, a part at a time."""
    n = len(fps)
    step = max(1, (SWEEP << 2) // n)
    for at in range(0, n, step):
        rows = slice(at, min(at + step, n))
        apart = sum(np.bitwise_count(fps[rows, None, k] ^ fps[None, at:, k]).astype(np.uint16) for k in range(fps.shape[1]))
        x, y = np.nonzero((apart <= radius) & (label[rows, None] != label[None, at:]))
        later = x < y
        yield x[later] + at, y[later] + at


def _apart(radius: int, n_words: int, chosen: np.ndarray):
    """Of whole groups of rows (four key columns, fingerprint words, node, label), those that lie within radius of one of another label.

    A pair is left to the first key that both have in common.
    """
    names = ["band", "key", "part_a", "part_b", *(f"f{i}" for i in range(n_words)), "node", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 4, 50_000 // n_words):
            columns = [c.to_numpy().astype(np.int64, copy=False) for c in table.columns]
            fps, label, band = np.column_stack(columns[4 : 4 + n_words]).view(np.uint64), columns[-1], columns[0]
            wanted = np.zeros(len(label), dtype=bool)
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                for x, y in near_pairs(fps[lo:hi], label[lo:hi], radius):
                    for at in range(0, len(x), 65_536):
                        a, b = x[at : at + 65_536] + lo, y[at : at + 65_536] + lo
                        differ = np.unpackbits((fps[a] ^ fps[b]).view(np.uint8), axis=1, bitorder="little").view(bool)
                        first = np.ones(len(a), dtype=bool)
                        for bits in chosen[: band[lo]]:
                            first &= differ[:, bits].any(axis=1)
                        wanted[a[first]] = wanted[b[first]] = True
            yield pa.RecordBatch.from_arrays([table.column(i).combine_chunks().filter(pa.array(wanted)) for i in range(len(names))], names=names)

    return run


def verified_links(fps: np.ndarray, label: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs (x, y) of rows within radius whose sets are `similarity` alike, so many that all such pairs are connected; labels are so already.

    A pair is passed over only if its rows are connected, never because another pair failed.
    """
    size = np.array([len(h) for h in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.concatenate([[0], np.cumsum(size)])
    held = np.zeros(len(codes), dtype=bool)
    forest, first = Forest(len(fps)), {}
    for i, v in enumerate(label.tolist()):
        forest.union(i, first.setdefault(v, i))
    links = []
    for xs, ys in near_pairs(fps, label, radius):
        similar_size = np.minimum(size[xs], size[ys]) >= similarity * np.maximum(size[xs], size[ys])
        xs, ys = xs[similar_size], ys[similar_size]
        cuts = np.nonzero(np.diff(xs))[0] + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(xs)], strict=True):
            if lo == hi:
                continue
            x = int(xs[lo])
            root = forest.find(x)
            others = [y for y in ys[lo:hi].tolist() if forest.find(y) != root]
            if not others:
                continue
            held[codes[ends[x] : ends[x + 1]]] = True
            common = np.array([np.count_nonzero(held[codes[ends[y] : ends[y + 1]]]) for y in others])
            held[codes[ends[x] : ends[x + 1]]] = False
            total = size[x] + size[others] - common
            links += [(x, y) for y, c, t in zip(others, common.tolist(), total.tolist(), strict=True) if (c / t if t else 1.0) >= similarity and forest.union(x, y)]
    return links


def _verify(radius: int, n_words: int, similarity: float):
    """verified_links of whole groups of rows (four key columns, fingerprint words, node, label, set), as pairs of labels."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 4, VERIFY_ROWS):
            columns = [c.to_numpy().astype(np.int64, copy=False) for c in table.columns[4:-1]]
            fps, label = np.column_stack(columns[:n_words]).view(np.uint64), columns[-1]
            sets = table.column(table.num_columns - 1)
            a, b = [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = [x.values.to_numpy() for x in sets.slice(lo, hi - lo)]
                for x, y in verified_links(fps[lo:hi], label[lo:hi], own, radius, similarity):
                    a.append(label[lo + x])
                    b.append(label[lo + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _miss(similarity: float, bits: int, keys: int) -> float:
    """Chance that a pair at a Jaccard similarity lies beyond _radius_of it or shares none of `keys` keys of drawn bits."""
    n, p = WIDE * BITS, _differ(similarity)
    found = 0.0
    for d in range(_radius_of(similarity) + 1):
        found += math.comb(n, d) * p**d * (1 - p) ** (n - d) * (1 - (1 - math.comb(n - d, bits) / math.comb(n, bits)) ** keys)
    return 1 - found


def _keys_for(similarity: float, bits: int) -> int:
    """The least number of keys with which a pair at the similarity is missed with a chance of MISS."""
    high = 1
    while _miss(similarity, bits, high) > MISS:
        high *= 2
    return bisect_left(range(high), -MISS, lo=1, key=lambda k: -_miss(similarity, bits, k))


def _chosen(bits: int, keys: int) -> np.ndarray:
    draw = np.random.default_rng(11)
    return np.stack([draw.choice(WIDE * BITS, bits, replace=False) for _ in range(keys)])


def _drawn_keys(chosen: np.ndarray):
    """Rows that begin with a wide fingerprint to one for each row of chosen bits, with the number of a key and the key."""
    keys, bits = chosen.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, 96_000 // keys)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                columns = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                on = np.unpackbits(np.column_stack(columns[:WIDE]).view(np.uint8), axis=1, bitorder="little")
                key = on[:, chosen].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                arrays = [pa.array(np.repeat(c, keys)) for c in columns] + [pa.array(np.tile(np.arange(keys, dtype=np.int32), part.num_rows)), pa.array(key.ravel())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, "band", "key"])

    return run


def _bands(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """Keys of which two fingerprints within radius share at least one: lists of (shift, bits) to put together.

    The bits are cut into `blocks`; radius differing bits leave blocks - radius of them alike.
    """
    blocks = radius + 1
    while blocks < radius + 4 and n > FULL_BUCKET << (BITS * (blocks - radius) // blocks):
        blocks += 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    cuts = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    return [list(c) for c in combinations(cuts, blocks - radius)]


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """Fingerprint and component of every whole text: id_col, fingerprint (16 hex digits), component_id.

    Texts are lower-cased (A-Z) and cut at `[\\x20\\x09-\\x0D]`; texts with fewer words than a
    shingle have one of all their words, those with none the fingerprint zero, linked like any
    other. Fingerprints link at radius or fewer differing bits; component_id is the smallest id
    reachable. Exact: blocks follow from the pigeonhole principle, equal fingerprints are one
    class first, and hot buckets are dealt into blocks. Null ids get a null component unless
    other ids share it. Repeated rows are kept. Other columns are not read.
    """
    if not 0 <= radius <= 6:
        raise ValueError("radius must be from 0 to 6")
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def start():
        def step(rows: dict) -> dict:
            fps = [fingerprint(t, words, seed) for t in rows["t"]]
            return {"id": rows["i"], "fp": [x - (1 << 64) if x >> 63 else x for x in fps]}

        return step

    prints = materialize(map_rows(docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")), start, f"id {id_type}, fp long"))
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    bands = _bands(classes.count(), radius)

    def key(cuts: list[tuple[int, int]]):
        value = F.lit(0).cast("long")
        for shift, bits in cuts:
            value = F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1)))
        return value

    rows = classes.select("fp", F.posexplode(F.array(*[key(b) for b in bands])).alias("band", "key"))
    blocks = in_blocks(rows, ["band", "key"], "fp", BLOCK_ROWS, alone_too=True).select("band", "key", "part_a", "part_b", "fp")
    keys = ["band", "key", "part_a", "part_b"]
    links = blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(radius), "a long, b long")
    components = connected_components(links)
    of_class = classes.join(components, classes["fp"] == components["node"], "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(of_class.join(smallest, "component").select("fp", "n", "component_id"))
    return join_counted(prints, named, ["fp"], "n").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _differ(similarity: float) -> float:
    """Chance that a bit differs at a Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def _radius_of(similarity: float, spread: float = 3.0) -> int:
    """Differing bits of wide fingerprints at a Jaccard similarity, and so many standard deviations more."""
    n, p = WIDE * BITS, _differ(similarity)
    return math.ceil(n * p + spread * math.sqrt(n * p * (1 - p)))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5, seed: int = 42) -> DataFrame:
    """Components of texts whose sets of word shingles are `similarity` alike (Jaccard): id_col, component_id.

    Wide fingerprints find the candidates: texts that agree in any of their keys, each of KEY_BITS drawn bits or
    more for many texts (and then more keys, so that MISS holds at any size), are compared bit-sliced within a radius that similar texts rarely exceed.
    Each bucket sends out pairs that connect what is near in it, fewer than its rows, and each
    such pair's shingles are compared exactly. A pair that fails may have stood for others: all pairs of candidates
    between the two groups, and any other groups that such pairs touch, are compared in a second round.

    Texts of one shingle set (by a hash of 128 bits) are one class, as are texts without words. Ids are integers; rows of equal ids are one node, rows
    of null ids are left alone with a null component. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    names, same = [f"f{i}" for i in range(WIDE)], ["s0", "s1"]

    def start():
        def step(rows: dict) -> dict:
            hashes = [np.unique(shingle_hashes(t, words, seed)) for t in rows["t"]]
            prints = [[x - (1 << 64) if x >> 63 else x for x in _wide(h)] for h in hashes]
            of_set = [np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype="<i8").tolist() for h in hashes]
            return {"id": rows["i"]} | {n: [p[k] for p in prints] for k, n in enumerate(names)} | {n: [d[k] for d in of_set] for k, n in enumerate(same)}

        return step

    frame = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t"))
    prints = materialize(map_rows(frame, start, "id long, " + ", ".join(f"{n} long" for n in names + same)))
    classes = materialize(prints.filter("id IS NOT NULL").groupBy(*names, *same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    bits = KEY_BITS + max(0, (classes.count() // (2048 << KEY_BITS)).bit_length())
    chosen = _chosen(bits, _keys_for(similarity, bits))
    keys = ["band", "key", "part_a", "part_b"]
    rows = classes.select(*names, "rep").mapInArrow(_drawn_keys(chosen), ", ".join(f"{n} long" for n in names) + ", rep long, band int, key long")
    # Another order in each band, so that a group is connected by other pairs there.
    blocks = in_blocks(rows, ["band", "key"], "rep", BLOCK_ROWS, alone_too=True).withColumn("order", F.xxhash64("band", "rep"))
    sorted_blocks = blocks.select(*keys, *names, "rep", "order").repartition(*keys).sortWithinPartitions(*keys, "order").drop("order")
    near = sorted_blocks.mapInArrow(_compare(_radius_of(similarity), WIDE), "a long, b long")
    pairs = materialize(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())

    # The exact check: distinct shingles of the texts that have a candidate, beside those of its partner.
    involved = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def shingles():
        def step(rows: dict) -> dict:
            return {"id": rows["i"], "h": [np.unique(shingle_hashes(t, words, seed)).view(np.int64).tolist() for t in rows["t"]]}

        return step

    texts = frame.join(involved, F.col("i") == F.col("id"), "left_semi").groupBy("i").agg(F.max("t").alias("t"))
    sets = materialize(map_rows(texts, shingles, "id long, h array<long>"))
    both = join_salted(pairs, sets.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a", "b", pairs)
    both = join_salted(both, sets.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b", "a", pairs)
    common = F.size(F.array_intersect("ha", "hb"))
    links = materialize(both.filter(F.coalesce(common / (F.size("ha") + F.size("hb") - common), F.lit(1.0)) >= similarity).select("a", "b"))
    label = connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    labelled = materialize(classes.select("rep").distinct().join(label, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label")))

    # A pair that fails may have stood for others of its bucket: near texts of two labels are connected there by pairs, some of which
    # lead out of either label. So every pair within the radius between labels that such pairs touch is compared too,
    # inside its bucket, so that no list of pairs is sent.
    def labels_of(node: str) -> DataFrame:
        return labelled.select(F.col("rep").alias(node), F.col("label").alias(f"{node}_label"))

    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("of_label"))
    both = join_salted(join_salted(pairs, labels_of("a"), "a", "b", pairs), labels_of("b"), "b", "a", pairs).filter("a_label <> b_label")
    touched = materialize(both.select(F.explode(F.array("a_label", "b_label")).alias("label")).distinct().join(sizes, "label"))
    loose = classes.join(join_counted(labelled, touched, ["label"], "of_label"), "rep").select(*names, "rep", "label")
    rows = loose.mapInArrow(_drawn_keys(chosen), ", ".join(f"{n} long" for n in names) + ", rep long, label long, band int, key long")
    blocks = in_blocks(rows, ["band", "key"], "rep", VERIFY_ROWS).select(*keys, *names, F.col("rep").alias("node"), "label")
    form = "band int, key long, part_a int, part_b int, " + ", ".join(f"{n} long" for n in names) + ", node long, label long"
    near = blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_apart(_radius_of(similarity), WIDE, chosen), form)
    with_sets = materialize(near).join(sets.select(F.col("id").alias("node"), "h"), "node").select(*keys, *names, "node", "label", "h")
    more = with_sets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(_radius_of(similarity), WIDE, similarity), "a long, b long")
    joined = connected_components(materialize(more)).select(F.col("node").alias("label"), "component")
    final = join_counted(labelled, materialize(joined.join(sizes, "label")), ["label"], "of_label", "left")
    of_class = classes.join(final, "rep").select(*same, "n", F.coalesce("component", "label").alias("component_id"))
    found = join_counted(prints, materialize(of_class), same, "n", "left")
    return found.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The row with the smallest id of each component of similar texts, with all columns.

    Repeated rows of that id leave one; rows of null ids all stay. settings: those of similar_components.
    """
    found = similar_components(docs, id_col, text_col, **settings)
    name = free_prefix(docs, "__nd")
    kept = found.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    joined = docs.join(kept, docs[id_col] == kept[name], "left_semi")
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    first = joined.withColumn(name, F.row_number().over(order)).filter(F.col(name) == 1).drop(name)
    return first.unionByName(docs.filter(docs[id_col].isNull()))
