"""Repeated runs of lines: suffix ranks over line ids by distributed prefix doubling; later copies go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgrid.plans.materialize import discard

from .common import free_prefix, map_rows, materialize
from .hot_keys import join_counted


def shortest_windows(words: list[int], least: int) -> list[int]:
    """For each line, how many lines from it on hold `least` words; 0 if the rest of the text holds fewer."""
    out = [0] * len(words)
    total = end = 0
    for start in range(len(words)):
        while total < least and end < len(words):
            total += words[end]
            end += 1
        if total < least:
            break
        out[start] = end - start
        total -= words[start]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(11), text).alias("k2")]


def _ranks(rows: DataFrame) -> DataFrame:
    """(r1, r2, rank, n) of the pairs that rows hold n times, twice or more; rank: how many rows of such pairs sort before.

    The rank of a pair is the place in the suffix array where its interval begins. Counts are added up in each
    range of sorted pairs, then over the ranges.
    """
    schema = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("range", pa.int32())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.column("n").to_numpy()
            upto = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column("r1"), b.column("r2"), pa.array(upto - n), b.column("n"), pa.array(np.full(len(n), at, np.int32))], schema=schema)
            total = int(upto[-1]) if len(n) else total

    pairs = rows.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    in_order = pairs.repartitionByRange("r1", "r2").sortWithinPartitions("r1", "r2")
    summed = materialize(in_order.mapInArrow(add_up, "r1 long, r2 long, own long, n long, range int"))
    # One row for each range, so this window is small however long the text is.
    ranges = summed.groupBy("range").agg(F.sum("n").alias("n"))
    before = ranges.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    ranked = materialize(summed.join(before, "range").select("r1", "r2", (F.col("before") + F.col("own")).alias("rank"), "n"))
    discard(summed)
    return ranked


def _ranked(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Of rows (doc, i, r1, r2), those of repeated pairs, with the pair's rank and the columns to keep."""
    ranks = _ranks(rows)
    out = materialize(join_counted(rows, ranks, ["r1", "r2"], "n").select("doc", "i", "rank", *keep))
    discard(ranks)
    return out


def _doubled(level: DataFrame, k: int) -> DataFrame | None:
    """Ranks of the runs of 2^k lines that are found twice or more, from those of half as many; None without any."""
    right = level.select("doc", (F.col("i") - (1 << (k - 1))).alias("i"), F.col("rank").alias("r2"))
    pairs = materialize(level.select("doc", "i", F.col("rank").alias("r1")).join(right, ["doc", "i"]))
    longer = None if pairs.isEmpty() else _ranked(pairs, [])
    discard(pairs)
    return None if longer is None or longer.isEmpty() else longer


def _name(*parts: Column | str) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *parts).alias(g) for seed, g in ((3, "g1"), (5, "g2"))]


def _extend(rows: DataFrame, level: DataFrame, k: int) -> DataFrame:
    """Intervals refined by the next 2^k lines of their suffixes.

    rows: (g1, g2, doc, i, length, later): the suffix at (doc, i) is in interval (g1, g2), whose suffixes share `length` lines, and
    later tells that another of them begins earlier. The suffixes of an interval whose next 2^k lines are equal, two or more, are an
    interval of their own. All of them move there but the earliest, which is in both: in the old one it
    stands for the others, which agree with it in those lines.
    """
    at = level.select("doc", F.col("i").alias("at"), "rank")
    reached = materialize(rows.withColumn("at", F.col("i") + F.col("length")).join(at, ["doc", "at"], "left").drop("at"))
    inside = ["g1", "g2", "rank"]
    here = F.struct("doc", "i")
    groups = materialize(reached.filter("rank IS NOT NULL").groupBy(*inside).agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # Runs without a rank are in no longer interval; they don't take part in the join.
    found = join_counted(reached.filter("rank IS NOT NULL"), groups, inside, "n", "left")
    is_later = here != F.col("first")
    old = F.struct("g1", "g2", "length", "later")
    new = F.struct(*_name("g1", "g2", "rank", F.lit(k)), (F.col("length") + (1 << k)).alias("length"), is_later.alias("later"))
    into = F.when(F.col("n").isNull(), F.array(old)).when(is_later, F.array(new)).otherwise(F.array(old, new))
    stay = reached.filter("rank IS NULL").select("doc", "i", "g1", "g2", "length", "later")
    out = materialize(stay.unionByName(found.select("doc", "i", F.explode(into).alias("x")).select("doc", "i", "x.*")))
    discard(reached, groups, rows)
    return out


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """What stays of documents with a later copy: id, k1, k2, n_lines, kept array<struct<start, length>>.

    For each line that begins a repeated run of min_words words, the longest common prefix of its suffix with one that begins earlier
    is found: prefix doubling ranks the repeated runs of 2^k lines; two ranks name the interval of the suffix
    array that shares the first min_words words; and from the longest runs to the shortest, each level of ranks refines the intervals.
    """
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    text = F.coalesce(docs[text_col], F.lit(""))

    def start():
        def step(rows: dict) -> dict:
            out: dict[str, list] = {"id": rows["id"], "k1": rows["k1"], "k2": rows["k2"], "words": [], "h1": [], "h2": [], "windows": []}
            for t in rows["t"]:
                lines = [x.encode("utf-8", "surrogatepass") for x in t.split("\n")]
                digests = [xxhash.xxh128_intdigest(x) for x in lines]
                words = [len(x.split()) for x in lines]
                out["words"].append(sum(words))
                out["h1"].append([_signed(d >> 64) for d in digests])
                out["h2"].append([_signed(d & (1 << 64) - 1) for d in digests])
                out["windows"].append(shortest_windows(words, min_words))
            return out

        return step

    schema = f"id {id_type}, k1 long, k2 long, words long, h1 array<long>, h2 array<long>, windows array<int>"
    lines = materialize(map_rows(docs.select(docs[id_col].alias("id"), text.alias("t"), *_text_keys(text)), start, schema))

    # Equal texts are one document, that of the smallest id: a later copy goes whole if it has the words. Documents are numbered in order.
    texts = lines.groupBy("k1", "k2").agg(F.min(F.struct("id"))["id"].alias("rep"), F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("windows").alias("windows"), F.count(F.lit(1)).alias("copies"))
    in_order = texts.repartitionByRange("rep", "k1", "k2").sortWithinPartitions("rep", "k1", "k2")
    texts = materialize(in_order.withColumn("doc", F.monotonically_increasing_id()))
    at = texts.select("doc", F.posexplode(F.arrays_zip("h1", "h2", "windows")).alias("i", "line"))
    at = at.select("doc", "i", F.col("line.h1").alias("r1"), F.col("line.h2").alias("r2"), F.col("line.windows").alias("window"))

    # Prefix doubling: level k ranks the runs of 2^k lines that are found twice or more.
    level = _ranked(at, ["window"])
    starts = level.filter("window > 0")
    longest = starts.agg(F.max("window")).first()[0] or 0
    levels = [level]
    while 1 << len(levels) <= longest and (longer := _doubled(levels[-1], len(levels))) is not None:
        levels.append(longer)

    # A window is an interval of the suffix array: two runs of 2^k lines that overlap or meet name it.
    k = F.floor(F.log2(F.col("window").cast("double")) + 1e-9).cast("int")
    windows = starts.select("doc", "i", "window", k.alias("k")).withColumn("first", F.col("i")).withColumn("second", F.expr("i + window - shiftleft(1, k)"))
    ranked = [x.select("doc", "i", "rank", F.lit(n).alias("k")) for n, x in enumerate(levels)]
    of_level = ranked[0]
    for x in ranked[1:]:
        of_level = of_level.unionByName(x)
    for name in ("first", "second"):
        windows = windows.join(of_level.select("doc", "k", F.col("i").alias(name), F.col("rank").alias(f"{name}_rank")), ["doc", "k", name])
    same = ["window", "first_rank", "second_rank"]
    found = materialize(windows.select("doc", "i", *same))
    here = F.struct("doc", "i")
    earliest = materialize(found.groupBy(*same).agg(F.min(here).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    rows = join_counted(found, earliest, same, "n").select(*_name(*same), "doc", "i", F.col("window").alias("length"), (here != F.col("earliest")).alias("later"))
    rows = materialize(rows)
    discard(found, earliest)

    # Longer runs are of interest in the texts with such windows only.
    if not rows.isEmpty():
        own = rows.select("doc").distinct()
        top = materialize(levels[-1].join(own, "doc", "left_semi").select("doc", "i", "rank"))
        discard(levels[-1])
        levels[-1] = top
        while (longer := _doubled(levels[-1], len(levels))) is not None:
            levels.append(longer)
        for n in range(len(levels) - 1, -1, -1):
            rows = _extend(rows, levels[n], n)
    discard(*levels)
    of_text = rows.filter("later").groupBy("doc").agg(F.collect_set(F.struct("i", "length")).alias("gone"))  # at most a few for each line of one text

    counted = materialize(texts.select("doc", "k1", "k2", "rep", F.size("h1").alias("n_lines"), "copies").join(of_text, "doc", "left").drop("doc"))
    each = join_counted(lines.select("id", "k1", "k2", "words").distinct(), counted, ["k1", "k2"], "copies")
    copy = ~F.col("id").eqNullSafe(F.col("rep")) & (F.col("words") >= min_words)
    each = each.filter(copy | F.col("gone").isNotNull())
    whole = F.array(F.struct(F.lit(0).alias("i"), F.col("n_lines").alias("length")))

    def complement():
        def step(rows: dict) -> dict:
            kept = []
            for n, gone in zip(rows["n_lines"], rows["gone"], strict=True):
                own, at = [], 0
                for i, length in sorted((g["i"], g["length"]) for g in gone):
                    if i > at:
                        own.append({"start": at, "length": i - at})
                    at = max(at, i + length)
                kept.append(own + ([{"start": at, "length": n - at}] if at < n else []))
            return {c: rows[c] for c in ("id", "k1", "k2")} | {"n_lines": rows["n_lines"], "kept": kept}

        return step

    chosen = each.select("id", "k1", "k2", "n_lines", F.when(copy, whole).otherwise(F.col("gone")).alias("gone"))
    out = materialize(map_rows(chosen, complement, f"id {id_type}, k1 long, k2 long, n_lines int, kept array<struct<start int, length int>>"))
    discard(rows, lines, texts, counted)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, counts: tuple[str, str] | None = None) -> DataFrame:
    """Docs with later copies of repeated line runs deleted; all columns stay, text_col is replaced.

    A run of whole lines of one text goes if it has min_words words or more (by `[\\x20\\x09-\\x0D]`)
    and an equal run begins earlier, by (id, line), also within one text and also overlapping. Runs
    that are found once, and the first copy, stay. counts may name two columns to add: the
    lines before, and those deleted.

    Texts left without a line become empty; rows are never dropped. Null texts stay null and are
    compared as empty. Null ids come first. Rows of equal id and text are one document and
    are treated alike. An empty table gives an empty one.
    """
    own = free_prefix(docs, "__ld")
    found = repeated_runs(docs, id_col, text_col, min_words).select(
        F.col("id").alias(f"{own}_id"), F.col("k1").alias(f"{own}_k1"), F.col("k2").alias(f"{own}_k2"), F.col("n_lines").alias(f"{own}_n"), F.col("kept").alias(f"{own}_kept")
    )
    text = F.coalesce(docs[text_col], F.lit(""))
    k1, k2 = _text_keys(text)
    joined = docs.withColumn(f"{own}_1", k1).withColumn(f"{own}_2", k2)
    # Never broadcast: what is found grows with the documents. Texts are not sorted by a hash join.
    joined = joined.join(
        found.hint("shuffle_hash"), joined[id_col].eqNullSafe(F.col(f"{own}_id")) & (F.col(f"{own}_1") == F.col(f"{own}_k1")) & (F.col(f"{own}_2") == F.col(f"{own}_k2")), "left"
    )
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    kept = F.flatten(F.transform(f"{own}_kept", lambda x: F.slice(lines, x["start"] + 1, x["length"])))
    replaced = F.when(F.col(f"{own}_kept").isNull() | F.col(f"`{text_col}`").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    out = [replaced.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n = F.coalesce(F.col(f"{own}_n").cast("long"), F.size(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n")).cast("long"))
        left = F.coalesce(F.aggregate(f"{own}_kept", F.lit(0).cast("long"), lambda a, x: a + x["length"]), n)
        out += [n.alias(counts[0]), (n - left).alias(counts[1])]
    return joined.select(*out)
