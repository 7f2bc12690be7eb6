"""Shards of near equal bytes, as the leaves of a k-d tree over document metadata."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .hot_keys import join_counted

#: Bits of a dimension's ordinal, and of the hash that orders groups of one ordinal.
ORDINAL_BITS, TIE_BITS = 10, 20
#: Bytes that a row weighs besides its text.
ROW_BYTES = 8
#: Rows that share one task when slots are numbered.
SLOT_ROWS = 50_000


@dataclass(frozen=True)
class Node:
    """A subtree that still holds shards first to first + shards - 1."""

    first: int
    shards: int


def _ordinal_of_size(size: Column) -> Column:
    top = (1 << ORDINAL_BITS) - 1
    return F.least(F.lit(top), F.floor(F.log2(size.cast("double")) * 32)).cast("int")


def _ordinal_of_category(value: Column) -> Column:
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value.cast("string")), F.lit(1 << ORDINAL_BITS))).cast("int")


def _split(groups: DataFrame, nodes: list[Node], dims: list[str]) -> tuple[DataFrame, list[Node]]:
    """Splits every node with two or more shards once, at the weighted quantile that its shards ask for."""
    spark = groups.sparkSession
    open_nodes = [n for n in nodes if n.shards > 1]
    shards = {n.first: n.shards for n in open_nodes}
    inside = groups.join(_small(spark, [(n.first,) for n in open_nodes], "node int"), "node", "left_semi")

    # The box of each node: its widest dimension is split, the hash alone where all ordinals agree.
    boxes = inside.groupBy("node").agg(
        F.sum("w").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in dims], (F.max("tie") - F.min("tie")).alias("tie")
    )
    state: dict[int, list] = {}  # node: dimension, weight, low end of the key range searched, weight below it, target
    for b in boxes.collect():
        wide = max(dims, key=lambda d: (b[d], -dims.index(d)))
        if b[wide] or b["tie"]:
            left = shards[b["node"]] // 2
            state[b["node"]] = [dims.index(wide), b["w"], 0, 0, b["w"] * left / shards[b["node"]]]

    # Three rounds over the digits of the key find where the running weight passes the target.
    cuts: dict[int, tuple[int, int]] = {}
    rounds = [TIE_BITS, TIE_BITS // 2, 0]
    for at, shift in enumerate(rounds):
        if not state:
            break
        width = (1 << (ORDINAL_BITS if at == 0 else rounds[at - 1] - shift)) << shift
        found = _small(spark, [(n, s[0], s[2], float(s[3]), float(s[4])) for n, s in state.items()], "node int, dim int, low long, below double, target double")
        keyed = inside.join(found, "node").withColumn("key", _key(dims))
        bins = (
            keyed.filter((F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + width))
            .groupBy("node", "below", "target", F.shiftright(F.col("key"), shift).alias("bin"))
            .agg(F.sum("w").cast("double").alias("w"))
            .withColumn("upto", F.col("below") + F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
        )
        crossing = bins.groupBy("node").agg(F.min(F.when(F.col("upto") >= F.col("target"), F.struct("bin", "upto", "w"))).alias("c"), F.max(F.struct("bin", "upto", "w")).alias("last"))
        for row in crossing.collect():
            c, s = row["c"] or row["last"], state[row["node"]]
            s[2], s[3] = c["bin"] << shift, int(c["upto"] - c["w"])
            if shift == 0:  # the nearer side of the crossing group, with rows on both sides
                before, after = s[3], int(c["upto"])
                take_before = before > 0 and (after >= s[1] or s[4] - before <= after - s[4])
                cuts[row["node"]] = (c["bin"], before) if take_before else (c["bin"] + 1, after)

    left_of: list[tuple[int, int, int, int]] = []
    after: list[Node] = [n for n in nodes if n.shards == 1]
    for n in open_nodes:
        if n.first not in cuts:  # empty, or one point: its other shards stay empty
            after += [Node(n.first + i, 1) for i in range(n.shards)]
            continue
        cut, left_weight = cuts[n.first]
        left = min(n.shards - 1, max(1, round(left_weight / state[n.first][1] * n.shards)))
        left_of.append((n.first, state[n.first][0], cut, left))
        after += [Node(n.first, left), Node(n.first + left, n.shards - left)]
    if left_of:
        moved = groups.join(_small(spark, left_of, "node int, dim int, cut long, step int"), "node", "left")
        node = F.when(F.col("cut").isNotNull() & (_key(dims) >= F.col("cut")), F.col("node") + F.col("step")).otherwise(F.col("node"))
        groups = materialize(moved.withColumn("node", node).select(*groups.columns))
    return groups, after


def _key(dims: list[str]) -> Column:
    value = F.lit(0)
    for i, d in enumerate(dims):
        value = F.when(F.col("dim") == i, F.col(d)).otherwise(value)
    return F.shiftleft(value.cast("long"), TIE_BITS) + F.col("tie")


def _small(spark, rows: list[tuple], schema: str) -> DataFrame:
    """One row for each node: as many as there are shards at most.

    They come as literals in the plan, since a list of Python rows would go through Python workers.
    """
    text = json.dumps([list(r) for r in rows])
    fields = [f.strip().split(" ") for f in schema.split(",")]
    values = F.explode(F.from_json(F.lit(text), "array<array<string>>"))
    df = spark.range(1, numPartitions=1).select(values.alias("r")).select(*[F.col("r")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])
    return F.broadcast(df) if len(rows) <= 100_000 else df


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """Puts every row into a shard; returns id_col, size, text_crc32, law, shard, slot, grown_shard.

    Rows with equal texts form a group, which is never divided. A k-d tree over size and the
    category columns that docs has is split at distributed weighted quantiles along the widest
    dimension until each leaf is one shard. Give the number of shards, or target_bytes for as
    many as the bytes ask for. A group that outweighs a shard gets one of its own; the rest
    stays even. Only one row for each node reaches the driver, and one for each group of more than an even share.

    Null text: no bytes, a group with the empty ones. Null categories: ordinal 0. slot numbers the
    rows of a shard from 0 in no promised order; rows with equal ids get slots of their own. An
    empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    text = F.coalesce(docs[text_col], F.lit(""))
    named = [c for c in categories if c in docs.columns]
    rows = materialize(
        docs.select(
            docs[id_col].alias("id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("hash"),
            *[docs[c].cast("string").alias(f"c{i}") for i, c in enumerate(named)],
        )
    )
    dims = ["d_size", *[f"d{i}" for i in range(len(named))]]
    groups = (
        rows.groupBy("hash", "crc", "size")
        .agg(F.count(F.lit(1)).alias("n"), *[F.min(f"c{i}").alias(f"c{i}") for i in range(len(named))])
        .select(
            "hash", "crc", "size", (F.col("size") * F.col("n")).alias("w"), F.col("n"),
            _ordinal_of_size(F.col("size")).alias("d_size"),
            *[_ordinal_of_category(F.col(f"c{i}")).alias(f"d{i}") for i in range(len(named))],
            F.pmod(F.xxhash64("hash", "crc"), F.lit(1 << TIE_BITS)).alias("tie"),
            F.lit(0).alias("node"),
        )
    )
    groups = materialize(groups)
    total = groups.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    count = shards if shards is not None else max(1, math.ceil(total["w"] / target_bytes))
    # A group that outweighs an even share has a shard of its own, and the share of the rest is less.
    left, alone = total["w"], []
    for g in groups.filter(F.col("w") * count > total["w"]).orderBy(F.desc("w")).collect() if count > 1 else []:
        if g["w"] * (count - len(alone)) <= left or len(alone) == count - 1:
            break
        left -= g["w"]
        alone.append((g["hash"], g["crc"], g["size"], len(alone)))
    nodes = [Node(len(alone), count - len(alone))]
    groups = groups.withColumn("node", F.lit(len(alone)))
    if alone:
        own = _small(spark, alone, "hash long, crc long, size long, own int")
        groups = materialize(groups.join(own, ["hash", "crc", "size"], "left").withColumn("node", F.coalesce("own", "node")).drop("own").select(*groups.columns))
    while any(n.shards > 1 for n in nodes):
        groups, nodes = _split(groups, nodes, dims)

    placed = join_counted(rows, groups.select("hash", "crc", "size", "n", F.col("node").alias("shard")), ["hash", "crc", "size"], "n").drop("n")
    # A shard's rows are numbered in parts, each from the count of rows in the parts before it.
    parts = max(8, math.ceil(total["n"] / count / SLOT_ROWS))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id", "hash"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "hash")) - 1
    return (
        placed.withColumn("own", own)
        .join(before, ["shard", "part"])
        .select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
