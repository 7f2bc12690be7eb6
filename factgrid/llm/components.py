"""Connected components by alternating large and small stars, and the dealing out of bucket blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.plans.materialize import discard

from .common import materialize
from .hot_keys import join_counted

#: Buckets of more rows than a block whose counts are broadcast at most; rows alone in a bucket are worth a shuffle if they are more than one in so many.
MAX_LARGE, ALONE_SHARE = 100_000, 4


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being the smallest node reachable.

    Each round writes its edges to the shared folder. Minima are aggregated before they are joined
    back, so that a hub's neighbours never meet in one task. Self-loops and repeated edges are
    allowed, nulls are ignored.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e)
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        both = e.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("x")))
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.filter("x > n").join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, e = e, materialize(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def in_blocks(rows: DataFrame, keys: list[str], salt: str, block_rows: int, alone_too: bool = False) -> DataFrame:
    """Keeps buckets (keys) of two rows or more and adds part_a, part_b so that any two rows of a bucket meet.

    own is the row's part. Two rows of one part meet in every block of that part.

    A bucket of up to block_rows rows is one block. A larger one is dealt by the hash of column
    salt into parts of about block_rows, and every two of its parts form a block of their own. With alone_too, rows that are alone in a
    bucket stay where they are few; then rows are not moved here: only the larger buckets' counts are sent to them, if these are few.
    """
    counts = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("bucket_rows")))
    large = F.col("bucket_rows") > block_rows
    n, alone, n_large = counts.agg(F.coalesce(F.sum("bucket_rows"), F.lit(0)), F.count_if(F.col("bucket_rows") == 1), F.count_if(large)).first()
    if alone_too and alone * ALONE_SHARE <= n and n_large <= MAX_LARGE:
        counted = rows.join(F.broadcast(counts.filter(large)), keys, "left")
    else:
        counted = join_counted(rows, counts.filter("bucket_rows > 1"), keys, "bucket_rows")
    parts = F.coalesce(F.ceil(F.col("bucket_rows") / block_rows).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64(F.lit(7), F.col(salt)), F.col("parts")).cast("int")
    with_own = counted.withColumn("parts", parts).withColumn("own", own)
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("own")))
    return (
        with_own.withColumn("other", F.explode(others))
        .withColumn("part_a", F.least("own", "other"))
        .withColumn("part_b", F.greatest("own", "other"))
        .drop("bucket_rows", "parts", "other")
    )


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, most_rows: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, from batches sorted by their first `keys` columns, and where each group starts."""

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for i in range(keys):
            c = t.column(i).combine_chunks()
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return np.nonzero(new)[0]

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most_rows:
                table = pa.Table.from_batches(held)
                starts = bounds(table)
                if len(starts) > 1:
                    last = int(starts[-1])
                    yield table.slice(0, last), starts
                    held, rows = table.slice(last).to_batches(), table.num_rows - last
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(bounds(table), table.num_rows)
