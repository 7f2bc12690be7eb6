"""Reuse of results by nearness of query vectors. cache: id, query_text, embedding, table_data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.plans.ship import ship_package

#: Fixed value: similarity from which a cached result is reused.
HIT = 0.85
#: Cached rows that one task compares with a batch of probes.
PART_ROWS = 50_000


def nearest(probes: DataFrame, cache: DataFrame, batch_rows: int = 4096, own: bool = True) -> DataFrame:
    """probe_id, best_id, similarity (6 places): the nearest cached vector by exact cosine, the lowest id on ties.

    probes: probe_id, embedding. Probes are the stated query set: they are grouped into batches, each batch meets each
    part of the cache once, and one row for each probe and part goes on. With own False, a
    probe passes over the cached row of its own id. No vector is
    collected on the driver, and neither side is broadcast whole.
    """
    ship_package(probes.sparkSession)
    n_batches = max(1, -(-probes.count() // batch_rows))
    n_parts = max(1, -(-cache.count() // PART_ROWS))
    q = probes.select(F.col("probe_id").cast("long").alias("id"), "embedding", F.pmod(F.xxhash64("probe_id"), F.lit(n_batches)).cast("int").alias("batch"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))).withColumn("side", F.lit(0))
    c = cache.select(F.col("id").cast("long").alias("id"), "embedding", F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int").alias("part"))
    c = c.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1)))).withColumn("side", F.lit(1))

    def block(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, raw = table.column("id").to_numpy(), table.column("embedding").to_pylist()
        x = np.array(raw, dtype=np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        a, b = np.nonzero((side == 0) & good)[0], np.nonzero((side == 1) & good)[0]
        b = b[np.argsort(ids[b], kind="stable")]
        best, score = np.full(len(a), -1), np.full(len(a), -2.0)
        for at in range(0, len(b), 8192):
            s = np.round((x[a] @ x[b[at : at + 8192]].T) / np.outer(norm[a], norm[b[at : at + 8192]]), 12)
            if not own:
                s[ids[a][:, None] == ids[b[at : at + 8192]]] = -2.0
            top = s.argmax(axis=1)
            better = s[np.arange(len(a)), top] > score
            score[better] = s[np.arange(len(a)), top][better]
            best[better] = ids[b[at + top]][better]
        on = score > -2.0  # ids may be negative
        return pa.table({"probe_id": pa.array(ids[a][on], pa.int64()), "best_id": pa.array(best[on], pa.int64()), "similarity": pa.array(score[on], pa.float64())})

    found = q.unionByName(c.select(*q.columns)).groupBy("batch", "part").applyInArrow(block, "probe_id long, best_id long, similarity double")
    best = F.min_by(F.struct("best_id", "similarity"), F.struct(-F.col("similarity"), "best_id")).alias("b")
    return found.groupBy("probe_id").agg(best).select("probe_id", "b.best_id", F.round("b.similarity", 6).alias("similarity"))


def cache_hits(probes: DataFrame, cache: DataFrame, threshold: float = HIT, own: bool = True) -> DataFrame:
    """Nearest with hit: similarity of at least threshold, which itself counts."""
    return nearest(probes, cache, own=own).withColumn("hit", F.col("similarity") >= threshold)


def cache_list(cache: DataFrame) -> DataFrame:
    """id, query_text and number of entities of every cached table."""
    entities = F.from_json("table_data", "entities array<string>")["entities"]
    return cache.select("id", "query_text", F.coalesce(F.size(entities), F.lit(0)).cast("long").alias("n_entities"))


def append(cache_path: str, rows: DataFrame) -> None:
    """Adds rows; repeats are kept, as every search saves its own."""
    rows.write.mode("append").parquet(cache_path)


def clear(cache_path: str, like: DataFrame) -> None:
    """Leaves an empty cache."""
    like.limit(0).write.mode("overwrite").parquet(cache_path)
