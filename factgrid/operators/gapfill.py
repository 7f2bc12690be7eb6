"""Filling of holes: values found for named entities go where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.functions.text import has_value

#: Fixed value: characters of a snippet that are kept.
SNIPPET_CHARS = 200


def apply_filled(entities: DataFrame, cells: DataFrame, plan: DataFrame, filled: DataFrame) -> DataFrame:
    """cells with the holes filled; `was_filled` tells which.

    filled: run_id, name, field, value, source_url, snippet. Only holes of planned fields are filled,
    never with blank values, and of entities with one name the last is. Of several
    fillings of one hole the first by source_url and value counts.
    """
    last = entities.groupBy("run_id", "name").agg(F.max("ent_ord").alias("ent_ord"))
    have = cells.filter(has_value(F.col("value")))
    offered = (
        filled.filter(has_value(F.col("value")))
        .join(plan.select("run_id", "field"), ["run_id", "field"], "left_semi")
        .join(last, ["run_id", "name"])
        .join(have.select("run_id", "ent_ord", "field"), ["run_id", "ent_ord", "field"], "left_anti")
        .groupBy("run_id", "ent_ord", "field")
        .agg(F.min(F.struct("source_url", "value", F.left(F.coalesce("snippet", F.lit("")), F.lit(SNIPPET_CHARS)).alias("snippet"))).alias("f"))
        .select("run_id", "ent_ord", "field", "f.value", "f.source_url", "f.snippet", F.lit(True).alias("was_filled"))
    )
    return have.select("run_id", "ent_ord", "field", "value", "source_url", "snippet", F.lit(False).alias("was_filled")).unionByName(offered)
