"""Bodies of extraction replies to cells: fences, wrappers, repair of what was cut off, blank values.

responses: run_id, batch, body, failed, and where known elapsed_ms, fallback_url.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgrid.functions.text import EXTRACTION_BLANK_TOKENS, trim_unicode
from factgrid.plans.ship import ship_package

#: Fixed values of the extraction stage.
MIN_YIELD, SNIPPET_CHARS, DEADLINE_MS, GRACE_MS = 4, 200, 6_500, 2_000
#: Keys of objects that may hold the list of entities, and ends that may close what was cut off.
WRAPPERS, ENDINGS = ("entities", "results", "data", "items"), ("]}", "]", "}]}")


def _text(value: object) -> str | None:
    """A JSON value as the engine keeps it: strings as they are, null as null, the rest as Python prints it."""
    return value if isinstance(value, str) or value is None else str(value)


def parse_entities(body: str | None) -> list | None:
    """The list of entities in a reply; of a reply that was cut off, those that were closed. None if there is none."""
    text = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", (body or "").strip())).strip()

    def listed(parsed: object) -> list | None:
        """The list itself, or the first that a wrapper key holds."""
        held = [parsed, *map(parsed.get, WRAPPERS)] if isinstance(parsed, dict) else [parsed]
        return next((x for x in held if isinstance(x, list)), None)

    try:
        return listed(json.loads(text))
    except (ValueError, RecursionError):
        pass
    at = text.rfind("}")
    for ending in ENDINGS if at >= 0 else ():
        try:
            found = listed(json.loads(text[: at + 1] + ending))
        except (ValueError, RecursionError):
            continue
        if found:
            return found
    return None


def parse_responses(responses: DataFrame) -> DataFrame:
    """run_id, batch, failed, n_entities and records of each reply: array of (ord, name, source_url, cells).

    A reply without a list has null records and counts as failed; an empty list doesn't. Arrow-batched, since strict JSON
    with repeated keys is beyond the engine's own parser.
    """
    ship_package(responses.sparkSession)
    item = pa.struct([("ord", pa.int32()), ("name", pa.string()), ("source_url", pa.string()), ("cells", pa.list_(pa.struct([("field", pa.string()), ("value", pa.string()), ("snippet", pa.string())])))])
    schema = "run_id string, batch long, failed boolean, n_entities long, records array<struct<ord int, name string, source_url string, cells array<struct<field string, value string, snippet string>>>>"

    def record(i: int, e: dict) -> dict | None:
        name = e.get("name")
        if isinstance(name, dict):
            name = name.get("value") or name.get("name")
        name = (_text(name) or "").strip()
        if not name:
            return None
        attributes = e.get("attributes")
        cells = []
        for field, v in attributes.items() if isinstance(attributes, dict) else ():
            value, snippet = (v.get("value"), v.get("source_snippet")) if isinstance(v, dict) else (v, "")
            cells.append({"field": field, "value": _text(value), "snippet": snippet if isinstance(snippet, str) else ""})
        return {"ord": i, "name": name, "source_url": e["source_url"] if isinstance(e.get("source_url"), str) and e["source_url"] else None, "cells": cells}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, numbers, bodies, failures = (batch.column(i).to_pylist() for i in range(4))
            found = [None if f else parse_entities(b) for b, f in zip(bodies, failures, strict=True)]
            records = [None if x is None else [r for i, e in enumerate(x) if isinstance(e, dict) and (r := record(i, e))] for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs, pa.string()), pa.array(numbers, pa.int64()), pa.array([r is None for r in records]), pa.array([len(r or ()) for r in records], pa.int64()), pa.array(records, pa.list_(item))],
                names=["run_id", "batch", "failed", "n_entities", "records"],
            )

    return responses.select("run_id", F.col("batch").cast("long").alias("batch"), "body", F.coalesce("failed", F.lit(False)).alias("failed")).mapInArrow(run, schema)


def build_cells(parsed: DataFrame, plan: DataFrame, fallback: DataFrame) -> DataFrame:
    """Cells of parsed replies: run_id, batch, ord, name, field, value, source_url, snippet.

    Planned fields only, without blank values; a record without an address has its batch's first (fallback: run_id,
    batch, url). Records without any cell leave one row of null field, as they are entities.
    """
    records = parsed.select("run_id", "batch", F.explode("records").alias("r")).join(fallback.select("run_id", "batch", F.col("url").alias("first_url")), ["run_id", "batch"], "left")
    flat = records.select("run_id", "batch", "r.ord", "r.name", F.coalesce("r.source_url", "first_url", F.lit("")).alias("source_url"), F.explode_outer("r.cells").alias("c"))
    fields = plan.filter(F.lower("field") != "name").select("run_id", F.col("field").alias("planned"), F.lit(True).alias("ok"))
    value = F.col("c.value")
    good = ~F.lower(trim_unicode(value)).isin(EXTRACTION_BLANK_TOKENS) & F.col("ok")
    joined = flat.join(fields, (fields["run_id"] == flat["run_id"]) & (F.col("planned") == F.col("c.field")), "left").select(
        flat["run_id"], "batch", "ord", "name", "source_url", F.when(F.coalesce(good, F.lit(False)), F.struct(F.col("c.field").alias("field"), value.alias("value"), F.left("c.snippet", F.lit(SNIPPET_CHARS)).alias("snippet"))).alias("c")
    )
    at = Window.partitionBy("run_id", "batch", "ord").orderBy(F.col("c.field").asc_nulls_last())
    kept = joined.withColumn("n", F.row_number().over(at)).filter(F.col("c").isNotNull() | (F.col("n") == 1))
    return kept.select("run_id", "batch", "ord", "name", "c.field", "c.value", "source_url", "c.snippet")


def top_up(entities: DataFrame, more: DataFrame, least: int = MIN_YIELD) -> DataFrame:
    """entities, and where a run has fewer than `least`, those of more with a new lower-cased name.

    Names are compared with what is there before, not within more. Both: run_id, name and further columns.
    """
    enough = entities.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("run_id")
    seen = entities.select("run_id", F.lower("name").alias("seen"))
    new = more.join(enough, "run_id", "left_anti").join(seen, (more["run_id"] == seen["run_id"]) & (F.lower(more["name"]) == F.col("seen")), "left_anti")
    return entities.unionByName(new.select(*entities.columns))


def top_up_plan(shards: DataFrame, n_pages: DataFrame, least: int = MIN_YIELD) -> DataFrame:
    """run_id, n_batches, n_failures, n_entities, tops_up, falls_back, unavailable of each run with pages.

    A run of fewer than `least` entities reads its first batch again: with the fallback model if every batch failed or was abandoned, since
    then the first is most likely refused. unavailable: it has no entity, and a batch failed, which is not the same as pages that
    hold nothing. shards: run_id, failed, n_entities. n_pages: run_id, n_pages.
    """
    seen = shards.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_batches"), F.count_if(F.coalesce("failed", F.lit(True))).alias("n_failures"), F.sum(F.when(F.coalesce("failed", F.lit(True)), 0).otherwise(F.col("n_entities"))).cast("long").alias("n_entities")
    )
    few = F.col("n_entities") < least
    return n_pages.filter("n_pages > 0").select("run_id").join(seen, "run_id").select(
        "run_id", "n_batches", "n_failures", "n_entities", few.alias("tops_up"),
        (few & (F.col("n_failures") >= F.col("n_batches"))).alias("falls_back"), ((F.col("n_entities") == 0) & (F.col("n_failures") > 0)).alias("unavailable"),
    )


def before_cutoff(shards: DataFrame) -> DataFrame:
    """Shards with cutoff_ms and accepted: done by the first of the run, or by the deadline if that is earlier, plus the grace.

    A shard that failed also counts as the first. shards: run_id, elapsed_ms.
    """
    first = F.min("elapsed_ms").over(Window.partitionBy("run_id"))
    cutoff = F.least(first, F.lit(DEADLINE_MS)) + GRACE_MS
    return shards.withColumn("cutoff_ms", cutoff.cast("long")).withColumn("accepted", F.col("elapsed_ms") <= F.col("cutoff_ms"))
