"""External services as protocols, and stand-ins that need no network."""

from __future__ import annotations

import json
import zlib
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgrid.plans.ship import ship_package


class SearchProvider(Protocol):
    def search(self, queries: DataFrame) -> DataFrame:
        """queries (run_id, query_ord, query) to hits (run_id, query_ord, rank, url, title, snippet)."""


class FetchProvider(Protocol):
    def fetch(self, hits: DataFrame) -> DataFrame:
        """hits to raw pages (run_id, page_ord, url, title, snippet, status, content_type, html, fetch_error, elapsed_ms)."""


class PlanProvider(Protocol):
    def plan(self, requests: DataFrame) -> DataFrame:
        """requests (run_id, query) to replies (run_id, body, failed); see replies.parse_plans."""


class ExtractProvider(Protocol):
    def extract(self, prompts: DataFrame) -> DataFrame:
        """prompts (run_id, batch, prompt) to replies (run_id, batch, body, failed, and where known elapsed_ms)."""


class GapFillProvider(Protocol):
    def fill(self, prompts: DataFrame) -> DataFrame:
        """prompts (run_id, worker, holes_text, context) to replies (run_id, worker, body, failed, and where known elapsed_ms); see replies.parse_filled."""


class EmbedProvider(Protocol):
    def embed(self, texts: DataFrame) -> DataFrame:
        """texts (id, text) to vectors (id, embedding)."""


class TableSearch:
    """Search in a table of pages (url, title, text): hits hold the query's words, most of them first."""

    def __init__(self, pages: DataFrame, per_query: int = 5):
        self.pages, self.per_query = pages, per_query

    def search(self, queries: DataFrame) -> DataFrame:
        """Inverted: words of queries meet words of pages by equality, so no query is compared with a page it shares none with."""
        def words(c: str):
            return F.explode(F.array_distinct(F.filter(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)))

        asked = queries.select("run_id", "query_ord", words("query").alias("word"))
        held = self.pages.select("url", words("text").alias("word"))
        scored = asked.join(held, "word").groupBy("run_id", "query_ord", "url").agg(F.count(F.lit(1)).alias("hits"))
        at = F.row_number().over(Window.partitionBy("run_id", "query_ord").orderBy(F.desc("hits"), "url"))
        best = scored.withColumn("rank", at.cast("long")).filter(F.col("rank") <= self.per_query)
        return best.join(self.pages.select("url", "title", F.left("text", F.lit(200)).alias("snippet")), "url").select("run_id", "query_ord", "rank", "url", "title", "snippet")


class TableFetch:
    """Fetches from a table of pages (url, html); what isn't there times out."""

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def fetch(self, hits: DataFrame) -> DataFrame:
        there = F.col("html").isNotNull()
        found = hits.join(self.pages.select("url", "html"), "url", "left")
        return found.select(
            "run_id", "page_ord", "url", "title", "snippet", F.when(there, 200).alias("status"), F.when(there, "text/html").alias("content_type"), "html",
            F.when(~there, "timeout").alias("fetch_error"), F.lit(100).alias("elapsed_ms"),
        )


class TablePlan:
    """Plans from a table (query, body); a query that isn't there has no plan."""

    def __init__(self, plans: DataFrame):
        self.plans = plans

    def plan(self, requests: DataFrame) -> DataFrame:
        found = requests.join(self.plans.select("query", "body"), "query", "left")
        return found.select("run_id", "body", F.col("body").isNull().alias("failed"))


class RuleFill:
    """Fills holes from lines `name: X | field: value` of the context."""

    def fill(self, prompts: DataFrame) -> DataFrame:
        ship_package(prompts.sparkSession)

        def run(batches):
            for batch in batches:
                bodies = []
                for holes, context in zip(batch.column("holes_text").to_pylist(), batch.column("context").to_pylist(), strict=True):
                    lacking = dict(line.removeprefix("- ").rsplit(": missing ", 1) for line in (holes or "").split("\n") if ": missing " in line)
                    filled: dict[str, dict] = {}
                    for line in (context or "").split("\n"):
                        parts = dict(p.split(": ", 1) for p in line.split(" | ") if ": " in p)
                        for field in lacking.get(parts.get("name", ""), "").split(", "):
                            if field in parts:
                                filled.setdefault(parts["name"], {}).setdefault(field, {"value": parts[field], "source_snippet": line[:200]})
                    bodies.append(json.dumps({"filled": filled}))
                yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("worker"), pa.array(bodies, pa.string()), pa.array([False] * len(bodies))], names=["run_id", "worker", "body", "failed"])

        return prompts.select("run_id", F.col("worker").cast("long").alias("worker"), "holes_text", "context").mapInArrow(run, "run_id string, worker long, body string, failed boolean")


class RuleExtract:
    """Reads `label: value` records out of prompts: lines of structured data, and plain lines of one field."""

    def __init__(self, plan: DataFrame):
        self.plan = plan

    def extract(self, prompts: DataFrame) -> DataFrame:
        ship_package(self.plan.sparkSession)
        fields = self.plan.groupBy("run_id").agg(F.collect_set("field").alias("fields"))

        def reply(batches):
            for batch in batches:
                bodies = []
                for prompt, planned in zip(batch.column("prompt").to_pylist(), batch.column("fields").to_pylist(), strict=True):
                    url, found = "", []
                    for line in (prompt or "").split("\n"):
                        if line.startswith("--- PAGE: "):
                            url = line.removeprefix("--- PAGE: ").removesuffix(" ---")
                        parts = dict(p.split(": ", 1) for p in line.split(" | ") if ": " in p)
                        if parts.get("name"):
                            attributes = {f: {"value": parts[f], "source_snippet": line[:200]} for f in sorted(planned or ()) if f in parts}
                            found.append({"name": parts["name"], "source_url": url, "attributes": attributes})
                    bodies.append(json.dumps({"entities": found}))
                yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("batch"), pa.array(bodies), pa.array([False] * len(bodies))], names=["run_id", "batch", "body", "failed"])

        joined = prompts.join(fields, "run_id", "left").select("run_id", F.col("batch").cast("long").alias("batch"), "prompt", "fields")
        return joined.mapInArrow(reply, "run_id string, batch long, body string, failed boolean")


class HashEmbed:
    """Vectors of hashed words, for tests and for places without a model: equal texts are equal, similar ones near."""

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def embed(self, texts: DataFrame) -> DataFrame:
        ship_package(texts.sparkSession)
        d = self.dimensions

        def run(batches):
            for batch in batches:
                vectors = []
                for text in batch.column("text").to_pylist():
                    v = [0.0] * d
                    for w in (text or "").lower().split():
                        h = zlib.crc32(w.encode())
                        v[h % d] += 1.0 if h >> 31 else -1.0
                    vectors.append(v)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "embedding"])

        return texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, embedding array<float>")

