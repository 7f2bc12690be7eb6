"""Bodies that services send back, as relations: result lists of search engines, plans, fillings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.functions.text import redirect_target, strip_fences
from factgrid.operators.search import RESULTS_PER_QUERY, trim_schema
from factgrid.plans.ship import ship_package
from factgrid.sources.html import Node, Tree

PLAN = "entity_type string, schema_fields array<string>, search_queries array<string>, field_synonyms map<string, array<string>>"


def json_results(bodies: DataFrame) -> DataFrame:
    """Hits of JSON result lists (`organic`: link, title, snippet): run_id, query_ord, rank, url, title, snippet.

    bodies: run_id, query_ord, body. What is missing is empty; a body that is no such list has no hits.
    """
    items = F.from_json("body", "organic array<struct<link string, title string, snippet string>>")["organic"]
    hits = bodies.select("run_id", "query_ord", F.posexplode(items).alias("rank", "h"))
    return hits.select("run_id", "query_ord", F.col("rank").cast("long").alias("rank"), *[F.coalesce(F.col(f"h.{c}"), F.lit("")).alias(name) for c, name in (("link", "url"), ("title", "title"), ("snippet", "snippet"))])


def _classed(node: Node, name: str) -> Iterator[Node]:
    return (n for n in node.walk() if name in n.attrs.get("class", "").split())


def result_blocks(html: str) -> list[tuple[str, str, str]]:
    """(href, title, snippet) of the first five result blocks that have a title link."""
    out = []
    for at, block in enumerate(_classed(Tree(html).root, "result")):
        if at == RESULTS_PER_QUERY:
            break
        link = next((a for t in _classed(block, "result__title") for a in t.walk() if a.tag == "a"), None)
        if link is not None:
            snippet = next(_classed(block, "result__snippet"), None)
            out.append((link.attrs.get("href", ""), "".join(s.strip() for s in link.strings()), "".join(s.strip() for s in snippet.strings()) if snippet else ""))
    return out


def html_results(bodies: DataFrame) -> DataFrame:
    """Hits of HTML result pages, like json_results; redirects are resolved, hits without an address left out."""
    ship_package(bodies.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (run_id, query, rank, *block)
                for run_id, query, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
                for rank, block in enumerate(result_blocks(body or ""))
            ]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["run_id", "query_ord", "rank", "href", "title", "snippet"])

    found = bodies.select("run_id", F.col("query_ord").cast("long").alias("query_ord"), "body").mapInArrow(run, "run_id string, query_ord long, rank long, href string, title string, snippet string")
    return found.select("run_id", "query_ord", "rank", redirect_target(F.col("href")).alias("url"), "title", "snippet").filter("url <> ''")


def parse_plans(bodies: DataFrame) -> DataFrame:
    """Plans of a planner's replies: run_id, entity_type, search_queries, fields array<struct<ord, field, synonyms>>.

    bodies: run_id, body. Fences go, and fields beyond the sixth. A reply that is no plan is left out.
    """
    plan = F.from_json(strip_fences(F.col("body")), PLAN)
    fields = F.transform(trim_schema(F.col("p.schema_fields")), lambda f, i: F.struct(i.alias("ord"), f.alias("field"), F.coalesce(F.try_element_at("p.field_synonyms", f), F.array().cast("array<string>")).alias("synonyms")))
    parsed = bodies.select("run_id", plan.alias("p")).filter("p.entity_type IS NOT NULL AND p.schema_fields IS NOT NULL")
    return parsed.select("run_id", "p.entity_type", F.coalesce("p.search_queries", F.array().cast("array<string>")).alias("search_queries"), fields.alias("fields"))


def plan_rows(plans: DataFrame) -> DataFrame:
    """run_id, ord, field, synonyms of parsed plans."""
    return plans.select("run_id", F.explode("fields").alias("f")).select("run_id", "f.ord", "f.field", "f.synonyms")


def filled_of(body: str | None) -> list[tuple[str, str, object, str]]:
    """(name, field, value, snippet) of a filling reply; of one that was cut off, what its last closed object leaves."""
    text = (body or "").strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    data: object = None
    for end in ("", "}", "}}", "}}}"):
        try:
            data = json.loads(text[: text.rfind("}") + 1] + end if end else text)
            break
        except (ValueError, RecursionError):
            continue
    filled = data.get("filled") if isinstance(data, dict) else None
    out = []
    for name, fields in filled.items() if isinstance(filled, dict) else ():
        for field, v in fields.items() if isinstance(fields, dict) else ():
            value, snippet = (v.get("value"), v.get("source_snippet")) if isinstance(v, dict) else (v, "")
            if value is not None:
                out.append((name, field, value if isinstance(value, str) else str(value), snippet if isinstance(snippet, str) else ""))
    return out


def parse_filled(bodies: DataFrame) -> DataFrame:
    """Fillings of replies: run_id, name, field, value, source_url, snippet. bodies: run_id, body, source_url."""
    ship_package(bodies.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(run_id, *f[:3], url, f[3]) for run_id, body, url in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for f in filled_of(body)]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["run_id", "name", "field", "value", "source_url", "snippet"])

    return bodies.select("run_id", "body", "source_url").mapInArrow(run, "run_id string, name string, field string, value string, source_url string, snippet string")

