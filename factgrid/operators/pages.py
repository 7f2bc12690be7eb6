"""Fetched pages: the ladder of reasons to fall back to the snippet, and what is usable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.functions.text import domain, is_binary, is_blocked

#: Fixed values of the scrape stage.
MIN_CONTENT, MIN_PAGE_TEXT, MAX_HTML, MAX_CONTENT, MAX_SECTION, DEADLINE_MS = 50, 200, 800_000, 12_000, 6_000, 5_000


def fetch_outcome(raw: DataFrame) -> DataFrame:
    """raw pages with error (null: to be parsed), in the order in which a fetch would find out.

    raw: url, status, content_type, snippet, and where known fetch_error (`timeout` or a message).
    """
    error = (
        F.when(is_blocked(F.col("url")), "blocked domain")
        .when(is_binary(F.col("url")), "binary file")
        .when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(~F.contains(F.coalesce("content_type", F.lit("")), F.lit("text/html")), "not HTML")
    )
    if "fetch_error" in raw.columns:
        error = F.when(is_blocked(F.col("url")), "blocked domain").when(is_binary(F.col("url")), "binary file").when(F.col("fetch_error").isNotNull(), F.col("fetch_error")).otherwise(error)
    return raw.withColumn("error", error)


def usable_pages(pages: DataFrame, deadline_ms: int = DEADLINE_MS) -> DataFrame:
    """Pages that came before the deadline with more than 50 characters of content."""
    return pages.filter((F.col("elapsed_ms") <= deadline_ms) & (F.length("content") > MIN_CONTENT))


def source_rows(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What is shown of each source: domain, title cut to 90, characters, sections, whether it has structured data, detail; and columns to keep."""
    return pages.select(
        *keep, "url", domain(F.col("url")).alias("domain"), F.left("title", F.lit(90)).alias("title"), F.length("content").cast("long").alias("chars"), F.size("sections").cast("long").alias("n_sections"),
        F.exists("sections", lambda s: s["sec_id"] == "sec_jsonld").alias("structured"), F.coalesce("error", F.lit("")).alias("detail"),
    )
