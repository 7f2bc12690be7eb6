"""Views of the driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw extraction records: run_id, ent_ord, name, field, value (null: absent), source_url, snippet."""
    part, pages = table(spark, sf_dir, "part"), table(spark, sf_dir, "pages").select("page_id", "url")
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    key, name = F.col("p_partkey"), F.col("p_name")
    ends = {2: " co", 3: " co hub", 4: " corporation"}
    suffix = F.lit("")
    for k, v in ends.items():
        suffix = F.when(key % 5 == k, v).otherwise(suffix)
    named = F.concat(F.when(key % 3 == 0, name).when(key % 3 == 1, F.upper(name)).otherwise(F.replace(name, F.lit(" "), F.lit("-"))), suffix)
    values = {
        "type": F.when(key % 7 == 0, "N/A").otherwise(F.col("p_type")),
        "size": F.when(key % 3 != 0, F.col("p_size").cast("string")),
        "price": F.when(key % 11 != 0, "unknown").otherwise(F.floor("p_retailprice").cast("string")),
        "color": F.substring_index(name, " ", 1),
    }
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values.items()]))
    records = part.crossJoin(F.broadcast(n)).join(pages, F.col("page_id") == key % F.col("n"))
    return (
        records.select(F.col("p_brand").alias("run_id"), key.alias("ent_ord"), named.alias("name"), F.col("url").alias("source_url"), long.alias("c"))
        .select("run_id", "ent_ord", "name", "c.field", "c.value", "source_url")
        .withColumn(
            "snippet",
            F.when(F.col("value").isNull(), "")
            .when(F.col("ent_ord") % 4 == 0, F.concat(F.lit("listed as "), "value", F.lit(" today")))
            .when(F.col("ent_ord") % 4 == 1, "see details")
            .when(F.col("ent_ord") % 4 == 2, "")
            .otherwise(F.upper("value")),
        )
    )


#: Fixed values of the plan: field and synonyms, in order.
PLAN = [("type", ["kind", "category"]), ("size", ["dimension", "width"]), ("price", ["cost", "amount"]), ("color", ["shade", "tone"])]


def plan_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of every run: run_id, ord, field, synonyms."""
    runs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("run_id")).distinct()
    fields = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.array(*map(F.lit, s)).alias("synonyms")) for i, (f, s) in enumerate(PLAN)]))
    return runs.select("run_id", fields.alias("f")).select("run_id", "f.ord", "f.field", "f.synonyms")


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw hits of three queries a run, with repeats and empty addresses: run_id, query_ord, rank, url, title, snippet."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    query = F.explode(F.array(*[F.struct(F.lit(i).alias("query_ord"), F.lit(n).alias("every")) for i, n in enumerate((1, 3, 5))]))
    return (
        pages.select("page_id", "url", query.alias("q"))
        .filter(F.col("page_id") % F.col("q.every") == 0)
        .select(
            F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("run_id"), "q.query_ord", F.col("page_id").alias("rank"),
            F.when(F.col("page_id") % 41 == 0, "").otherwise(F.col("url")).alias("url"), F.substring("url", 1, 30).alias("title"), F.concat(F.lit("snippet for "), "url").alias("snippet"),
        )
    )


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch outcomes: page_id, url, status, content_type, elapsed_ms, html, snippet."""
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.when(p % 10 == 3, 404).otherwise(200).alias("status"), F.when(p % 10 == 5, "application/json").otherwise("text/html; charset=utf-8").alias("content_type"),
        ((p * 37) % 7000).alias("elapsed_ms"), "html", F.concat(F.lit("search snippet number "), p.cast("string"), F.lit(" for the page hosted at "), "url").alias("snippet"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as sections: run_id, page_ord, url, sec_ord, text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string"))
    return docs.select(F.col("source").alias("run_id"), F.col("doc_id").alias("page_ord"), url.alias("url"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(
        "run_id", "page_ord", "url", F.col("pos").cast("long").alias("sec_ord"), "text"
    )


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches and how they settled: run_id, event_id, url, fetch_ts, elapsed_ms, settle_status."""
    e = table(spark, sf_dir, "events")
    url = F.concat(F.lit("https://s"), F.col("user_id").cast("string"), F.lit(".example.com/"), F.col("event_id").cast("string"))
    return e.select(
        (F.col("user_id") % 20).cast("long").alias("run_id"), "event_id", url.alias("url"), F.col("ts").alias("fetch_ts"),
        F.floor(F.col("value") * 100).cast("long").alias("elapsed_ms"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("settle_status"),
    )
