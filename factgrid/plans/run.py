"""Topics to final tables, with services as providers: cache, plan, search, pages, extraction, gap filling, events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgrid.operators import audit, cache, export, extract, pages, route, search
from factgrid.plans.materialize import cut
from factgrid.plans.table import FinalTables, Filler, final_tables
from factgrid.sources.html import with_sections
from factgrid.sources.providers import EmbedProvider, ExtractProvider, FetchProvider, GapFillProvider, PlanProvider, SearchProvider
from factgrid.sources.replies import parse_filled, parse_plans, plan_rows
from factgrid.streaming import events

#: Fixed values of gap filling: holes that a run must have, and milliseconds that a reply may take.
MIN_HOLES, FILL_DEADLINE_MS = 1, 3_500
#: The number of the batch that is read again; it comes behind all others.
TOP_UP_BATCH = 1_000_000
CACHE = "id long, query_text string, embedding array<float>, table_data string"


@dataclass
class Run:
    """Final tables, and what each stage saw, for events and for a look at what went wrong."""

    tables: FinalTables
    hits: DataFrame
    pages: DataFrame
    parsed: DataFrame
    results: DataFrame
    events: DataFrame
    errors: DataFrame

    def unavailable(self) -> DataFrame:
        """Runs without an entity of which a shard failed: not the same as pages that hold nothing."""
        return self.errors.filter("stage = 4").select("run_id")


def _first_hits(asked: DataFrame, searcher: SearchProvider) -> DataFrame:
    """Hits of the raw query, and for runs with few of them those of further queries with new addresses."""
    first = cut(searcher.search(asked.select("run_id", F.lit(0).alias("query_ord"), "query")))
    seed = search.first_of_each_url(search.top_results(first, search.SEED_RESULTS))
    few = asked.join(seed.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= search.MIN_SEED_RESULTS), "run_id", "left_anti")
    more = few.select("run_id", F.posexplode(search.extra_queries(F.col("query"), F.col("planned"))).alias("at", "query"))
    extra = cut(searcher.search(more.select("run_id", (F.col("at") + 1).alias("query_ord"), "query")))
    return cut(search.second_round(seed, search.first_of_each_url(extra)))


def _read_pages(hits: DataFrame, fetcher: FetchProvider) -> DataFrame:
    """Fetched pages with error (null: parsed), sections and content; those that failed have their snippet as content."""
    order = F.row_number().over(Window.partitionBy("run_id").orderBy("query_ord", "rank"))
    raw = cut(fetcher.fetch(hits.withColumn("page_ord", order.cast("long"))))
    checked = pages.fetch_outcome(raw)
    good = with_sections(checked.filter("error IS NULL"))
    failed = checked.filter("error IS NOT NULL").drop("html").withColumn("sections", F.array().cast(good.schema["sections"].dataType)).withColumn("content", F.coalesce("snippet", F.lit("")))
    return cut(good.unionByName(failed.select(*good.columns)))


def _prompts(read: DataFrame, plan: DataFrame, types: DataFrame | None) -> DataFrame:
    """run_id, batch, prompt, url (of its first page)."""
    sections = read.select("run_id", "page_ord", "url", "batch", F.explode("sections").alias("s")).select("run_id", "page_ord", "url", "batch", "s.*")
    prompts = route.page_prompts(route.route_sections(sections, route.keywords(plan, types)))
    bare = read.filter(F.size("sections") == 0).select("run_id", "page_ord", "url", F.concat(F.lit("\n--- PAGE: "), "url", F.lit(" ---\n"), F.left("content", F.lit(route.SECTION_CHARS)), F.lit("\n")).alias("prompt"))
    of_page = prompts.unionByName(bare).join(read.select("run_id", "page_ord", "batch"), ["run_id", "page_ord"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_ord", "prompt"))), lambda p: p["prompt"]), "")  # at most four pages
    return of_page.groupBy("run_id", "batch").agg(joined.alias("prompt"), F.min_by("url", "page_ord").alias("url"))


def _asked(extractor: ExtractProvider, prompts: DataFrame) -> DataFrame:
    """Replies, of which those behind a run's cutoff count as failed."""
    replies = extractor.extract(prompts.select("run_id", "batch", "prompt"))
    if "elapsed_ms" not in replies.columns:
        return cut(replies.select("run_id", "batch", "body", F.coalesce("failed", F.lit(False)).alias("failed")))
    judged = extract.before_cutoff(cut(replies))
    return cut(judged.select("run_id", "batch", "body", (F.coalesce("failed", F.lit(False)) | ~F.coalesce("accepted", F.lit(True))).alias("failed")))


def _filler(filler: GapFillProvider, read: DataFrame) -> Filler:
    """Offers for the holes of merged entities, from the sections that name them."""
    sections = read.select("run_id", "page_ord", "url", F.explode("sections").alias("s")).select("run_id", "page_ord", "url", "s.*")

    def offers(entities: DataFrame, cells: DataFrame, kept: DataFrame) -> DataFrame:
        holes = cut(route.holes(entities, cells, kept))
        enough = holes.groupBy("run_id").agg(F.sum("n_missing").alias("n")).filter(F.col("n") >= MIN_HOLES)
        holes = holes.join(enough.select("run_id"), "run_id", "left_semi")
        near = route.gap_route(sections, holes.select("run_id", "name"))
        blocks = F.array_sort(F.collect_list(F.struct("slot", "block")))  # within the budget of characters
        context = near.groupBy("run_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "").alias("context"), F.min_by("url", "slot").alias("source_url"))
        prompts = cut(route.holes_text(holes).join(context, "run_id"))
        replies = cut(filler.fill(prompts.select("run_id", "worker", "holes_text", "context")))
        good = replies.filter(~F.coalesce("failed", F.lit(False)))
        if "elapsed_ms" in replies.columns:
            good = good.filter(F.col("elapsed_ms") <= FILL_DEADLINE_MS)
        return parse_filled(good.join(prompts.select("run_id", "worker", "source_url"), ["run_id", "worker"]))

    return offers


def run_topics(
    requests: DataFrame,
    plan: DataFrame | PlanProvider,
    searcher: SearchProvider,
    fetcher: FetchProvider,
    extractor: ExtractProvider,
    *,
    fallback: ExtractProvider | None = None,
    filler: GapFillProvider | None = None,
    embedder: EmbedProvider | None = None,
    cache_path: str | None = None,
) -> Run:
    """requests: run_id, query, planned (array of further queries; a plan provider brings its own). plan: run_id, ord, field, synonyms, or a provider.

    With an embedder and a cache, runs whose query is near a cached one get its table and go through no other stage. The raw query is
    searched first; planned queries only for runs that it finds little for. Runs of few entities read their first batch again, with
    fallback where every batch failed. With a filler, holes of columns that the audit keeps are filled before rows are dropped. Tables that are
    filled enough are saved. What a provider returns is cut, so that a later step never asks it again. Each run has its events;
    one without a plan, or without an entity and with failures, ends in an error.
    """
    spark = requests.sparkSession
    wanted = cut(requests.filter(search.is_query(F.col("query"))).withColumn("probe_id", F.xxhash64("run_id")))
    none = spark.createDataFrame([], "run_id string, table_data string, n_entities long")
    cached, vectors = none, None
    if embedder is not None and cache_path is not None:
        vectors = cut(embedder.embed(wanted.select(F.col("probe_id").alias("id"), F.col("query").alias("text"))))
        stored = spark.read.schema(CACHE).parquet(cache_path)
        near = cache.cache_hits(vectors.select(F.col("id").alias("probe_id"), "embedding"), stored).filter("hit")
        first = stored.groupBy("id").agg(F.min("table_data").alias("table_data"))
        found = near.join(first, F.col("best_id") == F.col("id")).join(wanted.select("probe_id", "run_id"), "probe_id")
        n = F.coalesce(F.size(F.from_json("table_data", "entities array<string>")["entities"]), F.lit(0)).cast("long")
        cached = cut(found.select("run_id", "table_data", n.alias("n_entities")))
    fresh = wanted.join(cached.select("run_id"), "run_id", "left_anti")

    types = None
    if isinstance(plan, DataFrame):
        fields = F.transform(F.array_sort(F.collect_list(F.struct("ord", "field"))), lambda x: x["field"])
        plans = plan.groupBy("run_id").agg(F.lit("").alias("entity_type"), fields.alias("fields")).join(fresh.select("run_id", F.col("planned").alias("search_queries")), "run_id")
        asked = cut(fresh.select("run_id", "query", "planned"))
        errors = spark.createDataFrame([], "run_id string, stage int, message string")
    else:
        made = cut(parse_plans(cut(plan.plan(fresh.select("run_id", "query")))))
        plan, types = cut(plan_rows(made)), made.select("run_id", "entity_type")
        plans = made.select("run_id", "entity_type", F.transform("fields", lambda x: x["field"]).alias("fields"), "search_queries")
        asked = cut(fresh.drop("planned").join(made.select("run_id", F.col("search_queries").alias("planned")), "run_id").select("run_id", "query", "planned"))
        errors = fresh.join(made.select("run_id"), "run_id", "left_anti").select("run_id", F.lit(1).alias("stage"), F.lit("Planning failed").alias("message"))

    hits = _first_hits(asked, searcher)
    fetched = _read_pages(hits, fetcher)
    usable = cut(pages.usable_pages(fetched))
    read = cut(route.page_batches(usable.select("run_id", "page_ord", "url", "content", "sections")))
    prompts = cut(_prompts(read, plan, types))

    replies = _asked(extractor, prompts)
    parsed = cut(extract.parse_responses(replies))
    shards = replies.select("run_id", "batch", "failed").join(parsed.select("run_id", "batch", "n_entities"), ["run_id", "batch"])
    yields = cut(extract.top_up_plan(shards, read.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_pages"))))
    cells = cut(extract.build_cells(parsed, plan, prompts.select("run_id", "batch", "url")))
    # The first batch again; entities of a name that is there already don't count.
    again = prompts.filter("batch = 0").withColumn("batch", F.lit(TOP_UP_BATCH).cast("long"))
    plain = _asked(extractor, again.join(yields.filter("tops_up AND NOT falls_back"), "run_id", "left_semi"))
    other = _asked(fallback or extractor, again.join(yields.filter("falls_back"), "run_id", "left_semi"))
    more = cut(plain.unionByName(other))
    parsed_more = cut(extract.parse_responses(more))
    seen = cells.select("run_id", F.lower("name").alias("seen")).distinct()
    new = extract.build_cells(parsed_more, plan, again.select("run_id", "batch", "url"))
    new = new.join(seen, (new["run_id"] == seen["run_id"]) & (F.lower(new["name"]) == F.col("seen")), "left_anti")
    cells = cut(cells.unionByName(new))
    empty = yields.join(more.select("run_id", F.col("failed").alias("failed_again")), "run_id", "left").join(cells.select("run_id").distinct(), "run_id", "left_anti")
    refused = empty.filter((F.col("n_failures") > 0) | F.coalesce("failed_again", F.lit(False)))
    errors = cut(errors.unionByName(refused.select("run_id", F.lit(4).alias("stage"), F.lit("Extraction unavailable").alias("message"))))

    numbered = F.dense_rank().over(Window.partitionBy("run_id").orderBy("batch", "ord"))
    numbered_cells = cells.withColumn("ent_ord", numbered.cast("long")).drop("batch", "ord")
    tables = final_tables(numbered_cells, plan, None if filler is None else _filler(filler, read))

    documents = cut(export.json_tables(tables.rows, tables.cells, tables.fields))
    n_rows = tables.rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_entities"))
    results = cut(documents.join(n_rows, "run_id").select("run_id", "table_data", "n_entities"))
    if vectors is not None:
        enough = audit.cacheable(tables.rows, tables.cells, tables.fields).filter("cacheable").select("run_id")
        saved = results.join(enough, "run_id", "left_semi").join(wanted, "run_id").join(vectors.withColumnRenamed("id", "probe_id"), "probe_id")
        cache.append(cache_path, saved.select(F.xxhash64("run_id", "query").alias("id"), F.col("query").alias("query_text"), "embedding", "table_data"))

    kept = tables.fields.filter("kept").select("run_id", "field")
    gone = plan.filter(F.lower("field") != "name").join(kept, ["run_id", "field"], "left_anti").groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "field"))), lambda x: x["field"]).alias("dropped"))
    counts = asked.select("run_id")
    for name, rows in (("n_urls", hits), ("n_pages", usable), ("n_records", numbered_cells.select("run_id", "ent_ord").distinct())):
        counts = counts.join(rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(name)), "run_id", "left").fillna(0, [name])
    counts = counts.join(gone, "run_id", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<string>")))
    shown = pages.source_rows(fetched, keep=("run_id", "page_ord")).withColumnRenamed("page_ord", "ord")
    told = events.run_events(wanted.select("run_id"), plans, shown, cut(counts), results, errors, cached)
    return Run(tables, hits, usable, parsed, results, cut(told), errors)
