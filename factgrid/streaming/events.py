"""Progress events of runs: frames for clients, and fetches that settle or are abandoned, as streams and as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgrid.operators.pages import DEADLINE_MS

#: Events of a run; an error ends it.
EVENTS = ["status", "plan", "source", "results", "done", "error"]
#: For stages 1 to 5, the last event in the order of run_events that stands before an error of that stage.
LAST_BEFORE_ERROR = [1, 3, 6, 8, 10]


def frames(events: DataFrame) -> DataFrame:
    """events (run_id, seq, event, data) with frame, `event: X\\ndata: JSON\\n\\n`. Works on streams."""
    return events.withColumn("frame", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), "data", F.lit("\n\n")))


def run_events(requests: DataFrame, plans: DataFrame, sources: DataFrame, counts: DataFrame, results: DataFrame, errors: DataFrame, cached: DataFrame) -> DataFrame:
    """The events of runs in order: run_id, seq, event, data (JSON).

    requests: run_id. plans: run_id, entity_type, fields, search_queries. sources: run_id, ord and the columns shown of each. counts: run_id,
    n_urls, n_pages, n_records, dropped (array). results, cached: run_id, table_data, n_entities. errors: run_id, stage (the one that
    failed, 1 to 5), message; an error ends the run. A run of `cached` goes from the cache to its end.
    """

    def made(rows: DataFrame, at: int, event: str, data: Column, within: Column | None = None) -> DataFrame:
        own = F.lit(0).cast("long") if within is None else within.cast("long")
        return rows.select("run_id", F.lit(at).alias("at"), own.alias("own"), F.lit(event).alias("event"), data.alias("data"))

    def status(rows: DataFrame, at: int, stage: int, message: Column | str) -> DataFrame:
        return made(rows, at, "status", F.to_json(F.struct(F.lit(stage).alias("stage"), (F.lit(message) if isinstance(message, str) else message).alias("message"))))

    def counted(column: str, before: str, behind: str) -> Column:
        return F.concat(F.lit(before), F.col(column).cast("string"), F.lit(behind))

    fresh = requests.join(cached.select("run_id"), "run_id", "left_anti").select("run_id")
    table = F.to_json(F.struct(F.col("table_data").alias("table"), F.col("n_entities").alias("entity_count")))
    dropped = counts.filter(F.size("dropped") > 0)
    shown = F.to_json(F.struct(*[c for c in sources.columns if c not in ("run_id", "ord")]))
    parts = [
        status(requests, 0, 0, "Checking the cache"),
        status(cached, 1, 1, "Found in the cache"),
        status(fresh, 1, 1, "Planning"),
        made(plans, 2, "plan", F.to_json(F.struct("entity_type", F.col("fields").alias("schema_fields"), "search_queries"))),
        status(fresh, 3, 2, "Searching"),
        status(counts, 4, 2, counted("n_urls", "Found ", " addresses")),
        status(fresh, 5, 3, "Reading pages"),
        made(sources, 6, "source", shown, F.col("ord")),
        status(counts, 7, 3, counted("n_pages", "Read ", " pages")),
        status(fresh, 8, 4, "Extracting"),
        status(counts, 9, 4, counted("n_records", "Extracted ", " records")),
        status(fresh, 10, 5, "Merging and scoring"),
        status(dropped, 11, 5, F.concat(F.lit("Dropped "), F.size("dropped").cast("string"), F.lit(" columns: "), F.array_join("dropped", ", "))),
        made(results.unionByName(cached), 12, "results", table),
        made(requests, 13, "done", F.to_json(F.struct(F.lit("Done").alias("message")))),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # An error takes the place of what follows the start of its stage.
    stops = errors.groupBy("run_id").agg(F.min_by(F.struct("stage", "message"), "stage").alias("e")).select("run_id", F.element_at(F.array(*map(F.lit, LAST_BEFORE_ERROR)), F.col("e.stage")).alias("last"), "e.message")
    told = made(stops, 99, "error", F.to_json(F.struct("message")))
    every = every.join(stops.select("run_id", "last"), "run_id", "left").filter(F.col("last").isNull() | (F.col("at") <= F.col("last"))).drop("last").unionByName(told)
    seq = F.row_number().over(Window.partitionBy("run_id").orderBy("at", "own")) - 1
    return every.select("run_id", seq.cast("long").alias("seq"), "event", "data")


def until_error(events: DataFrame) -> DataFrame:
    """Events up to the first error of each run."""
    first = events.filter("event = 'error'").groupBy("run_id").agg(F.min("seq").alias("last"))
    return events.join(first, "run_id", "left").filter(F.col("last").isNull() | (F.col("seq") <= F.col("last"))).drop("last")


def parse_frames(text: Column) -> Column:
    """Complete frames of a client's buffer as array<struct<event, data>>; without data that is no JSON, without the tail."""
    whole = F.split(F.regexp_replace(text, r"(?s)(^|\n\n)[^\n]*(?:\n(?!\n)[^\n]*)*$", "$1"), "\n\n")
    parsed = F.transform(whole, lambda b: F.struct(F.regexp_extract(b, r"(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract(b, r"(?m)^data: (.*)$", 1).alias("data")))
    return F.filter(parsed, lambda x: (x["event"] != "") & F.try_parse_json(x["data"]).isNotNull())


def settled(fetches: DataFrame, deadline_ms: int = DEADLINE_MS) -> DataFrame:
    """fetches with status: how they settled, or `timeout` beyond the deadline. fetches: run_id, url, fetch_ts, elapsed_ms, settle_status."""
    return fetches.withColumn("status", F.when(F.col("elapsed_ms") <= deadline_ms, F.col("settle_status")).otherwise("timeout"))


def source_feed(fetches: DataFrame, deadline_ms: int = DEADLINE_MS) -> DataFrame:
    """Counters of each run: n_fetching, n_ok, n_error, n_timeout."""
    s = settled(fetches, deadline_ms)
    return s.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_fetching"), *[F.count_if(F.col("status") == x).alias(f"n_{x}") for x in ("ok", "error", "timeout")])


def settle_stream(started: DataFrame, ended: DataFrame, deadline_ms: int = DEADLINE_MS, lateness: str = "1 minute") -> DataFrame:
    """Stream of started fetches with their end, or status `timeout` once the watermark has passed the deadline.

    started: run_id, url, fetch_ts. ended: run_id, url, end_ts, settle_status. Batch tables give the same
    rows. State holds only fetches whose deadline the watermark hasn't passed.
    """
    a = started.withWatermark("fetch_ts", lateness)
    b = ended.select(F.col("run_id").alias("e_run"), F.col("url").alias("e_url"), "end_ts", "settle_status").withWatermark("end_ts", lateness)
    wait = F.expr(f"INTERVAL '{deadline_ms / 1000}' SECOND")
    on = (F.col("run_id") == F.col("e_run")) & (F.col("url") == F.col("e_url")) & (F.col("end_ts") >= F.col("fetch_ts")) & (F.col("end_ts") <= F.col("fetch_ts") + wait)
    return a.join(b, on, "leftOuter").select("run_id", "url", "fetch_ts", "end_ts", F.coalesce("settle_status", F.lit("timeout")).alias("status"))


def write_frames(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Starts a query that appends the frames of an event stream to Parquet files, exactly once for each batch; with once, of what is there now."""
    writer = frames(stream).select("run_id", F.col("frame").alias("value")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
