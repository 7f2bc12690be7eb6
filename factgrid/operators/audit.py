"""Columns, confidence and the final table: fill ratios, column audit, cell scores, rows against columns.

entities: run_id, ent_ord, name. cells: run_id, ent_ord, field, value, source_url, snippet. plan: run_id, ord, field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgrid.functions.text import domain, has_value, is_trusted, round_exact, value_norm

#: Fixed values of the audit.
MIN_FILL_RATIO, MIN_COLUMNS, MIN_ROWS = 0.5, 3, 3
#: Fixed values of the score, in hundredths.
BASE, GROUNDED, PARTIAL, AGREEMENT, MAX_AGREEMENT, PROVENANCE = 35, 35, 10, 10, 20, 10
LOW_CONFIDENCE = 55
UNGROUNDED_REASON, UNQUOTED_REASON, SINGLE_REASON = "value not found verbatim in the quoted snippet", "no supporting quote from the page", "reported by a single source"


def valued(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """Cells with a value, of planned fields."""
    return cells.filter(has_value(F.col("value"))).join(plan.select("run_id", "field"), ["run_id", "field"], "left_semi")


def fill_ratio(entities: DataFrame, cells: DataFrame, plan: DataFrame) -> DataFrame:
    """run_id, ord, field, n_filled, n_rows, fill: over rows with any value, or over all rows where none has one."""
    have = valued(cells, plan)
    rows = entities.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_all"))
    populated = have.groupBy("run_id").agg(F.count_distinct("ent_ord").alias("n_populated"))
    filled = have.groupBy("run_id", "field").agg(F.count_distinct("ent_ord").alias("n_filled"))
    n = F.coalesce("n_populated", "n_all")
    return (
        plan.select("run_id", "ord", "field")
        .join(rows, "run_id")
        .join(populated, "run_id", "left")
        .join(filled, ["run_id", "field"], "left")
        .select("run_id", "ord", "field", F.coalesce("n_filled", F.lit(0)).cast("long").alias("n_filled"), n.cast("long").alias("n_rows"))
        .withColumn("fill", F.col("n_filled") / F.col("n_rows"))
    )


def audit_columns(entities: DataFrame, cells: DataFrame, plan: DataFrame) -> DataFrame:
    """fill_ratio with `kept`: at least half filled, or the three best where fewer than three are.

    Runs without entities keep every column.
    """
    ratios = fill_ratio(entities, cells, plan)
    run = Window.partitionBy("run_id")
    best = F.row_number().over(run.orderBy(F.desc("fill"), "ord"))
    enough = F.count_if(F.col("fill") >= MIN_FILL_RATIO).over(run) >= MIN_COLUMNS
    audited = ratios.withColumn("kept", F.when(enough, F.col("fill") >= MIN_FILL_RATIO).otherwise(best <= MIN_COLUMNS))
    idle = plan.select("run_id", "ord", "field").join(entities.select("run_id").distinct(), "run_id", "left_anti")
    return audited.unionByName(idle.withColumn("kept", F.lit(True)), allowMissingColumns=True)


def drop_empty(entities: DataFrame, cells: DataFrame, plan: DataFrame) -> DataFrame:
    """Entities with a value in any planned field."""
    return entities.join(valued(cells, plan).select("run_id", "ent_ord"), ["run_id", "ent_ord"], "left_semi")


def agreement(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """run_id, field, norm, agreement_count: domains that report a value, over the whole table of a run."""
    have = valued(cells, plan).select("run_id", "field", value_norm(F.col("value")).alias("norm"), F.lower(domain(F.col("source_url"))).alias("domain"))
    return have.groupBy("run_id", "field", "norm").agg(F.greatest(F.count_distinct("domain"), F.lit(1)).alias("agreement_count"))


def score_cells(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """Valued cells with agreement_count, confidence and confidence_reason.

    A score is counted in hundredths, so that no sum of doubles is rounded.
    """
    have = valued(cells, plan).withColumn("norm", value_norm(F.col("value")))
    scored = have.join(agreement(cells, plan), ["run_id", "field", "norm"])
    quote = F.coalesce(value_norm(F.col("snippet")), F.lit(""))
    grounded = (quote != "") & (F.col("norm") != "") & F.contains(quote, F.col("norm"))
    several = F.col("agreement_count") > 1
    points = (
        F.lit(BASE)
        + F.when(grounded, GROUNDED).when(quote != "", PARTIAL).otherwise(0)
        + F.when(several, F.least(AGREEMENT * (F.col("agreement_count") - 1), F.lit(MAX_AGREEMENT))).otherwise(0)
        + F.when(is_trusted(F.col("source_url")), PROVENANCE).otherwise(0)
    )
    points = F.least(points, F.lit(100))
    why = F.concat_ws("; ", F.when(grounded, None).when(quote != "", UNGROUNDED_REASON).otherwise(UNQUOTED_REASON), F.when(~several, SINGLE_REASON))
    return scored.select(
        "run_id", "ent_ord", "field", "value", "source_url", "snippet", "agreement_count",
        (points / F.lit(100.0)).alias("confidence"), F.when(points < LOW_CONFIDENCE, why).otherwise("").alias("confidence_reason"),
    )


def score_rows(entities: DataFrame, scored: DataFrame, plan: DataFrame) -> DataFrame:
    """Entities with confidence: the mean of their cells' in the order of fields, 0 without cells."""
    of_row = scored.join(plan.select("run_id", "field", "ord"), ["run_id", "field"]).groupBy("run_id", "ent_ord").agg(F.array_sort(F.collect_list(F.struct("ord", "confidence"))).alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda s, x: s + x["confidence"])
    mean = round_exact(total / F.size("c"))
    return entities.join(of_row.select("run_id", "ent_ord", mean.alias("confidence")), ["run_id", "ent_ord"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def missing_rank(entities: DataFrame, cells: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields with drop_rank, entities with missing): columns leave in the order of drop_rank, least filled first.

    missing is the highest drop_rank of the fields that an entity lacks, 0 if it has all: the entity is complete once so
    many columns have left. Fill is over all entities and doesn't change while columns leave.
    """
    have = valued(cells, plan).select("run_id", "ent_ord", "field").distinct().join(entities.select("run_id", "ent_ord"), ["run_id", "ent_ord"], "left_semi")
    filled = have.groupBy("run_id", "field").agg(F.count(F.lit(1)).alias("n_filled"))
    ranked = (
        plan.select("run_id", "ord", "field")
        .join(filled, ["run_id", "field"], "left")
        .withColumn("drop_rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.coalesce("n_filled", F.lit(0)), "ord")))
        .select("run_id", "ord", "field", "drop_rank")
    )
    # Of an entity's ranks, the highest that is absent: all planned ranks less those it has.
    own = have.join(ranked, ["run_id", "field"]).groupBy("run_id", "ent_ord").agg(F.collect_set("drop_rank").alias("own"))
    size = ranked.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("n_fields"))
    lacking = F.array_except(F.sequence(F.lit(1), F.col("n_fields")), F.coalesce("own", F.array().cast("array<int>")))
    missing = entities.join(size, "run_id").join(own, ["run_id", "ent_ord"], "left").withColumn("missing", F.coalesce(F.array_max(lacking), F.lit(0))).drop("own")
    return ranked, missing


def ladder(missing: DataFrame) -> DataFrame:
    """Rungs of each run: run_id, dropped, n_columns, n_rows, best. The best holds most cells with at least three rows.

    Where no rung has three rows, the one with most rows, then most columns, is best.
    """
    at = missing.groupBy("run_id", "n_fields", F.col("missing").alias("dropped")).agg(F.count(F.lit(1)).alias("n"))
    rungs = missing.select("run_id", "n_fields").distinct().select("run_id", "n_fields", F.explode(F.sequence(F.lit(0), F.col("n_fields") - 1)).alias("dropped"))
    run = Window.partitionBy("run_id")
    n_rows = F.sum(F.coalesce("n", F.lit(0))).over(run.orderBy("dropped"))
    columns = F.col("n_fields") - F.col("dropped")
    rungs = rungs.join(at, ["run_id", "n_fields", "dropped"], "left").select("run_id", "dropped", columns.cast("long").alias("n_columns"), n_rows.cast("long").alias("n_rows"))
    wins = F.col("n_rows") >= MIN_ROWS
    rank = F.struct(wins, F.when(wins, F.col("n_rows") * F.col("n_columns")).otherwise(F.col("n_rows")), "n_columns")
    return rungs.withColumn("best", F.row_number().over(run.orderBy(F.desc(rank))) == 1)


def finalize(entities: DataFrame, cells: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, fields): the rows that are complete on the best rung, with position, and fields with `kept`.

    entities need confidence; rows are in order of it, then of ent_ord. Where no row is
    complete on the best rung, the three fullest with any value stay.
    """
    ranked, missing = missing_rank(entities, cells, plan)
    chosen = ladder(missing).filter("best").select("run_id", F.col("dropped").alias("n_dropped"), F.col("n_rows").alias("n_complete"))
    fields = ranked.join(chosen, "run_id", "left").select("run_id", "ord", "field", (F.col("drop_rank") > F.coalesce("n_dropped", F.lit(0))).alias("kept"))
    kept_cells = valued(cells, fields.filter("kept")).groupBy("run_id", "ent_ord").agg(F.count_distinct("field").alias("n_filled"))
    rows = missing.join(chosen, "run_id").join(kept_cells, ["run_id", "ent_ord"], "left")
    complete = rows.filter((F.col("n_complete") > 0) & (F.col("missing") <= F.col("n_dropped")))
    # Each task goes on with the fullest it has seen of a run, so no run is sorted whole for these.
    fullest = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n_filled"), "ent_ord"))
    fallback = rows.filter((F.col("n_complete") <= 0) & F.col("n_filled").isNotNull()).withColumn("full", fullest).filter(F.col("full") <= MIN_ROWS).drop("full")
    position = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("confidence"), "ent_ord"))
    return complete.unionByName(fallback).withColumn("position", position.cast("long")).select("run_id", "ent_ord", "name", "confidence", "position"), fields


def cacheable(rows: DataFrame, cells: DataFrame, fields: DataFrame, least: float = 0.7) -> DataFrame:
    """run_id, n_rows, mean_fill, cacheable: whether a final table is filled enough to be reused."""
    kept = fields.filter("kept")
    n = kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_fields"))
    filled = valued(cells, kept).join(rows.select("run_id", "ent_ord"), ["run_id", "ent_ord"], "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_filled"))
    counted = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))
    mean = F.coalesce("n_filled", F.lit(0)) / (F.col("n_rows") * F.col("n_fields"))
    return counted.join(n, "run_id").join(filled, "run_id", "left").select("run_id", "n_rows", mean.alias("mean_fill"), (mean >= least).alias("cacheable"))
