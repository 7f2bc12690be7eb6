"""Near-duplicate entities of a run: matching names, greedy groups, best values.

Cells are the long form of entities: run_id, ent_ord, name, field, value (null: absent), source_url, snippet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgrid.functions.text import has_value, name_norm
from factgrid.plans.materialize import cut, discard
from factgrid.plans.ship import ship_package

#: Share of the longer normal form that the shorter must have, in tenths.
MIN_RATIO_TENTHS = 7
#: Rounds after which one task decides all open edges of a run, if they are no more than so many.
ROUNDS, TASK_EDGES = 6, 1_000_000


def names(cells: DataFrame) -> DataFrame:
    """Entities with their normal form: run_id, ent_ord, name, norm."""
    return cells.groupBy("run_id", "ent_ord").agg(F.first("name").alias("name")).withColumn("norm", name_norm(F.col("name")))


def name_classes(entities: DataFrame) -> DataFrame:
    """One row for each non-empty normal form of a run, at its first entity: run_id, norm, ord."""
    return entities.filter("norm <> ''").groupBy("run_id", "norm").agg(F.min("ent_ord").alias("ord"))


def match_edges(classes: DataFrame) -> DataFrame:
    """Pairs of normal forms of a run where one holds the other, and the lengths are near enough.

    Blocked by substrings: of a name, those of the lengths that other names of the run have, if long enough, are looked up as whole
    names by their hashes, so the join has an equality key and no pair is compared that doesn't match. Only hashes are
    exploded; the names meet once the pair is found. Returns run_id, norm_a (the longer), ord_a, norm_b, ord_b.
    """
    n = F.length("norm")
    lengths = classes.groupBy("run_id").agg(F.sort_array(F.collect_set(n)).alias("lengths"))  # as many as the longest name has characters
    near = F.filter("lengths", lambda k: (k < n) & (k * 10 >= n * MIN_RATIO_TENTHS))
    inside = F.flatten(F.transform(near, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda s: F.xxhash64(k, F.substring(F.col("norm"), s, k)))))
    parts = classes.join(lengths, "run_id").select("run_id", F.col("ord").alias("ord_a"), F.explode(F.array_distinct(inside)).alias("hash"))
    whole = classes.select("run_id", F.col("ord").alias("ord_b"), F.xxhash64(n, "norm").alias("hash"))
    pairs = parts.join(whole, ["run_id", "hash"]).select("run_id", "ord_a", "ord_b")
    named = pairs.join(classes.select("run_id", F.col("ord").alias("ord_a"), F.col("norm").alias("norm_a")), ["run_id", "ord_a"])
    named = named.join(classes.select("run_id", F.col("ord").alias("ord_b"), F.col("norm").alias("norm_b")), ["run_id", "ord_b"])
    return named.filter(F.contains("norm_a", F.col("norm_b"))).select("run_id", "norm_a", "ord_a", "norm_b", "ord_b")


def _decided_in_order(edges: pd.DataFrame) -> pd.DataFrame:
    """(run_id, ord, is_pivot) of all edges (run_id, ord, before, is_pivot of what is decided before it) of a run, one after the other."""
    known = edges[edges["is_pivot"].notna()]
    pivots = dict(zip(known["before"], known["is_pivot"].astype(bool), strict=True))
    found: dict[int, bool] = {}
    for at, before in edges.sort_values(["ord", "before"]).groupby("ord")["before"]:
        found[at] = pivots[at] = not any(pivots[x] for x in before)
    return pd.DataFrame({"run_id": edges["run_id"].iloc[0], "ord": list(found), "is_pivot": list(found.values())}).astype({"ord": "int64", "is_pivot": bool})


def greedy_groups(entities: DataFrame) -> DataFrame:
    """Adds pivot, the first entity of each group, to entities.

    In order, an entity that no pivot has taken becomes a pivot and takes all later ones that match it, not
    those that match its members. Equivalently: a form is a pivot if and only if no earlier
    neighbour is one, which rounds of joins decide; only forms with neighbours take part, and a round reads only the edges
    that are still open. After ROUNDS of them, runs with few open edges are decided by one task each.
    Empty normal forms match nothing and stay alone.
    """
    ship_package(entities.sparkSession)
    classes = name_classes(entities)
    edges = match_edges(classes)
    earlier = cut(edges.select("run_id", F.greatest("ord_a", "ord_b").alias("ord"), F.least("ord_a", "ord_b").alias("before")))
    later = earlier.select("run_id", "ord").distinct()
    first = earlier.select("run_id", F.col("before").alias("ord")).distinct().join(later, ["run_id", "ord"], "left_anti")
    new = cut(first.withColumn("is_pivot", F.lit(True)))
    decided, open_edges, rounds = [new], earlier, 0
    while not open_edges.isEmpty():
        rounds += 1
        if rounds > ROUNDS:
            small = open_edges.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= TASK_EDGES).select("run_id")
            own = open_edges.join(small, "run_id", "left_semi").join(new.withColumnRenamed("ord", "before"), ["run_id", "before"], "left")
            decided.append(cut(own.groupBy("run_id").applyInPandas(_decided_in_order, "run_id string, ord long, is_pivot boolean")))
            open_edges = cut(open_edges.join(small, "run_id", "left_anti"))
            rounds = 0
            continue
        state = open_edges.join(new.withColumnRenamed("ord", "before"), ["run_id", "before"], "left")
        # Taken by a pivot; or a pivot itself, once all its earlier neighbours are known not to be one.
        of_form = state.groupBy("run_id", "ord").agg(F.bool_or(F.coalesce("is_pivot", F.lit(False))).alias("taken"), F.bool_or(F.col("is_pivot").isNull()).alias("waits"))
        new = cut(of_form.filter("taken OR NOT waits").select("run_id", "ord", (~F.col("taken")).alias("is_pivot")))
        decided.append(new)
        last, open_edges = open_edges, cut(state.filter("is_pivot IS NULL").select("run_id", "ord", "before").join(new, ["run_id", "ord"], "left_anti"))
        if last is not earlier:
            discard(last)
    every = decided[0]
    for part in decided[1:]:
        every = every.unionByName(part)
    pivots = cut(every.filter("is_pivot").select("run_id", "ord"))
    discard(*decided)
    taken = earlier.join(pivots.withColumnRenamed("ord", "before"), ["run_id", "before"], "left_semi").groupBy("run_id", "ord").agg(F.min("before").alias("pivot"))
    members = taken.join(pivots, ["run_id", "ord"], "left_anti")
    of_class = classes.join(members, ["run_id", "ord"], "left").select("run_id", "norm", F.coalesce("pivot", "ord").alias("pivot"))
    return entities.join(of_class, ["run_id", "norm"], "left").select("run_id", "ent_ord", "name", "norm", F.coalesce("pivot", "ent_ord").alias("pivot"))


def is_grounded(value: Column, snippet: Column) -> Column:
    """The quoted snippet holds the value, in any case."""
    return (F.coalesce(snippet, F.lit("")) != "") & F.coalesce(F.contains(F.lower(snippet), F.lower(value)), F.lit(False))


def best_values(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The best-evidenced value of each keys group: grounded, then quoted, then shortest, then first."""
    order = F.struct(~is_grounded(F.col("value"), F.col("snippet")), F.coalesce("snippet", F.lit("")) == "", F.length("value"), "ent_ord")
    best = F.min_by(F.struct("value", "source_url", "snippet"), order).alias("b")
    return cells.filter(has_value(F.col("value"))).groupBy(*keys).agg(best).select(*keys, "b.*")


def merge_entities(cells: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, cells) after merging: run_id, ent_ord, name, and the best cell for each planned field but `name`.

    A group is named by its member with the most attributes, blank ones included, the first on ties.
    """
    grouped = greedy_groups(names(cells)).select("run_id", "ent_ord", "pivot")
    counted = cells.groupBy("run_id", "ent_ord").agg(F.first("name").alias("name"), F.count("value").alias("n"))
    named = counted.join(grouped, ["run_id", "ent_ord"]).groupBy("run_id", "pivot").agg(F.max_by("name", F.struct("n", -F.col("ent_ord"))).alias("name"))
    planned = plan.filter(F.lower("field") != "name").select("run_id", "field")
    best = best_values(cells.join(planned, ["run_id", "field"], "left_semi").join(grouped, ["run_id", "ent_ord"]), ["run_id", "pivot", "field"])
    return named.withColumnRenamed("pivot", "ent_ord").select("run_id", "ent_ord", "name"), best.withColumnRenamed("pivot", "ent_ord")


