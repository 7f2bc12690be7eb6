"""Routing of page sections to a reader: by plan keywords, or by the names of entities with holes.

sections: run_id, page_ord, url, sec_ord, text, and where known sec_id, heading. plan: run_id, ord, field, synonyms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgrid.functions.text import has_value

#: Fixed values of routing.
SECTIONS_PER_PAGE, FALLBACK_SECTIONS, SECTION_CHARS = 3, 2, 700
GAP_SECTION_CHARS, GAP_CONTEXT_CHARS = 900, 5000
MAX_PAGES, PAGES_PER_BATCH, ENTITIES_PER_WORKER, WORKERS = 8, 4, 5, 2
JSONLD_SECTION, JSONLD_HEADING = "sec_jsonld", "STRUCTURED DATA (schema.org)"


def keywords(plan: DataFrame, entity_types: DataFrame | None = None) -> DataFrame:
    """run_id, keyword: words of fields and synonyms in lower case, and the whole entity type; `name` doesn't count."""
    words = F.flatten(F.transform(F.concat(F.array(F.replace(F.lower("field"), F.lit("_"), F.lit(" "))), F.coalesce("synonyms", F.array().cast("array<string>"))), lambda s: F.split(F.lower(s), r"\s+")))
    out = plan.filter(F.lower("field") != "name").select("run_id", F.explode(words).alias("keyword"))
    if entity_types is not None:
        out = out.unionByName(entity_types.select("run_id", F.lower("entity_type").alias("keyword")))
    return out.filter("keyword <> ''").distinct()


def _hits(text: Column, wanted: Column) -> Column:
    """How many of the wanted strings a text holds, as substrings, in any case."""
    return F.size(F.filter(wanted, lambda k: F.contains(F.lower(text), k))).cast("long")


def section_scores(sections: DataFrame, words: DataFrame) -> DataFrame:
    """sections with score, the number of a run's keywords that the text holds.

    A run's keywords are one row, so the join is on run_id and no pair of section and keyword is made.
    """
    sets = words.groupBy("run_id").agg(F.array_sort(F.collect_set("keyword")).alias("words"))  # a plan's few words
    return sections.join(sets, "run_id", "left").withColumn("score", F.coalesce(_hits(F.col("text"), F.col("words")), F.lit(0))).drop("words")


def route_sections(sections: DataFrame, words: DataFrame) -> DataFrame:
    """The sections of each page that are read: three best by score, or the first two where none scores.

    Structured data takes no part in the contest and is always read. Order is by score, then document order. Adds
    score and slot (1, 2, 3; 0 for structured data).
    """
    scored = section_scores(sections, words)
    if "sec_id" in sections.columns:
        structured = scored.filter(F.col("sec_id") == JSONLD_SECTION).withColumn("slot", F.lit(0).cast("long"))
        scored = scored.filter(F.coalesce(F.col("sec_id") != JSONLD_SECTION, F.lit(True)))
    page = Window.partitionBy("run_id", "page_ord")
    ranked = scored.withColumn("slot", F.row_number().over(page.orderBy(F.desc("score"), "sec_ord")).cast("long"))
    ranked = ranked.withColumn("top", F.max("score").over(page))
    chosen = ranked.filter(((F.col("score") > 0) & (F.col("slot") <= SECTIONS_PER_PAGE)) | ((F.col("top") == 0) & (F.col("slot") <= FALLBACK_SECTIONS))).drop("top")
    return chosen.unionByName(structured) if "sec_id" in sections.columns else chosen


def page_prompts(routed: DataFrame) -> DataFrame:
    """run_id, page_ord, url, prompt: the text of each page as it is put before a reader."""
    heading = F.when(F.col("slot") == 0, JSONLD_HEADING).otherwise(F.col("heading")) if "heading" in routed.columns else F.when(F.col("slot") == 0, JSONLD_HEADING)
    line = F.concat(F.when(F.coalesce(heading, F.lit("")) != "", F.concat(heading, F.lit("\n"))).otherwise(""), F.left("text", F.lit(SECTION_CHARS)), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct("slot", line.alias("line"))))  # at most four sections
    joined = F.array_join(F.transform(parts, lambda p: p["line"]), "")
    return routed.groupBy("run_id", "page_ord", "url").agg(joined.alias("body")).select("run_id", "page_ord", "url", F.concat(F.lit("\n--- PAGE: "), "url", F.lit(" ---\n"), "body").alias("prompt"))


def page_batches(pages: DataFrame) -> DataFrame:
    """The first eight pages of each run in batches of four: adds batch."""
    at = F.row_number().over(Window.partitionBy("run_id").orderBy("page_ord")) - 1
    return pages.withColumn("at", at).filter(F.col("at") < MAX_PAGES).withColumn("batch", F.floor(F.col("at") / PAGES_PER_BATCH).cast("long")).drop("at")


def holes(entities: DataFrame, cells: DataFrame, plan: DataFrame) -> DataFrame:
    """run_id, name, ent_ord, missing (fields in plan order, joined by ', '), n_missing.

    Keyed by name: of entities with one name the last counts.
    """
    last = entities.groupBy("run_id", "name").agg(F.max("ent_ord").alias("ent_ord"))
    have = cells.filter(has_value(F.col("value"))).groupBy("run_id", "ent_ord").agg(F.collect_set("field").alias("have"))
    fields = plan.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "field"))), lambda x: x["field"]).alias("fields"))
    lacking = F.filter("fields", lambda f: ~F.array_contains(F.coalesce("have", F.array().cast("array<string>")), f))
    out = last.join(fields, "run_id").join(have, ["run_id", "ent_ord"], "left").withColumn("lacking", lacking).filter(F.size("lacking") > 0)
    return out.select("run_id", "name", "ent_ord", F.array_join("lacking", ", ").alias("missing"), F.size("lacking").cast("long").alias("n_missing"))


def holes_text(found: DataFrame) -> DataFrame:
    """run_id, worker, holes_text: lines `- name: missing a, b` for slices of five entities, for two workers at most."""
    at = F.row_number().over(Window.partitionBy("run_id").orderBy("ent_ord")) - 1
    sliced = found.withColumn("worker", F.floor(at / ENTITIES_PER_WORKER).cast("long")).filter(F.col("worker") < WORKERS)
    lines = F.array_sort(F.collect_list(F.struct("ent_ord", F.concat(F.lit("- "), "name", F.lit(": missing "), "missing").alias("line"))))
    return sliced.groupBy("run_id", "worker").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("holes_text"))


def gap_route(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sections that name a wanted entity, most names first, as long as all blocks together fit the budget.

    wanted: run_id, name. The running sum stops at the first block that would overflow, since
    blocks are never empty. Adds hits, slot and used, the characters up to and with the block.
    """
    names = wanted.filter(F.coalesce("name", F.lit("")) != "").groupBy("run_id").agg(F.collect_list(F.lower("name")).alias("names"))
    heading = F.coalesce("heading", F.lit("")) if "heading" in sections.columns else F.lit("")
    block = F.concat(F.lit("--- PAGE: "), "url", F.lit(" | "), heading, F.lit(" ---\n"), F.left("text", F.lit(GAP_SECTION_CHARS)), F.lit("\n"))
    pages = F.dense_rank().over(Window.partitionBy("run_id").orderBy("page_ord"))
    near = sections.withColumn("page_rank", pages).filter(F.col("page_rank") <= MAX_PAGES).drop("page_rank")
    hit = near.join(names, "run_id").withColumn("hits", _hits(F.col("text"), F.col("names"))).filter("hits > 0").drop("names")
    order = Window.partitionBy("run_id").orderBy(F.desc("hits"), "page_ord", "sec_ord")
    ranked = hit.withColumn("block", block).withColumn("slot", F.row_number().over(order).cast("long"))
    ranked = ranked.withColumn("used", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.filter(F.col("used") <= GAP_CONTEXT_CHARS)
