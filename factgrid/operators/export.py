"""Final tables as CSV lines, JSON documents and confidence bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of markup, the ampersand first.
HTML_ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}
#: Least confidence of the bands, in order.
BANDS = (("hi", 0.75), ("mid", 0.55))


def confidence_band(confidence: Column) -> Column:
    band = F.lit("lo")
    for name, least in reversed(BANDS):
        band = F.when(confidence >= least, name).otherwise(band)
    return band


def quoted(c: Column) -> Column:
    """A CSV field: always in quotes, quotes doubled, null as empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def html_escaped(c: Column) -> Column:
    """Text for a page: the five characters of markup as entities, null as empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for sign, entity in HTML_ENTITIES.items():
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def heading(field: Column) -> Column:
    """A field's name as a column heading."""
    return F.replace(field, F.lit("_"), F.lit(" "))


def csv_lines(rows: DataFrame, cells: DataFrame, fields: DataFrame) -> DataFrame:
    """run_id, position, line: a header at position 0, then a line for each row: name, fields in order, confidence.

    rows: run_id, ent_ord, name, confidence, position. fields: run_id, ord, field, kept.
    """
    ordered = fields.filter("kept").groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "field"))), lambda x: x["field"]).alias("fields"))
    header = ordered.join(rows.select("run_id").distinct(), "run_id", "left_semi").select(
        "run_id", F.lit(0).cast("long").alias("position"), F.array_join(F.transform(F.concat(F.array(F.lit("name")), "fields", F.array(F.lit("confidence"))), quoted), ",").alias("line")
    )
    values = cells.groupBy("run_id", "ent_ord").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("values"))
    full = rows.join(ordered, "run_id").join(values, ["run_id", "ent_ord"], "left")
    parts = F.concat(F.array(quoted(F.col("name"))), F.transform("fields", lambda f: quoted(F.try_element_at("values", f))), F.array(quoted(F.format_number("confidence", 2))))
    return header.unionByName(full.select("run_id", "position", F.array_join(parts, ",").alias("line")))


def json_tables(rows: DataFrame, cells: DataFrame, fields: DataFrame) -> DataFrame:
    """run_id, table_data: a final table as one JSON document, rows by position, cells by field order."""
    at = fields.filter("kept").select("run_id", "field", "ord")
    of_row = cells.join(at, ["run_id", "field"]).groupBy("run_id", "ent_ord").agg(F.array_sort(F.collect_list(F.struct("ord", "field", "value", "source_url", "snippet"))).alias("cells"))
    listed = F.transform("cells", lambda c: F.struct(c["field"].alias("field"), c["value"].alias("value"), c["source_url"].alias("source_url"), c["snippet"].alias("source_snippet")))
    entities = rows.join(of_row, ["run_id", "ent_ord"], "left").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("position", "name", "confidence", listed.alias("cells")))).alias("entities"))
    return entities.select("run_id", F.to_json(F.struct("run_id", "entities")).alias("table_data"))
