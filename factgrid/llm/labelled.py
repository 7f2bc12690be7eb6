"""Bounded samples of labelled rows, for what is fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out


#: Bytes of texts of one class that are fitted on at most.
FIT_BYTES = 64_000_000


def sample(
    docs: DataFrame, labels: DataFrame, target: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", fit_bytes: int = FIT_BYTES
) -> tuple[list[str], list[int], float]:
    """(texts, labels, share of label 1) of up to per_class ids of each label that are not held out, with fit_bytes of text at most.

    The ids are those that hash lowest, so the sample is the same each time; of an id's rows, it has the text that sorts first. The share is
    counted over all labelled rows that are not held out. Null labels and labels other than 0 and 1 count as none;
    an id with both labels counts as 1.
    """
    usable: Column = F.col(target).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))
    known = labels.select(id_col, F.col(target).cast("int").alias(target)).filter(usable).groupBy(id_col).agg(F.max(target).alias("__y"))
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    total = sum(counts.values())
    if not total:
        return [], [], 0.5
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("__y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("__t")).join(F.broadcast(chosen), id_col).groupBy("__y", id_col).agg(F.min("__t").alias("__t"))
    # Not more than per_class rows a class, so that the window is small.
    upto = F.sum(F.octet_length("__t").cast("long")).over(Window.partitionBy("__y").orderBy(F.xxhash64(id_col), id_col))
    rows = sorted(texts.withColumn("__upto", upto).filter(F.col("__upto") <= fit_bytes).select(id_col, "__t", "__y").collect())
    return [r["__t"] for r in rows], [r["__y"] for r in rows], counts.get(1, 0) / total
