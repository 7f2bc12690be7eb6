"""Small documents with what real ones hold: nulls, empty texts, ties, repeats."""

from __future__ import annotations

from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Documents from (id, text) or (id, text, lang, source)."""
    full = [(*r, None, None)[:4] if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOC)


ODD = [(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (None, "a null id here"), (4, "one"), (4, "one"), (5, "repeat " * 30_000), (6, "é́ 的的的 \x1c  x\n\ny"), (6, "another text of the same id"), (7, "的x" * 5000), (8, "\n" * 20_000)]
