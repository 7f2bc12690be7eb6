"""Helpers that the operators share: table access, cuts of lineage in the shared folder, label splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgrid.plans.materialize import cut
from factgrid.plans.ship import ship_package

#: Fixed value: the white space of the contracts, `[\x20\x09-\x0D]`, which is also what bytes.split() splits on.
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"

#: Rows that are Python objects at once.
STEP_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """A cut in the shared folder, of a plan that may run this package's functions."""
    ship_package(df.sparkSession)
    return cut(df)


def map_rows(df: DataFrame, fn: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """mapInArrow with one dict of columns (lists) for each record batch.

    fn is called once for each task and returns the function that maps batches, so that
    caches live as long as the task does.
    """
    ship_package(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                out = step({c: part.column(i).to_pylist() for i, c in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def free_prefix(df: DataFrame, prefix: str) -> str:
    """prefix, longer by as many underscores as it takes for no column of df to begin with it."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 0 by 5: rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
