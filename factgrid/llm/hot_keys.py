"""Joins of which one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than one such part of the rows; so there are fewer hot keys than that number.
HOT_SHARE = 256
#: Parts that the rows of a hot key are dealt into, where what they are joined with is too large for a broadcast.
SALTS = 64


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one row for each key and in `count` the number of its rows in left.

    Keys with more than 1 / HOT_SHARE of all those rows, fewer than HOT_SHARE keys, are broadcast, so that their rows stay
    where they are; the others are shuffled. right is read several times: a cut. Null keys match nothing.
    """
    total, most = right.agg(F.sum(count), F.max(count)).first()
    if not total or most * HOT_SHARE <= total:
        return left.join(right, keys, how)
    is_hot = F.col(count) * HOT_SHARE > total
    hot = F.broadcast(right.filter(is_hot))
    rest = left.join(F.broadcast(right.filter(is_hot).select(*keys)), keys, "left_anti").join(right.filter(~is_hot), keys, how)
    return left.join(hot, keys).unionByName(rest)


def join_salted(left: DataFrame, right: DataFrame, key: str, spread: str, counted: DataFrame) -> DataFrame:
    """left joined with right, which has one row of any size for each key. counted: a cut with as many rows of each key as left.

    Rows of a hot key in left are dealt by the hash of column `spread` into SALTS parts, each with a copy of that key's row.
    """
    counts = counted.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    if not total or most * HOT_SHARE <= total:
        return left.join(right, key)
    hot = F.broadcast(counts.filter(F.col("__n") * HOT_SHARE > total).select(key, F.lit(True).alias("__hot")))
    dealt = left.join(hot, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("__hot")
    copies = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    copied = right.join(hot, key, "left").withColumn("__salt", copies).drop("__hot")
    return dealt.join(copied, [key, "__salt"]).drop("__salt")
