"""Calls to services that may fail: two attempts, short waits, plain text where a JSON mode is refused.

Failed is not the same as empty: a reply without entities is a reply.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attempts of a call, seconds to wait after a refusal for too many calls and after any other error, and what errors say then.
ATTEMPTS, RATE_WAIT_S, WAIT_S = 2, 2, 1
RATE_SIGN, JSON_SIGNS = "429", ("validate JSON", "json_validate")


def call_with_retries(call: Callable[[bool], str], json_mode: bool = True, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, bool]:
    """(body, failed) of call(json_mode), which raises what goes wrong."""
    plain = not json_mode
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return call(not plain), False
        except Exception as e:  # whatever a service or its transport raises
            if attempt < ATTEMPTS:
                plain = plain or any(sign in str(e) for sign in JSON_SIGNS)
                sleep(RATE_WAIT_S if RATE_SIGN in str(e) else WAIT_S)
    return None, True


def retry_outcomes(attempts: DataFrame) -> DataFrame:
    """What such calls come to, from a record of all attempts that could be made: run_id, batch, failed, body, n_attempts, waited_ms, plain.

    attempts: run_id, batch, attempt (from 1), error (null: none), body. Attempts behind the first success, or beyond the last that is
    allowed, are not made. plain: the last one was made without JSON mode.
    """
    a = attempts.filter(F.col("attempt") <= ATTEMPTS)
    waits = F.when(F.contains("error", F.lit(RATE_SIGN)), RATE_WAIT_S * 1000).otherwise(WAIT_S * 1000)
    refused = F.exists(F.array(*map(F.lit, JSON_SIGNS)), lambda sign: F.contains(F.col("error"), sign))
    of_call = a.groupBy("run_id", "batch").agg(
        F.min(F.when(F.col("error").isNull(), F.col("attempt"))).alias("good"), F.max("attempt").alias("most"),
        F.array_sort(F.collect_list(F.struct("attempt", F.col("error").isNull().alias("ok"), "body", waits.alias("wait"), F.coalesce(refused, F.lit(False)).alias("refused")))).alias("made"),
    )
    last = F.coalesce("good", "most")
    before = F.filter("made", lambda x: (x["attempt"] < last) & (x["attempt"] < ATTEMPTS))
    waited = F.filter("made", lambda x: ~x["ok"] & (x["attempt"] <= last) & (x["attempt"] < ATTEMPTS))
    body = F.get(F.transform(F.filter("made", lambda x: x["attempt"] == F.col("good")), lambda x: x["body"]), F.lit(0))
    return of_call.select(
        "run_id", "batch", F.col("good").isNull().alias("failed"), body.alias("body"), last.cast("long").alias("n_attempts"),
        F.aggregate(waited, F.lit(0), lambda s, x: s + x["wait"]).cast("long").alias("waited_ms"), F.exists(before, lambda x: x["refused"]).alias("plain"),
    )
