"""Calls to clients, as recorded: attempts up to a success, and the waits between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The longest wait and the number of retries.
MAX_WAIT, RETRIES = 30, 3


def calls(attempts: DataFrame, key: str, order: str, ok: str, retries: int = RETRIES) -> DataFrame:
    """attempts(key, order, ok boolean) -> (key, last, tries, waited, gave_up): attempts of a
    key in order, up to each success, are one call, and those after the last success are one
    more. waited is the least wait in seconds between them: powers of two, at most MAX_WAIT.
    gave_up: the call ended without a success, or took more than the retries."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    call = F.coalesce(F.sum(F.when(F.col(ok), 1).otherwise(0)).over(before), F.lit(0))
    held = attempts.select(key, order, ok, call.alias("call")).groupBy(key, "call").agg(F.max(order).alias("last"), F.count(F.lit(1)).alias("tries"), F.bool_or(ok).alias("ok"))
    doubling = F.least(F.col("tries") - 1, F.lit(5))
    waited = F.pow(F.lit(2.0), doubling) - 1 + F.greatest(F.col("tries") - 6, F.lit(0)) * float(MAX_WAIT)
    return held.select(key, "last", "tries", waited.cast("long").alias("waited"), (~F.col("ok") | (F.col("tries") > retries + 1)).alias("gave_up"))
