"""Numbers and neighbours in an order, by ranges of a key, so that no task orders a whole
table or the whole of a large group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 1 << 20


def _ranged(df: DataFrame, key: str, width: int) -> DataFrame:
    return df.withColumn("_range", F.floor(F.col(key) / F.lit(float(width))).cast("long"))


def row_numbers(df: DataFrame, key: str, name: str, by: list[str] = [], width: int = WIDTH, after: DataFrame | None = None, nulls: bool = True) -> DataFrame:  # noqa: B006
    """Adds name: the place of each row, from 1, by a whole-number key that is unique within
    the columns by; after(by, _after), if given, is what a group's places begin behind.
    nulls: the columns by may be null; rows are dealt once more then. Ranges of width keys are numbered apart and moved by the counts of the
    ranges before. These counts are summed in two steps, as keys may lie far apart."""
    ranged = _ranged(df, key, width)
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_far", F.floor(F.col("_range") / F.lit(float(1 << 16))).cast("long"))
    far = counts.groupBy(*by, "_far").agg(F.sum("_n").alias("_far_n"))
    far = far.withColumn("_far_before", F.sum("_far_n").over(W.partitionBy(*by).orderBy("_far")) - F.col("_far_n")).drop("_far_n")
    near = F.sum("_n").over(W.partitionBy(*by, "_far").orderBy("_range")) - F.col("_n")
    equal = lambda a, b: a.eqNullSafe(b) if nulls else a == b
    same = lambda a, b, names: [equal(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in names]
    before = counts.withColumn("_near", near).alias("x").join(far.alias("y"), same("x", "y", [*by, "_far"])).select(*[f"x.{c}" for c in by], "x._range", (F.col("_near") + F.col("_far_before")).alias("_before"))
    if after is not None:
        met = before.alias("x").join(after.alias("y").hint("merge"), same("x", "y", by))
        before = met.select(*[f"x.{c}" for c in by], "x._range", (F.col("_before") + F.col("_after")).alias("_before"))
    own = ranged.withColumn("_own", F.row_number().over(W.partitionBy(*by, "_range").orderBy(key)))
    # merged: own is dealt so already, and a broadcast would pass through the driver
    joined = own.alias("x").join(before.alias("y").hint("merge"), same("x", "y", [*by, "_range"]))
    return joined.select("x.*", (F.col("_own") + F.col("_before")).alias(name)).drop("_range", "_own")


def next_rows(df: DataFrame, key: str, order: list[str], take: list[str], by: list[str], width: int = WIDTH) -> DataFrame:
    """Adds next: struct of the columns take of the following row by order (of which key is
    the first) within by, or null. The last row of a range looks at the first of the next
    range that has one."""
    ranged = _ranged(df, key, width)
    w = W.partitionBy(*by, "_range").orderBy(*order)
    taken = F.struct(*take)
    firsts = ranged.groupBy(*by, "_range").agg(F.min_by(taken, F.struct(*order)).alias("_first"))
    after = firsts.select(*by, "_range", F.lead("_first").over(W.partitionBy(*by).orderBy("_range")).alias("_after"))
    own = ranged.withColumn("_own", F.lead(taken).over(w))
    return own.join(after, [*by, "_range"]).withColumn("next", F.coalesce("_own", "_after")).drop("_range", "_own", "_after")
