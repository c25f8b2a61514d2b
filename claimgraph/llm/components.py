"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import cut, forget


def _largest_first(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _towards_smallest(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest node that it knows to its larger neighbours (large
    star), and then to its smaller ones (small star). Joins, not windows, find the
    smallest: Spark splits the rows of a hub."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = _largest_first(large)
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _largest_first(small.unionByName(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(a long, b long) -> (node, component): for every node but the smallest of its
    component, the smallest node that it reaches. No edges: no rows. Null ends, loops and
    repeated edges have no effect."""
    state = cut(_largest_first(edges.dropna(subset=["a", "b"])), name)
    seen = None
    while True:
        mark = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
        before, state = state, cut(_towards_smallest(state), name)
        forget(before)
