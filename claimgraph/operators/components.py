"""Connected components: every node takes the smallest that its neighbours know, and theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.sources import scratch


def _from_larger(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _round(edges: DataFrame) -> DataFrame:
    """The smallest neighbour goes to the larger ones, and then to the smaller ones."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = _from_larger(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    return _from_larger(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, component): every node but the smallest of its component,
    with the smallest node that it reaches."""
    state, seen = scratch.kept(_from_larger(edges), "components"), None
    while True:
        mark = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen, state = mark, scratch.kept(_round(state), "components")
