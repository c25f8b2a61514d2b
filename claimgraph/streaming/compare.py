"""New facts against those before them, batch by batch or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimgraph.streaming import postings


def visible(pairs: DataFrame) -> DataFrame:
    """pairs(new_order, old_order, ...): a document sees itself and the documents before it."""
    return pairs.filter("old_order <= new_order")


def candidate_union(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """pairs(new_id, old_id) and the ids of the new facts -> (old_id, first_new_id): every
    old fact that any new one may relate to, once, without the new ones themselves, under
    the first new fact that met it."""
    met = pairs.groupBy("old_id").agg(F.min("new_id").alias("first_new_id"))
    return met.join(new.select(F.col("id").alias("old_id")).distinct(), "old_id", "left_anti")


def compare_stream(facts: DataFrame, store: str, out: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame], buckets: int = postings.BUCKETS) -> StreamingQuery:
    """facts, a stream of (id, document_id, entity_name, entity_id, attribute, ...): each
    batch is added to the index of postings in the folder store, compared with the facts that
    share a bucket with it, up to this batch, and judge(candidate pairs) is written to out. A
    batch replaces its own part of both, so that one that runs again after a failure changes nothing. A store keeps the
    number of buckets that it began with."""
    spark = facts.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        postings.add(postings.postings(batch, buckets), store, batch_id)
        # read again from the store, once for all that follows
        new = postings.held(spark, store, postings.postings(batch, buckets), batch_id).filter(F.col("batch") == batch_id)
        judge(postings.candidates(spark, store, batch_id, new, buckets)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return facts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
