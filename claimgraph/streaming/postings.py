"""An index of facts by what relates them, kept in buckets and added to batch by batch.

A fact stands under its identifier, each token of its attribute, its name, and its name's grams. A
batch of new facts reads the buckets of its own postings, so that what it reads goes with the
batch, not with the store. Of a name's grams those first in a fixed order suffice: two names
that are alike enough share one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.operators import matching

BUCKETS = 1024
IDENTIFIER, TOKEN, GRAM, NAME = 1, 2, 3, 4


def postings(facts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """facts(id, entity_name, entity_id, attribute) -> (kind, posting, id, bucket); a gram's
    row has the name in id's place: (kind, posting, name, bucket), id null."""
    p = matching.prepared(facts)
    none = F.lit(None).cast("string")
    kinds = [
        p.filter("key is not null").select(F.lit(IDENTIFIER).alias("kind"), F.col("key").alias("posting"), "id", none.alias("name")),
        p.select(F.lit(TOKEN).alias("kind"), F.explode("tokens").alias("posting"), "id", none.alias("name")),
        p.filter("name <> ''").select(F.lit(NAME).alias("kind"), F.col("name").alias("posting"), "id", none.alias("name")),
        matching.prefix_grams(p).select(F.lit(GRAM).alias("kind"), F.col("gram").alias("posting"), F.lit(None).cast("long").alias("id"), "name"),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.withColumn("bucket", F.pmod(F.xxhash64("kind", "posting"), F.lit(buckets)).cast("int"))


def add(rows: DataFrame, store: str, batch_id: int) -> None:
    """Writes a batch's postings into their buckets; one that runs again replaces its own."""
    rows.withColumn("batch", F.lit(batch_id)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(store)


def held(spark: SparkSession, store: str, wanted: DataFrame, upto: int) -> DataFrame:
    """What the store has in the buckets of wanted(bucket) of batches up to one. The list of
    buckets, at most all of them, is what reaches the driver."""
    numbers = sorted(r.bucket for r in wanted.select("bucket").distinct().collect())
    root = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [p for p in (f"{store}/bucket={b}" for b in numbers) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    schema = "kind int, posting string, id long, name string, bucket int, batch long"
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", store).parquet(*there).filter(F.col("batch") <= upto)


def candidates(spark: SparkSession, store: str, batch_id: int, new: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(new_id, old_id, criterion) of a batch that was added: new holds its postings. A pair
    of two facts of the batch stands once, from the later one's side."""
    old = held(spark, store, new, batch_id)
    own = new.select("kind", "posting", F.col("id").alias("new_id"))
    direct = own.join(old.select("kind", "posting", F.col("id").alias("old_id"), "batch"), ["kind", "posting"]).filter(F.col("kind").isin(IDENTIFIER, TOKEN))
    found = direct.select("new_id", "old_id", F.col("kind").alias("criterion"), "batch")
    grams = lambda df, s: df.filter(F.col("kind") == GRAM).select("posting", F.col("name").alias(s)).distinct()
    alike = matching.verified(grams(new, "a").join(grams(old, "b"), "posting").select("a", "b").distinct())
    places = alike.withColumn("bucket", F.pmod(F.xxhash64(F.lit(NAME), F.col("b")), F.lit(buckets)).cast("int"))
    named = held(spark, store, places, batch_id).filter(F.col("kind") == NAME)
    names = own.filter(F.col("kind") == NAME).select("new_id", F.col("posting").alias("a"))
    by_name = names.join(alike, "a").join(named.select(F.col("posting").alias("b"), F.col("id").alias("old_id"), "batch"), "b")
    pairs = found.unionByName(by_name.select("new_id", "old_id", F.lit(3).alias("criterion"), "batch"))
    once = pairs.filter((F.col("batch") < batch_id) | (F.col("old_id") < F.col("new_id")))
    return once.groupBy("new_id", "old_id").agg(F.min("criterion").alias("criterion"))
