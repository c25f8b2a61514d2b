"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a local session, as in
    tests, gets one of its own; a cluster must name one, as its machines share no other."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="claimgraph-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run within deletes its shuffle files when it ends; the setting is the
    session's, and is put back."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)


def cut(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and what
    follows survives a lost executor without computing df anew.

    drop_shuffles: the shuffle files of the write go with its end. Else they stay until the
    driver's garbage collector finds their plan unused, which may be after the query."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/claimgraph/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark) if drop_shuffles else nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Texts go to Python in batches of no more rows and bytes than these, so that a
    worker's memory stays within what some long texts need. Every operator that hands whole
    texts to Python asks for it, whatever ran before; the setting is the session's, as Spark
    has none of an operator's."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def no_clash(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns of the input whose names the operator is about to add."""
    wanted = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in wanted])


def block_pairs(df: DataFrame, key: list[str], block_rows: int, salt: str, counted: str | None = None) -> DataFrame:
    """Deal the rows of every key with two or more rows into blocks of about block_rows
    rows, and give each row once to every pair of blocks of its key that it belongs to.

    Adds block_a <= block_b and side (the row's own block); a key of one block has the one
    pair (0, 0). counted names a column with the number of rows of the row's key, if there
    is one; else they are counted, partially before the shuffle, and joined back without a
    fixed partitioning, so that Spark splits a hot key. No key is dropped, whatever its size."""
    if counted is None:
        counted = "key_rows"
        df = df.join(df.groupBy(*key).agg(F.count(F.lit(1)).alias(counted)).filter(f"{counted} > 1"), key)
    n = F.ceil(F.col(counted) / F.lit(float(block_rows))).cast("long")
    return (
        df.withColumn("n_blocks", n)
        .withColumn("side", F.expr(f"pmod(xxhash64({salt}, 17), n_blocks)"))
        .withColumn("other", F.explode(F.expr("sequence(0L, n_blocks - 1)")))
        .withColumn("block_a", F.least("side", "other"))
        .withColumn("block_b", F.greatest("side", "other"))
        .drop(counted, "n_blocks", "other")
    )
