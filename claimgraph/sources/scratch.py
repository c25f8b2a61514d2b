"""Folders that all machines of a session share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the one that spark.checkpoint.dir names. Where it is unset a
    local session gets a folder of its own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="claimgraph-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/claimgraph/{name}-{uuid.uuid4().hex}"


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


def kept(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """df written to a new folder and read again: what follows reads it as often as it likes,
    and survives a lost executor without computing it anew.

    small: it takes little disk. The shuffle files of the write go with its end (else they stay until
    the driver's garbage collector finds their plan unused, which may be after the query), and
    zstd packs what is written."""
    path = folder(df.sparkSession, name)
    with _shuffles_dropped(df.sparkSession) if small else nullcontext():
        df.write.parquet(path, compression="zstd" if small else None)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what kept() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
