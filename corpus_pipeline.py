"""From raw documents to tokens: five stages, each written as Parquet and read again.

quality: documents that the classifier rejects go (none, if no document has a label). lines: aligned common blocks go from
later documents, and documents of which nothing is left. near-duplicates: of each group of
texts linked by a Jaccard similarity of 0.8 of five-word shingles one document stays. mixing: documents repeat by their source's
rate. tokens: texts are encoded and, as a check, decoded.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm import bpe, line_dedup, mixing, quality, shingles
from claimgraph.llm.common import cut, table

#: Stages 1, 2, 3 and 5 have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


#: Columns that stages read or write; others pass under names that clash with nothing.
_KNOWN = {"doc_id", "text", "lang", "source", "n_chars"}


def _keeps_columns(stage):
    """A stage whose output has the columns of docs; n_chars follows the text."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        inside = docs.toDF(*[c if c in _KNOWN else f"_{k}_of_docs" for k, c in enumerate(names)])
        out = stage(spark, inside, sf_dir)
        if "n_chars" in names:
            out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return out.select(*inside.columns).toDF(*names)

    return run_stage


@_keeps_columns
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_keeps_columns
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_emptied(docs)


@_keeps_columns
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.keep_first(docs)


@_keeps_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids, round_trip)."""
    path, pattern = bpe.public_vocabulary()
    found = bpe.encode_checked(docs.select("doc_id", "source", "lang", "text"), path, pattern)
    return found.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality", drop_low_quality),
    ("lines", dedup_lines),
    ("near-duplicates", dedup_near),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
