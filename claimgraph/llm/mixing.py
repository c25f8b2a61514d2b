"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its mass. A hash of
the document's id is its uniform number; the inverse of the Poisson distribution with that
mean turns it into a count of copies. Copies get a place by another hash and are dealt and
sorted by it: a global shuffle that any rerun repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgraph.llm.common import cut, no_clash, table

SEED = "mix-1"
TEMPERATURE = 0.7


def uniform(*parts: F.Column) -> F.Column:
    """In [0, 1), of 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE, budget: float = 1.0) -> DataFrame:
    """(source, rate): the mean number of copies of a source's documents.

    weights(source, weight) gives target shares of the output's characters; without it they
    go with a source's characters to the power temperature. The output has budget times the
    input's characters in the mean. A source without a weight has rate 0; a null source is
    one of its own; one of empty texts only counts as one character."""
    mass = docs.groupBy("source").agg(F.greatest(F.sum(F.length(F.coalesce("text", F.lit("")))), F.lit(1)).cast("double").alias("mass"))
    if weights is None:
        wanted = mass.withColumn("weight", F.pow("mass", F.lit(temperature)))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight")).dropDuplicates(["w_source"])
        wanted = mass.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source").fillna(0.0, ["weight"])
    total = wanted.agg(F.sum("weight").alias("weights"), (F.sum("mass") * budget).alias("out"))
    share = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(0.0)
    return wanted.crossJoin(total).select("source", (share * F.col("out") / F.col("mass")).alias("rate"))


def poisson_steps(rate: DataFrame) -> DataFrame:
    """Adds steps: the distribution function at 0, 1, 2, ... as far as a double can tell."""
    most = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    # log of rate**k / k! as a running sum, so that large means do not overflow
    terms = rate.withColumn("k", F.explode(F.sequence(F.lit(0), most)))
    w = W.partitionBy("source").orderBy("k")
    log_term = F.sum(F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log(F.col("k").cast("double")))).over(w)
    steps = terms.filter("rate > 0").withColumn("p", F.exp(log_term)).withColumn("c", F.sum("p").over(w))
    return steps.groupBy("source", "rate").agg(F.array_sort(F.collect_list("c")).alias("steps"))


def replicate(docs: DataFrame, weights: DataFrame | None = None, seed: str = SEED, temperature: float = TEMPERATURE, budget: float = 1.0) -> DataFrame:
    """The rows of docs, each as often as its count says, in a global random order: within
    a partition by place, and over partitions by its hash. Adds copy (from 1) and place.

    A null doc_id hashes as the text "null"; rows that repeat an id get the same count;
    null and empty texts are copied like others. Input columns named copy or place are
    replaced. No rows: no rows."""
    docs = no_clash(docs, "copy", "place", "steps", "ends", "rate", "u", "whole", "n", "s_source")
    steps = poisson_steps(rates(docs, weights, temperature, budget)).withColumn("ends", F.expr("filter(steps, (c, i) -> i % 64 = 63)"))
    steps = cut(steps, "rates").withColumnRenamed("source", "s_source")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # steps rise: the last ones of each 64 tell which 64 to count in
    copies = F.expr("64 * whole + size(filter(slice(steps, 64 * whole + 1, 64), c -> c <= u))")
    drawn = (
        docs.join(steps, F.col("source").eqNullSafe(F.col("s_source")))
        .withColumn("u", uniform(F.lit(seed), F.lit("count"), key))
        .withColumn("whole", F.expr("size(filter(ends, c -> c <= u))"))
        .withColumn("n", copies)
        .filter("n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .withColumn("place", uniform(F.lit(seed), F.lit("place"), key, F.col("copy").cast("string")))
        .drop("s_source", "steps", "ends", "rate", "u", "whole", "n")
    )
    return drawn.repartition("place").sortWithinPartitions("place")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "place", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op3_mixing": op3_mixing}
_HASH = "(('0x' || left(md5('{seed}|{what}|' || {key}), 13))::UBIGINT::DOUBLE / 4503599627370496.0)"
ORACLE_SQL = {
    "op3_mixing": f"""
WITH mass AS (
  SELECT source, greatest(sum(length(coalesce(text, ''))), 1)::DOUBLE AS mass FROM documents GROUP BY source
), rates AS (
  SELECT source, pow(mass, {TEMPERATURE}) / (SELECT sum(pow(mass, {TEMPERATURE})) FROM mass) * (SELECT sum(mass) FROM mass) / mass AS rate FROM mass
), terms AS (
  SELECT source, rate, k,
    exp(sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(k::DOUBLE) END) OVER (PARTITION BY source ORDER BY k)) AS p
  FROM rates, LATERAL (SELECT unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 30))::INTEGER + 1)) AS k)
), steps AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), counts AS (
  SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.c <= d.u) AS n
  FROM (SELECT *, {_HASH.format(seed=SEED, what='count', key='doc_id')} AS u FROM documents) d
), copies AS (
  SELECT doc_id, source, text, unnest(range(1, n + 1))::INTEGER AS copy FROM counts WHERE n > 0
)
SELECT doc_id, source, copy, {_HASH.format(seed=SEED, what='place', key="doc_id || '|' || copy")} AS place, length(text)::BIGINT AS n_chars FROM copies
"""
}
