"""Facts of two ledgers over the same customers, and how they relate.

Ledger A states a customer's orders of a fiscal year in rupees, ledger B the same in lakh;
for some customers B sums the lines instead (a conflict) or has another scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgraph.functions import normalize as N
from claimgraph.sources import scratch

CLOSE = 1e-3
#: Values of two classes of one precision that a range of the sweep holds at most, about.
RANGE_VALUES = 4096


def ledger_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    cents = lambda c: F.round(F.col(c).cast("double") * 100).cast("long")
    year = (F.year("o_orderdate") + F.when(F.month("o_orderdate") >= 4, 1).otherwise(0)).alias("fy")
    orders = read("orders").select("o_orderkey", "o_custkey", year, cents("o_totalprice").alias("cents"))
    lines = read("lineitem").select("l_orderkey", cents("l_extendedprice").alias("line_cents")).groupBy("l_orderkey").agg(F.sum("line_cents").alias("line_cents"))
    sums = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey", "fy").agg(F.sum("cents").alias("cents"), F.coalesce(F.sum("line_cents"), F.lit(0)).alias("line_cents"))
    stated = F.when(F.col("o_custkey") % 10 == 0, F.col("line_cents")).otherwise(F.col("cents"))
    common = [
        F.concat(F.lit("Customer "), F.col("o_custkey"), F.lit(" Limited")).alias("entity_name"),
        F.format_string("CUST%08d", "o_custkey").alias("entity_id"),
        F.lit("revenue_from_operations").alias("attribute"),
        F.format_string("FY%d", "fy").alias("label"),
    ]
    a = sums.select((F.col("o_custkey") * 10000 + F.col("fy")).cast("long").alias("id"), F.lit(1).alias("document_id"), *common, F.format_number(F.col("cents") / 100.0, 2).alias("raw_value"), F.lit("Rs").alias("unit"), F.lit("consolidated").alias("entity_scope"))
    scope = F.when(F.col("o_custkey") % 10 == 1, "standalone").otherwise("consolidated")
    b = sums.select((F.col("o_custkey") * 10000 + F.col("fy") + 5000).cast("long").alias("id"), F.lit(2).alias("document_id"), *common, F.format_number(stated / 1e7, 2).alias("raw_value"), F.lit("Lakh").alias("unit"), scope.alias("entity_scope"))
    return a.unionByName(b)


def normalized(facts: DataFrame) -> DataFrame:
    """Adds the value in base units, half a unit of its last stated decimal, and the year."""
    raw, unit = F.col("raw_value"), F.col("unit")
    factored = facts.withColumn("factor", N.multiplier(raw, unit))
    half = 0.5 * F.pow(F.lit(10.0), -F.length(F.regexp_extract(raw, r"\.(\d+)", 1))) * F.col("factor")
    return factored.withColumn("value", N.quantity(raw, unit, F.col("factor"))).withColumn("half", half).withColumn("fy_end", N.fiscal_year_end(F.col("label"))).drop("factor")


def judge(pairs: DataFrame) -> DataFrame:
    """The offline judge's rule, our own: another period, else another scope explains a
    difference; else values agree within half of the coarser one's last stated decimal."""
    close = F.abs(F.col("value_a") - F.col("value_b")) <= F.greatest("half_a", "half_b") + CLOSE
    dimension = F.when(F.col("fy_a") != F.col("fy_b"), "time").when(F.col("scope_a") != F.col("scope_b"), "scope")
    kind = F.when(dimension.isNotNull(), "reconciled_context").when(close, "corroborates").otherwise("contradicts")
    return pairs.withColumn("relation_type", kind).withColumn("reconciled_dimension", dimension)


def reconcile(facts: DataFrame) -> DataFrame:
    """(fact_id_a, fact_id_b, relation_type, reconciled_dimension) of all pairs of the two
    documents with the same identifier."""
    n = normalized(facts).withColumn("key", N.identifier(F.col("entity_id")))
    side = lambda d, s: n.filter(F.col("document_id") == d).select("key", F.col("id").alias(f"fact_id_{s}"), F.col("value").alias(f"value_{s}"), F.col("half").alias(f"half_{s}"), F.col("fy_end").alias(f"fy_{s}"), F.col("entity_scope").alias(f"scope_{s}"))
    return judge(side(1, "a").join(side(2, "b"), "key")).select("fact_id_a", "fact_id_b", "relation_type", "reconciled_dimension")


def _differs(a: str, b: str):
    return F.coalesce(F.col(a) != F.col(b), F.lit(False))


def relation_counts(facts: DataFrame) -> DataFrame:
    """(relation_type, reconciled_dimension, n): how many pairs reconcile() would give of each
    kind, without the pairs.

    Facts of a document with one identifier, year, scope, precision and value are counted
    once. Products of counts tell how many pairs time or scope explain: all pairs of an
    identifier, those of one year among them, and those of one scope among these. Within the
    other pairs of classes a sweep over the values counts those in reach: running counts of the
    one side are read where the reach of each value of the other begins and ends. A class's stated values are multiples of twice its
    half, so ranges of so many halves (of both classes' geometric mean) hold a bounded number of
    distinct ones; a value's reach meets few ranges, and is read in each. So the values of a
    hot identifier lie in many tasks."""
    n = normalized(facts).filter(F.col("document_id").isin(1, 2)).withColumn("key", N.identifier(F.col("entity_id"))).filter("key is not null")
    kind = F.struct(F.col("fy_end").alias("fy"), F.col("entity_scope").alias("scope"), "half")
    held = n.groupBy("document_id", "key", kind.alias("kind"), "value").agg(F.count(F.lit(1)).alias("n"))
    held = scratch.kept(held, "ledger-values")  # read by each step below
    classes = held.groupBy("document_id", "key", "kind").agg(F.sum("n").alias("n"))
    side = lambda df, d, s, more=(): df.filter(F.col("document_id") == d).select("key", F.col("kind").alias(f"kind_{s}"), F.col("n").alias(f"n_{s}"), *more)
    a, b = side(classes, 1, "a"), side(classes, 2, "b")
    year = lambda df, s: df.withColumn("fy", F.col(f"kind_{s}.fy"))
    # pairs of classes that no other year explains: a null year agrees with all
    same_year = year(a, "a").join(year(b, "b"), ["key", "fy"]).drop("fy")
    any_b = a.filter("kind_a.fy is null").join(b, "key")
    any_a = a.filter("kind_a.fy is not null").join(b.filter("kind_b.fy is null"), "key")
    pairs = same_year.unionByName(any_b).unionByName(any_a).withColumn("pair_n", F.col("n_a") * F.col("n_b"))
    pairs = scratch.kept(pairs.withColumn("reconciled_dimension", F.when(_differs("kind_a.scope", "kind_b.scope"), "scope")), "ledger-classes")
    of = lambda d: F.coalesce(F.sum(F.when(F.col("document_id") == d, F.col("n"))), F.lit(0))
    total = held.groupBy("key").agg((of(1) * of(2)).alias("n")).agg(F.sum("n").alias("n"))
    near = pairs.filter("reconciled_dimension is null").select("key", "kind_a", "kind_b")
    reach = F.greatest("kind_a.half", "kind_b.half") + CLOSE
    value = F.col("value")
    met_a = near.join(side(held, 1, "a", ("value",)), ["key", "kind_a"]).filter("value is not null")
    met_b = near.join(side(held, 2, "b", ("value",)), ["key", "kind_b"]).filter("value is not null")
    none = F.lit(0).cast("long")
    width = 2 * RANGE_VALUES * F.sqrt(F.col("kind_a.half") * F.col("kind_b.half"))
    event = lambda x, place, points, sign: F.struct(x.alias("x"), F.lit(place).alias("place"), points.alias("points"), sign.alias("sign"))
    events = lambda df, *e: df.select("key", "kind_a", "kind_b", "range", F.inline(F.array(*e)))
    no = lambda x: F.floor(x / width).cast("long")
    # at equal places a reach begins before the values there and ends behind them
    ends = events(met_a.withColumn("range", F.explode(F.sequence(no(value - reach), no(value + reach)))), event(value - reach, 0, none, -F.col("n_a")), event(value + reach, 2, none, F.col("n_a")))
    swept = ends.unionByName(events(met_b.withColumn("range", no(value)), event(value, 1, F.col("n_b"), none)))
    so_far = F.sum("points").over(W.partitionBy("key", "kind_a", "kind_b", "range").orderBy("x", "place").rowsBetween(W.unboundedPreceding, 0))
    counted = swept.withColumn("so_far", so_far)
    close = counted.filter("sign <> 0").agg(F.coalesce(F.sum(F.col("sign") * F.col("so_far")), none).alias("n"))
    # each line adds to a kind, or takes from it what another line has: one row of each kind is left
    line = lambda df, kind, n: df.select(F.lit(kind).cast("string").alias("reconciled_dimension"), n.alias("n"))
    explained = pairs.groupBy("reconciled_dimension").agg(F.sum("pair_n").alias("n"))
    lines = line(total, "time", F.col("n")).unionByName(line(explained, "time", -F.col("n"))).unionByName(explained).unionByName(line(close, None, -F.col("n")))
    rest = lines.groupBy("reconciled_dimension").agg(F.sum("n").alias("n"))
    agree = close.select(F.lit("corroborates").alias("relation_type"), F.lit(None).cast("string").alias("reconciled_dimension"), "n")
    kinds = F.when(F.col("reconciled_dimension").isNull(), "contradicts").otherwise("reconciled_context")
    return agree.unionByName(rest.select(kinds.alias("relation_type"), "reconciled_dimension", "n")).filter("n > 0")
