import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimgraph.plans import ledgers

SCHEMA = "id long, document_id int, entity_id string, label string, raw_value string, unit string, entity_scope string"


@pytest.mark.parametrize("seed", range(3))
def test_counts_are_those_of_the_pairs(spark, seed):
    """Null years, scopes, values and identifiers, several precisions and units, ties at the reach."""
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        value = rng.choice(["1,000", "1,000.5", "1000.25", "10.00", "9.995", "10.0", "1,001", "none", None, f"{rng.randint(990, 1010)}.{rng.randint(0, 9)}"])
        rows.append((i, rng.choice([1, 2, 2, 3]), rng.choice(["A1", " a1", "B", "", None]), rng.choice(["FY24", "FY2024", "FY23", "Q4", None]), value, rng.choice(["Rs", "Lakh", "Crore", None]), rng.choice(["consolidated", "standalone", None])))
    facts = spark.createDataFrame(rows, SCHEMA)
    want = Counter((r.relation_type, r.reconciled_dimension) for r in ledgers.reconcile(facts).collect())
    got = {(r.relation_type, r.reconciled_dimension): r.n for r in ledgers.relation_counts(facts).collect()}
    assert got == dict(want) and len(got) == 4
    assert ledgers.relation_counts(facts.limit(0)).collect() == []


def test_a_hot_identifier_makes_no_pairs(spark):
    """A hundred thousand facts a side: ten thousand million pairs are counted, none is made."""
    n = 100_000
    fact = lambda d, value: spark.range(n).select("id", F.lit(d).alias("document_id"), F.lit("K").alias("entity_id"), F.lit("FY24").alias("label"), value.alias("raw_value"), F.lit("Rs").alias("unit"), F.lit("consolidated").alias("entity_scope"))
    id_ = F.col("id")
    facts = fact(1, (id_ * 3).cast("string")).unionByName(fact(2, (id_ * 3 + id_ % 3 - 1).cast("string")))
    counts = ledgers.relation_counts(facts)
    got = {r.relation_type: r.n for r in counts.collect()}
    # a reach of a half and a thousandth holds no whole number but its own
    agree = sum(1 for k in range(n) if k % 3 == 1)
    assert got == {"corroborates": agree, "contradicts": n * n - agree}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
