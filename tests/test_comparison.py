import json
import random
from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from claimgraph.operators import digests, matching
from claimgraph.plans import comparison
from claimgraph.sources import scratch
from claimgraph.streaming import compare

SCOPE = "struct<period_type: string, start: string, end: string, label: string, vintage: string>"
FACT = f"id long, entity_name string, entity_id string, attribute string, raw_value string, unit string, time_scope {SCOPE}, entity_scope string, verbatim_quote string, confidence double"


def fact(i, name, key, attribute, quote="q"):
    return (i, name, key, attribute, "1", None, ("span", None, None, "FY24", None), None, quote, 0.5)


ROWS = [
    fact(1, "Acme Ltd", "A1", "total revenue"), fact(2, "Zed", None, "head count"), fact(3, "Acmee Limited", None, "profit"), fact(4, "Other", "a1", "of the"), fact(5, "Lone", None, "nothing shared"),
    fact(10, "Acme", None, "revenue", "é\n"), fact(11, "Zed Inc", "A1", "count"), fact(12, "Fresh", None, "weather"),
]


def split(spark):
    stored = spark.createDataFrame(ROWS, FACT)
    new = stored.filter("id >= 10").withColumn("doc_id", F.when(F.col("id") == 12, 8).otherwise(7).cast("long"))
    return new, stored


def test_candidates_are_the_union_of_all_pairs(spark):
    new, stored = split(spark)
    got = {(r.doc_id, r.id): r.first_new_id for r in comparison.candidates(new, stored).collect()}
    want = {}
    for doc in (7, 8):
        own = new.filter(F.col("doc_id") == doc)
        pairs = matching.candidates(own, stored)
        want |= {(doc, r.old_id): r.first_new_id for r in compare.candidate_union(pairs, own).collect()}
    assert got == want and (7, 4) in got and (7, 5) not in got


def test_no_facts_or_texts_are_broadcast(spark):
    """Broadcasts of compressed tables outgrew the driver: facts, postings and texts are merged."""
    new, stored = split(spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(comparison.chunks(new, stored)) and "Broadcast" not in plan(digests.in_order(new.withColumn("is_new", F.lit(True)).withColumn("first", F.col("id"))))


def test_prompts_hold_digests_in_order_and_fit(spark):
    new, stored = split(spark)
    texts = {r[0]: json.dumps({"id": r[0], "entity_name": r[1], "entity_id": r[2], "attribute": r[3], "raw_value": r[4], "unit": r[5], "time_scope": dict(zip(["period_type", "start", "end", "label", "vintage"], r[6])), "entity_scope": r[7], "verbatim_quote": r[8], "confidence": r[9]}) for r in ROWS}
    own = len(texts[10]) + len(texts[11]) + 4
    made = comparison.prompts_of(comparison.chunks(new, stored, own + 2 * max(map(len, texts.values()))), "see {digest}.").collect()
    assert {r.doc_id for r in made} == {7}  # one fact alone is not compared
    order = [r.first_new_id * 100 + r.id for r in comparison.candidates(new, stored).filter("doc_id = 7").collect()]
    ids = [i % 100 for i in sorted(order)]
    chunks = sorted(made, key=lambda r: r.chunk)
    assert [i for r in chunks for i in r.ids[2:]] == ids and all(r.ids[:2] == [10, 11] for r in chunks) and len(chunks) == (len(ids) + 1) // 2
    for r in chunks:
        assert r.prompt == "see [" + ", ".join(texts[i] for i in r.ids) + "]."


def test_replies_give_each_new_pair_once(spark):
    say = lambda *pairs: json.dumps([{"fact_id_a": a, "fact_id_b": b, "relation_type": "corroborates", "reasoning_text": "r", "confidence": 1} for a, b in pairs])
    rows = [(7, 0, [10, 11, 1, 4], say((10, 1), (1, 10), (10, 99), (11, 4))), (7, 1, [10, 11, 2], "no json"), (7, 2, [10, 11, 3, 1], say((10, 3), (11, 1), (10, 1)))]
    answered = spark.createDataFrame(rows, "doc_id long, chunk int, ids array<long>, reply string")
    known = spark.createDataFrame([(3, 10)], "fact_id_a long, fact_id_b long")
    got = sorted((r.fact_id_a, r.fact_id_b) for r in comparison.relationships(answered, known).collect())
    assert got == [(10, 1), (11, 1), (11, 4)]


def shuffled(plan):
    """Bytes that the exchanges of a plan that ran took in."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    children = [plan.children().apply(k) for k in range(plan.children().size())]
    own = plan.metrics().get("dataSize").get().value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(map(shuffled, children))


def many(spark, docs=12, new=12, stored=3000):
    """Facts of one attribute, each with a text of its own; each document's new ones outgrow a budget of 3000."""
    made = spark.range(stored).select(
        F.col("id"), F.lit("").alias("entity_name"), F.lit(None).cast("string").alias("entity_id"), F.lit("revenue").alias("attribute"), F.lit("1").alias("raw_value"), F.lit(None).cast("string").alias("unit"),
        F.lit(None).cast(SCOPE).alias("time_scope"), F.lit(None).cast("string").alias("entity_scope"), F.sha2(F.col("id").cast("string"), 512).alias("verbatim_quote"), F.lit(0.5).alias("confidence"),
    )
    return made.filter(F.col("id") < docs * new).withColumn("doc_id", F.col("id") % docs), made


def test_a_text_is_not_shuffled_for_each_document(spark):
    new, stored = many(spark)
    made = comparison.prompts_of(comparison.chunks(new, stored, 3000))
    total = sum(len(r.prompt) for r in made.collect())
    assert total > 12 * 2800 * 200 and shuffled(made._jdf.queryExecution().executedPlan()) < total / 2


def test_chunks_near_and_apart(spark, monkeypatch):
    """The same texts and order whether a chunk's facts lie near each other or not."""
    monkeypatch.setattr(comparison, "NEAR", 64)
    monkeypatch.setattr(comparison, "LISTED", 2)
    monkeypatch.setattr(digests, "BLOCK", 32)
    new, stored = many(spark, 5, 12, 400)
    texts = {r.id: r.json for r in digests.with_json(stored).collect()}
    got = {}
    for r in comparison.chunks(new, stored, 3000).collect():
        got[r.doc_id, r.chunk] = r.ids
        assert r.digest == "[" + ", ".join(texts[i] for i in r.ids) + "]"
    want = {}
    for doc in range(5):
        own = [i for i in range(60) if i % 5 == doc]
        old = [i for i in range(400) if i not in own]
        turns = [i for k in range(len(old)) for i in [*own[k : k + 1], old[k]]]
        chunk, used = 0, 0
        for i in turns:
            if used and used + len(texts[i]) > 3000:
                chunk, used = chunk + 1, 0
            used += len(texts[i])
            want.setdefault((doc, chunk), []).append(i)
    assert got == {k: ids for k, ids in want.items() if len(ids) > 1}


def test_lists_of_chunks_equal_rows_of_chunks(spark, monkeypatch):
    """Documents whose new facts fit, do not, or stand alone, over blocks of a few places."""
    monkeypatch.setattr(digests, "BLOCK", 8)
    rng = random.Random(5)
    rows = []
    for d in range(60):
        for is_new in (True, False):
            rows += [(d, is_new, o, rng.choice([1, 3, 9, 40, 120]), rng.randrange(10**9)) for o in range(1, rng.randint(1, 30))]
    facts = spark.createDataFrame(rows, "doc_id long, is_new boolean, ord long, size long, id long")
    want = defaultdict(list)
    for r in digests.chunks(facts, 100, take=["id"], numbered=True).collect():
        want[r.doc_id, r.chunk].append((r.place, r.id, r.is_new))
    got = {(r.doc_id, r.chunk): list(zip(r.ids, r.news)) for r in digests.listed(scratch.kept(digests.blocks(facts, 100), "blocks"), 100).collect()}
    assert got == {k: [x[1:] for x in sorted(v)] for k, v in want.items()} and len(got) > 200


def test_what_is_kept_small_can_go(spark):
    key, before = scratch.FILE_CLEANUP, spark.conf.get(scratch.FILE_CLEANUP, None)
    df = scratch.kept(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "test", small=True)
    assert spark.conf.get(key, None) == before and sorted(tuple(r) for r in df.collect()) == [(k, 15 if k < 2 else 14) for k in range(7)]
    assert ".zstd." in df.inputFiles()[0]
    folder = Path(df.kept_path.removeprefix("file://"))
    assert folder.exists()
    scratch.forget(df)
    assert not folder.exists()
