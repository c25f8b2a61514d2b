import random

from pyspark.sql import functions as F

from claimgraph.operators import matching
from claimgraph.streaming import compare, postings

FACT = "id long, document_id long, entity_name string, entity_id string, attribute string"


def facts(rng, n, first):
    names = ["Acme", "Acmee", "Acme Ltd", "Zed", "Zde", "Harbour Works", "Harbor Works", "Quay", "Al", "Ali", "", None]
    return [(first + i, 1, rng.choice(names), rng.choice([None, "A1", " a1", "B7", f"K{rng.randrange(40)}"]), " ".join(rng.sample(["revenue", "total", "the", "of", "profit", "tax", "head", "count", f"w{rng.randrange(60)}"], 2))) for i in range(n)]


def test_batches_find_all_pairs_of_the_store(spark, tmp_path):
    rng = random.Random(2)
    parts = [facts(rng, 40, 0), facts(rng, 25, 100)]
    for part in parts:
        spark.createDataFrame(part, FACT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(FACT).parquet(f"{tmp_path}/in")
        compare.compare_stream(stream, f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/check", lambda pairs: pairs, 16).awaitTermination()
    got = {(r.new_id, r.old_id): r.criterion for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for k, part in enumerate(parts):
        new = spark.createDataFrame(part, FACT)
        old = spark.createDataFrame([r for p in parts[: k + 1] for r in p], FACT)
        own = {r[0] for r in part}
        want |= {(r.new_id, r.old_id): r.criterion for r in matching.candidates(new, old).collect() if r.old_id not in own or r.old_id < r.new_id}
    assert got == want and set(want.values()) == {1, 2, 3}
    # a batch that runs again changes nothing
    again = spark.createDataFrame(parts[1], FACT)
    before = spark.read.parquet(f"{tmp_path}/store").count()
    postings.add(postings.postings(again, 16), f"{tmp_path}/store", 1)
    assert spark.read.parquet(f"{tmp_path}/store").count() == before


def test_what_a_batch_reads_goes_with_the_batch(spark, tmp_path):
    """A store ten times as large is read no more by a batch whose postings it has once."""
    store, read = f"{tmp_path}/store", []
    many = lambda a, b: spark.range(a, b).select("id", F.lit(1).alias("document_id"), F.lit("").alias("entity_name"), F.concat(F.lit("K"), "id").alias("entity_id"), F.concat(F.lit("w"), "id").alias("attribute"))
    new = postings.postings(many(90_000, 90_001), 64)
    for k, size in enumerate((100, 1000)):
        postings.add(postings.postings(many(k * 10_000, k * 10_000 + size), 64), store, k)
        read.append((postings.held(spark, store, new, 9).count(), spark.read.parquet(store).count()))
    (small, few), (large, all_) = read
    assert all_ > 9 * few and large < all_ / 10 and small < few / 10


def test_the_bound_of_characters_in_common(spark):
    """Above the ratio's share for all pairs, and below the threshold for most unlike ones."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdé漢", k=rng.randint(1, 9))) for _ in range(60)]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words[:20]], "a string, b string")
    rows = pairs.withColumn("most", matching.most_in_common(F.col("a"), F.col("b"))).withColumn("ratio", matching.ratio("a", "b")).collect()
    for r in rows:
        assert r.most == sum(min(r.a.count(c), r.b.count(c)) for c in set(r.a)) and 2 * r.most / (len(r.a) + len(r.b)) >= r.ratio - 1e-12


def test_candidates_over_true_pairs(spark):
    """Generated names share most of their grams: the bounds leave few pairs that are not alike."""
    names = spark.range(50).select(F.format_string("supplier#%09d", (F.col("id") * 7919) % 1_000_003).alias("name"))
    other = spark.range(50).select(F.concat(F.lit("supplier#"), F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 9)).alias("name"))
    both = names.union(other)
    grams = matching.prefix_grams(both)
    met = grams.select(F.col("name").alias("a"), "gram").join(grams.select(F.col("name").alias("b"), "gram"), "gram").select("a", "b").distinct()
    kept = met.filter(2 * matching.most_in_common(F.col("a"), F.col("b")) >= 0.8 * (F.length("a") + F.length("b")) - 1e-9).count()
    alike, all_met = matching.similar_names(both, both).count(), met.count()
    print("met", all_met, "kept", kept, "alike", alike)
    assert 100 <= alike <= kept < all_met


def test_no_join_follows_the_pairs_of_documents_in_order(spark):
    """The order stands with the key: the topmost join is that of keys, and reads no pairs."""
    from claimgraph.queries import queries

    plan = queries()["incremental_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    first = next(line for line in plan.splitlines() if "Join " in line)
    assert "key#" in first and "old_order#" in first
