"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for
the operators whose own files do not cover them."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from claimgraph.llm import bpe, licenses, mixing, notices, secrets, shingles, simhash
from claimgraph.llm.common import no_clash


def clashing(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    return df


def test_licenses(spark):
    note = licenses.TEMPLATES["ISC"]
    long_text = "\n".join(["a line of no licence at all"] * 20_000 + [note])
    rows = [(1, note), (1, note), (None, note), (2, long_text), (3, None), (4, "")]
    d = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "row", "unit", "unit_text", "license", "gram", "dice")
    got = collections.Counter((r.doc_id, r.unit, r.license) for r in licenses.scan(d).collect())
    assert got == {(1, 0, "ISC"): 2, (None, 0, "ISC"): 1, (2, 0, "ISC"): 1, (2, 20_001, "ISC"): 1}  # bigrams are a set
    assert {r.doc_id for r in notices.scan(d).collect()} == {1, 2, None}


def test_mixing(spark):
    """A null source is one of its own, rows that repeat fare alike, empty texts are copied."""
    rows = [(i, "abcd", "s" if i % 2 else None) for i in range(400)] + [(7, "abcd", "s"), (None, "", None), (900, None, "t"), (901, "", "t")]
    d = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"), "copy", "place", "rate", "steps", "ends", "whole", "u", "n")
    out = mixing.replicate(d, temperature=1.0, budget=2.0).collect()
    by_source = collections.Counter(r.source for r in out)
    assert abs(by_source["s"] - 402) < 120 and abs(by_source[None] - 402) < 120
    copies = collections.Counter((r.doc_id, r.copy) for r in out)
    assert {n for (i, _), n in copies.items() if i == 7} <= {2} and {n for (i, _), n in copies.items() if i != 7} == {1}
    assert len({r.place for r in out}) == len({(r.doc_id, r.copy) for r in out})
    weights = spark.createDataFrame([(None, 1.0), ("s", 0.0), ("u", 5.0)], "source string, weight double")
    assert {r.source for r in mixing.replicate(d, weights).collect()} <= {None}
    assert mixing.replicate(d.limit(0)).count() == 0


@pytest.mark.parametrize("rate", [0.3, 7.0, 200.0, 5000.0])
def test_mixing_counts_are_those_of_the_distribution(spark, rate):
    """The inverse of the distribution function at each document's number, at any rate."""
    d = spark.range(150).selectExpr("id AS doc_id", "'a' AS text", "'s' AS source")
    out = mixing.replicate(d, budget=rate).groupBy("doc_id").count()
    u = {r.doc_id: r.u for r in d.withColumn("u", mixing.uniform(F.lit(mixing.SEED), F.lit("count"), F.col("doc_id").cast("string"))).collect()}
    got = {r.doc_id: r["count"] for r in out.collect()}
    for i, x in u.items():
        k, total = 0, 0.0
        while True:
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            if total > x:
                break
            k += 1
        assert abs(got.get(i, 0) - k) <= (0 if rate < 100 else 1), i


def test_secrets_clash(spark):
    d = clashing(spark.createDataFrame([(1, "token=abcdef"), (None, None)], "doc_id long, text string"), "base", "spans", "row", "n_live", "document", "value_hash")
    assert sorted((r.doc_id or 0, len(r.base)) for r in secrets.scan(d).collect()) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("words", [32_767, 32_770, 70_000])
def test_simhash_of_long_texts(words):
    """Slices of 32768 words do not show."""
    import xxhash

    w = [f"w{k % 977}" for k in range(words)]
    sums = [0] * 64
    for k in range(words - 2):
        h = xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42)
        for b in range(64):
            sums[b] += h >> b & 1
    assert simhash.fingerprint("\n".join(w)) == sum(1 << b for b in range(64) if 2 * sums[b] > words - 2)


def test_simhash_and_shingles_clash(spark):
    long_text = " ".join(f"w{k}" for k in range(50_000))
    rows = [(1, long_text), (2, long_text + " more"), (3, None), (None, ""), (3, None)]
    d = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "fp", "node", "component_id", "row_hash", "bands")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(no_clash(d, "fp", "component_id")).collect())
    assert got == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert sorted((r.doc_id for r in shingles.keep_first(d).collect())) == [1, 3]


def test_bpe_of_long_and_broken_texts(spark):
    path, pattern = bpe.public_vocabulary()
    texts = [None, "", "x" * 200_000, "é漢🎉\x00 " * 5000]
    d = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "ids", "t", "decoded", "round_trip")
    out = {r.doc_id: r for r in bpe.round_trip(d, path, pattern).collect()}
    assert all(bytes(out[k].decoded) == (t or "").encode() and out[k].valid_utf8 for k, t in enumerate(texts)) and out[0].t == "x"
    checked = {r.doc_id: r for r in bpe.encode_checked(d, path, pattern, words=6, states=30).collect()}
    assert all(checked[k].ids == out[k].ids and checked[k].round_trip for k in out)
    cut_short = spark.createDataFrame([(1, out[3].ids[:1])], "doc_id long, ids array<int>")
    row = bpe.decode(cut_short, path).first()
    assert not row.valid_utf8 or bytes(row.decoded).decode()
