"""The pipeline's stages, one after the other, against what each should have done to its input."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_quality import ridge, rising

from claimgraph.llm import bpe, mixing, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The documents and labels of the smallest scale with planted copies, nulls and blanks."""
    at = str(tmp_path_factory.mktemp("sf"))
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    top = docs.agg({"doc_id": "max"}).first()[0]
    rng = random.Random(1)
    block = "\n".join(" ".join(rng.choices("alpha beta gamma delta epsilon".split(), k=14)) for _ in range(3))
    texts = [block, block + "\n" + "A line of its own that nobody else has in this folder.", "", None]
    more = [(top + 1 + k, t, "en", None if k % 2 else "web", len(t or "")) for k, t in enumerate(texts)]
    docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns)).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def steps(spark, folder):
    """Each stage's rows, by name; documents are the first."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {"documents": docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage-{k}.parquet")
        docs = spark.read.parquet(f"{folder}/stage-{k}.parquet")
        out[name] = docs.collect()
    return out


def test_quality_keeps_what_a_plain_model_keeps(spark, steps, folder):
    docs, labels = {r.doc_id: r for r in steps["documents"]}, {}
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.quality)
    taught = [i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 3 != 1]
    fold = {r.doc_id: r.f for r in spark.createDataFrame([(i,) for i in taught], "doc_id long").selectExpr("doc_id", f"pmod(xxhash64(doc_id), {quality.FOLDS}) AS f").collect()}
    stats = {i: np.array(quality.statistics(r.text)) for i, r in docs.items()}
    own = np.stack([stats[i] for i in taught])
    mean, scale = own.mean(axis=0), np.maximum(own.std(axis=0), 1e-6)
    model = quality.Model(mean, scale, np.zeros(0), np.zeros(0), np.zeros(0))
    z, y, f = model.features(own), np.array([labels[i] for i in taught]), np.array([fold[i] for i in taught])
    raw = np.zeros(len(y))
    for k in range(quality.FOLDS):
        raw[f == k] = z[f == k] @ ridge(z[f != k], y[f != k])
    bins = np.floor(np.clip(raw, -0.5, 1.5) * quality.BINS).astype(int)
    at = np.unique(bins)
    weight = np.array([(bins == b).sum() for b in at], float)
    levels = rising(np.array([y[bins == b].mean() for b in at]), weight).round(9)
    pools = [np.average((at[levels == v] + 0.5) / quality.BINS, weights=weight[levels == v]) for v in np.unique(levels)]
    score = np.interp(model.features(np.stack(list(stats.values()))) @ ridge(z, y), pools, np.unique(levels))
    sure = {i: s >= 0.5 for i, s in zip(stats, score) if abs(s - 0.5) > 1e-4}
    kept = {r.doc_id for r in steps["quality"]}
    assert kept == {i for i in docs if sure.get(i, i in kept)} and 0 < len(kept) < len(docs) and len(sure) > 0.9 * len(docs)
    assert set(steps["quality"]) <= set(steps["documents"])


def test_lines_cut_what_any_earlier_document_holds(steps):
    before = sorted(steps["quality"], key=lambda r: r.doc_id)
    lines = {r.doc_id: [x.strip(" ") for x in r.text.split("\n")] for r in before if r.text is not None}
    after = {r.doc_id: r for r in steps["lines"]}
    where = {}
    for r in before:
        own = lines.get(r.doc_id)
        if own is None:
            assert after[r.doc_id].text is None
            continue
        gone = set()
        for i, x in enumerate(own):
            for d, j in where.get(x, []):
                k = 0
                while i + k < len(own) and j + k < len(lines[d]) and own[i + k] == lines[d][j + k]:
                    k += 1
                gone |= set(range(i, i + k)) if sum(map(len, own[i : i + k])) >= 30 else set()
        left = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone)
        if gone and not left.strip(" "):
            assert r.doc_id not in after
        else:
            assert after[r.doc_id].text == left and after[r.doc_id].n_chars == len(left)
        for j, x in enumerate(own):
            where.setdefault(x, []).append((r.doc_id, j))


def test_near_duplicates_keep_the_smallest(steps):
    """Against the similarities of all pairs of sets of five-word shingles."""
    sets = {}
    for r in steps["lines"]:
        w = (r.text or "").lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            x, y = sets[i], sets[j]
            if i < j and (x == y or (x and y and len(x & y) >= 0.8 * len(x | y))):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in steps["near-duplicates"]) == sorted({root(i) for i in ids})


def test_mixing_repeats_whole_rows(spark, steps, folder):
    before, after = {r.doc_id: r for r in steps["near-duplicates"]}, steps["mixing"]
    assert all(before[r.doc_id] == r for r in after)
    rates = {r.source: r.rate for r in mixing.rates(spark.read.parquet(f"{folder}/stage-2.parquet")).collect()}
    for source, rate in rates.items():
        n = sum(r.source == source for r in before.values())
        got = sum(r.source == source for r in after)
        assert abs(got - n * rate) <= 6 * (n * rate) ** 0.5 + 1


def test_tokens_are_those_of_the_library(steps):
    path, pattern = bpe.public_vocabulary()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in steps["mixing"]}
    assert len(steps["tokens"]) == len(steps["mixing"])
    for r in steps["tokens"]:
        assert r.ids == reference.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_stages_take_empty_tables_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("version", "removed", "moved", "row_hash", "copy", "place", "rate", "steps", "u", "n", "stats", "score", "s_source", "node"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.filter("copy <> concat('copy', doc_id) or rate <> concat('rate', doc_id)").count() == 0
        assert 0 < out.count() and stage(spark, docs.limit(0), folder).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.limit(0), folder).count() == 0
