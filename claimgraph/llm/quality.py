"""Quality classifier: random Fourier features of document statistics, ridge, isotonic.

A document becomes some twenty statistics of its bytes, words and lines. Cosines of random
projections of the standardised statistics approximate a Gaussian kernel. Each partition of
the labelled rows sums its part of the normal equations; the sums, of a size fixed by the
number of features, give the ridge scores. Labels summed by bins of the score, again of a
fixed number, give the isotonic calibration.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph.llm.common import cut, small_batches, table

FEATURES, RIDGE, SEED = 128, 1e-3, 7
BINS, FOLDS = 500, 4
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"#$%&*@^~", b"-_=+<>/\\{}[]()", b"'\"`"]
_CLASS = np.full(256, len(_CLASSES), np.int64)  # what is left: control bytes
_CLASS[128:] = len(_CLASSES) + 1
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
N_STATS = len(_CLASSES) + 2 + 13


def statistics(text: str | None) -> list[float]:
    """Of one whole text; null counts as empty. Every statistic is finite."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_CLASS, histogram, len(_CLASSES) + 2) / n
    some = histogram[histogram > 0] / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    w, ln = max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    letters = max(1, int(histogram[65:91].sum() + histogram[97:123].sum()))
    return [
        *share.tolist(),
        math.log1p(len(raw)),
        float(-(some * np.log(some)).sum()),
        sum(map(len, words)) / w,
        math.log1p(max(map(len, words), default=0)),
        len(counts) / w,
        max(counts.values(), default=0) / w,
        sum(x[:1].isupper() for x in words) / w,
        sum(x.isupper() for x in words) / w,
        sum(not x[-1:].isalnum() and x[-1:] < b"\x80" for x in words) / w,
        float(histogram[65:91].sum()) / letters,
        math.log1p(len(raw) / ln),
        len(set(lines)) / ln,
        math.log1p(sum(map(len, words)) / max(1, raw.count(b".") + raw.count(b"?") + raw.count(b"!"))),
    ]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.array([statistics(t) for t in b.column("text").to_pylist()], float).reshape(-1)
        lists = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * N_STATS, values)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], names=["doc_id", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_stats, "doc_id long, stats array<double>")


@dataclass
class Model:
    """Small and of fixed size, whatever it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        directions = rng.standard_normal((N_STATS, FEATURES)) / math.sqrt(N_STATS)
        phases = rng.uniform(0, 2 * math.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -4, 4)
        return np.hstack([np.cos(x @ directions + phases) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """0 to 1."""
        return np.interp(self.raw(stats), self.knots, self.levels) if len(stats) else np.zeros(0)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("stats").flatten().to_numpy().reshape(-1, N_STATS)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising x -> centres and levels of the pools."""
    pools: list[list[float]] = []
    for centre, total, w in zip(x * weight, y * weight, weight):
        pools.append([centre, total, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], np.clip(p[:, 1] / p[:, 2], 0, 1)


def fit(labelled: DataFrame) -> Model:
    """labelled(stats array<double>, label 0 or 1, fold 0 to FOLDS - 1). Of every row; only
    sums and bins of a fixed size come to the driver. The calibration sees each fold by the
    scores of weights fitted without it. Without rows, the model gives 0.5 for everything."""
    each = labelled.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    model = Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    if not each:
        return model
    for r in each:
        model.mean[r["i"]], model.scale[r["i"]] = r["m"], max(r["s"], 1e-6)
    upper = np.triu_indices(FEATURES + 1)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1))
        n = np.zeros(FOLDS, np.int64)
        for b in batches:
            z, y, fold = model.features(_matrix(b)), b.column("label").to_numpy().astype(float), b.column("fold").to_numpy()
            for f in np.unique(fold):
                own = z[fold == f]
                gram[f] += own.T @ own
                right[f] += own.T @ y[fold == f]
                n[f] += len(own)
        i, j = np.concatenate([upper[0], np.arange(FEATURES + 1)]), np.concatenate([upper[1], np.full(FEATURES + 1, -1)])
        for f in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), f, np.int32)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([gram[f][upper], right[f]]))], names=["fold", "i", "j", "x"])

    rows = labelled.select("stats", "label", F.col("fold").cast("int").alias("fold"))
    sums = rows.mapInArrow(summed, "fold int, i int, j int, x double").groupBy("fold", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    gram, right = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1))
    inner, outer = sums[sums.j >= 0], sums[sums.j < 0]
    gram[inner.fold, inner.i, inner.j] = gram[inner.fold, inner.j, inner.i] = inner.x
    right[outer.fold, outer.i] = outer.x

    def solved(use: list[int]) -> np.ndarray:
        g = gram[use].sum(axis=0)
        penalty = RIDGE * g[-1, -1] * np.eye(FEATURES + 1)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(g + penalty, right[use].sum(axis=0))

    model.weights = solved(list(range(FOLDS)))
    # a fold that holds all rows is scored by the weights of all
    without = np.stack([solved([f for f in range(FOLDS) if f != own]) if (gram[:, -1, -1].sum() > gram[own, -1, -1]) else model.weights for own in range(FOLDS)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = (model.features(_matrix(b)) * without[b.column("fold").to_numpy()]).sum(axis=1)
            bins = np.floor(np.clip(raw, -0.5, 1.5) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), b.column("label").cast(pa.float64())], names=["bin", "y"])

    bins = rows.mapInArrow(scored, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("bin")
    model.knots, model.levels = isotonic((bins["bin"].to_numpy() + 0.5) / BINS, bins["y"].to_numpy(), bins["n"].to_numpy().astype(float))
    return model


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def fit_on(stats: DataFrame, labels: DataFrame) -> Model:
    """On the labelled rows that are not held out. Labels other than 0 and 1 and null ids
    are left out; of labels that repeat an id, the larger counts."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    return fit(cut(stats.filter(~held_out()).join(own, "doc_id").select("stats", "label", F.expr(f"pmod(xxhash64(doc_id), {FOLDS})").alias("fold")), "labelled"))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) and labels(doc_id, quality, ...) -> (doc_id, held_out, score,
    predicted), one row for each row of docs.

    Null and empty texts are scored by their statistics; repeated rows stay. A null doc_id
    has held_out null. Only doc_id and text are read, and of doc_id only which rows may
    teach. No rows: no rows; no labels: every score is 0.5."""
    stats = cut(document_statistics(docs), "statistics")
    model = fit_on(stats, labels)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b)), pa.float64())], names=["doc_id", "score"])

    out = stats.mapInArrow(apply, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def scorer(model: Model) -> Callable[[F.Column], F.Column]:
    """The model as a function of a text column: rows keep their other columns, unmoved."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        rows = [statistics(t if isinstance(t, str) else None) for t in texts]
        return pd.Series(model.score(np.array(rows, float).reshape(-1, N_STATS)), dtype=float)

    return score


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is 0.5 or more."""
    model = fit_on(document_statistics(docs), labels)
    return docs.filter(scorer(model)(F.col("text").cast("string")) >= 0.5)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_quality": op7_quality}
ORACLE_SQL: dict[str, str] = {}
