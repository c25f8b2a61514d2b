"""The quality classifier against direct solutions."""

import numpy as np
import pytest

from claimgraph.llm import quality


def features(model, stats):
    """Written out anew: cosines of random projections of what is standardised."""
    rng = np.random.default_rng(quality.SEED)
    w = rng.standard_normal((stats.shape[1], quality.FEATURES)) / np.sqrt(stats.shape[1])
    b = rng.uniform(0, 2 * np.pi, quality.FEATURES)
    x = np.clip((stats - stats.mean(axis=0)) / np.maximum(stats.std(axis=0), 1e-6), -4, 4)
    return np.column_stack([np.cos(x @ w + b) * np.sqrt(2 / quality.FEATURES), np.ones(len(x))])


def ridge(z, y):
    """By least squares on stacked rows, not by normal equations."""
    root = np.sqrt(np.append(np.full(z.shape[1] - 1, quality.RIDGE * len(z)), 1e-9))
    return np.linalg.lstsq(np.vstack([z, np.diag(root)]), np.append(y, np.zeros(z.shape[1])), rcond=None)[0]


def rising(y, w):
    """The isotonic levels by their min-max formula."""
    n = len(y)
    mean = lambda i, j: np.average(y[i : j + 1], weights=w[i : j + 1])
    return np.array([max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)])


def test_isotonic():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30):
        y, w = rng.uniform(size=n), rng.integers(1, 9, n).astype(float)
        x, levels = quality.isotonic(np.arange(n, dtype=float), y, w)
        want = rising(y, w)
        assert np.allclose(np.unique(levels), np.unique(want.round(12)), atol=1e-9) and (np.diff(x) > 0).all()


def test_weights_and_levels(spark):
    rng = np.random.default_rng(2)
    stats = rng.normal(size=(140, quality.N_STATS)) * rng.uniform(0.1, 9, quality.N_STATS)
    y = (stats[:, 0] + rng.normal(size=140) > 0).astype(int)
    fold = rng.integers(0, quality.FOLDS, 140)
    rows = [(s.tolist(), int(t), int(f)) for s, t, f in zip(stats, y, fold)]
    model = quality.fit(spark.createDataFrame(rows, "stats array<double>, label int, fold int").repartition(3))
    z = features(model, stats)
    assert np.allclose(model.weights, ridge(z, y), atol=1e-6)
    raw = np.array([z[k] @ ridge(z[fold != f], y[fold != f]) for f in range(quality.FOLDS) for k in np.flatnonzero(fold == f)])
    y = np.concatenate([y[fold == f] for f in range(quality.FOLDS)])
    bins = np.floor(np.clip(raw, -0.5, 1.5) * quality.BINS).astype(int)
    at = np.unique(bins)
    want = rising(np.array([y[bins == b].mean() for b in at]), np.array([(bins == b).sum() for b in at], float))
    assert np.allclose(np.unique(model.levels.round(9)), np.unique(want.round(9)), atol=1e-6)


def test_held_out_rows(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.scores(d, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    rows = quality.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.scores(empty, labels).count() == 0


def test_few_or_no_labels(spark, docs):
    """No labels: half for every text, and all are kept. One row alone is scored as it is."""
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scores(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).count() == docs.count()
    own = [i for i in range(46) if not spark.sql(f"SELECT crc32(cast('{i}' AS binary)) % 3 = 1").first()[0]][:1]
    one = spark.createDataFrame([(own[0], 1), (own[0], 0), (None, 1), (own[0], 7)], "doc_id long, quality int")
    assert all(r.score == pytest.approx(1.0) for r in quality.scores(docs, one).collect())
