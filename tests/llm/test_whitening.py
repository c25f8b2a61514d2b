import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgraph.llm import whitening


def random_basis(n, seed=0):
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]


@pytest.mark.parametrize(
    "values",
    [[3.0], [2.0, 2.0], [1.0] * 5, [0.0] * 4, [5, 5, 5, 1, 1, 0, 0, 0], list(10.0 ** -np.arange(25)), [1, 1 + 1e-9, *[2] * 9, *[3] * 18], list(np.linspace(1, 1.2, 64)), [1e9, *np.linspace(1, 2, 30)]],
)
def test_components_of_any_spectrum(values):
    q, e = random_basis(len(values)), np.array(values, float)
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.spectral(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.abs(got - np.sort(e)[::-1]).max() <= 1e-14 * size and (np.diff(got) <= 0).all()
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-13 and np.abs(a @ x - x * got).max() <= 1e-14 * size


def test_polar_factor_is_the_sign():
    q, e = random_basis(12, 1), np.array([-5, -1, -1e-3, -1e-8, 1e-8, 1e-3, 0.1, 1, 2, 3, 40, 1000.0])
    assert np.abs(whitening.polar((q * e) @ q.T) - (q * np.sign(e)) @ q.T).max() < 1e-5
    far = np.where(np.abs(e) < 1e-2, 1.0, e)
    assert np.abs(whitening.polar((q * far) @ q.T) - (q * np.sign(far)) @ q.T).max() < 1e-13


def direct(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u / np.sqrt(np.where(e > 1e-9, e, np.nan)), e / e.sum()


def saved(spark, tmp_path, rows, schema="vec_id long, embedding array<float>, label int"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_op12_equals_a_direct_solution(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.floor(np.array([r.embedding for r in rows], float) * 64).astype(np.int64) + 1_000_000
    n, deviation, white, share = direct(x)
    out = whitening.op12_whitening(spark, sf).collect()
    assert len(out) == 16 * len(rows) and {r.n for r in out} == {n} and max(r.identity_error for r in out) < 1e-9
    got = {(r.vec_id, r.component): r for r in out}
    theirs = np.array([[got[r.vec_id, k + 1].whitened for k in range(16)] for r in rows])
    sign = np.sign((theirs * white[:, :16]).sum(axis=0))
    assert np.abs(theirs * sign - white[:, :16]).max() < 1e-8
    assert [got[r.vec_id, 1].deviation for r in rows] == deviation.tolist()
    assert max(abs(got[rows[0].vec_id, k + 1].explained / share[k] - 1) for k in range(16)) < 1e-9


def test_edges(spark, tmp_path):
    """Nulls, non-finite entries, repeats, other sizes, dimensions without variance."""
    bad = [(90, None, 1), (91, [1.0, None, 2.0], 1), (92, [1.0, float("nan"), 0.0], 1), (93, [float("-inf"), 0.0, 0.0], 1), (94, [], 1), (95, [1.0, 2.0], None)]
    good = [(k, [float(np.sin(k)), float(np.cos(3 * k)), 0.5], None) for k in range(40)]
    good += [good[3], (None, good[5][1], 1)] + [(k, good[7][1], 2) for k in range(50, 80)]  # a hot copy
    out = whitening.op12_whitening(spark, saved(spark, tmp_path, bad + good)).collect()
    n, deviation, white, share = direct(np.floor(np.array([g[1] for g in good]) * 64).astype(np.int64) + 1_000_000)
    assert n <= 40 and {r.n for r in out} == {n} and len(out) == 3 * len(good)
    assert {r.whitened for r in out if r.component == 3} == {None} and {r.explained for r in out if r.component == 3} <= {0.0, *[r.explained for r in out if r.component == 3 and abs(r.explained) < 1e-12]}
    first = sorted(abs(r.whitened) for r in out if r.component == 1)
    assert np.allclose(first, np.sort(np.abs(white[:, 0]))) and out[0].identity_error < 1e-9
    assert sorted(r.deviation for r in out if r.component == 2) == sorted(deviation.tolist())


def test_one_vector_none_and_huge_entries(spark, tmp_path):
    one = whitening.op12_whitening(spark, saved(spark, tmp_path / "a", [(1, [0.5, 1.0], 0)] * 3)).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    assert whitening.op12_whitening(spark, saved(spark, tmp_path / "b", [(1, None, 0)])).collect() == []
    huge = whitening.op12_whitening(spark, saved(spark, tmp_path / "c", [(1, [1e300], 0), (2, [-3e38], 0), (3, [1.0], 0)], "vec_id long, embedding array<double>, label int")).collect()
    assert {r.n for r in huge} == {3} and all(r.deviation is None for r in huge if r.vec_id < 3) and huge[0].identity_error < 1e-9


def test_long_sums_are_exact(spark):
    """Deviations at the border of a long, and past doubles' exactness."""
    rows = [(k, [10**9 + k, 2 * 10**9 + 3 * k * k]) for k in range(12)]
    d = spark.createDataFrame(rows, "vec_id long, x array<long>").withColumn("deviation", F.lit("clash"))
    model = whitening.fit(d, 16)
    s = [sum(x[j] for _, x in rows) for j in range(2)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(d, model).collect()}
    assert got == {k: sum((12 * x[j] - s[j]) ** 2 for j in range(2)) for k, x in rows} and model.sums == s
