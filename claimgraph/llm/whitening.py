"""Whitening of embeddings by spectral divide and conquer.

Sums, products and projections are Spark's: tasks add up their rows' parts in numpy, and what goes
to the driver is one number per dimension or pair of dimensions. The covariance is then split
there: the polar factor of the covariance less a shift (QDWH iteration) is its matrix sign, which
gives projectors onto the components above and below the shift; each half is projected and split
again, until every part has one dimension. The components go to all tasks as a matrix of at most
MOST_DIMENSIONS columns."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm.bpe import _with_parts
from claimgraph.llm.common import cut, no_clash, table

#: The driver holds a few matrices of so many rows and columns: 128 MB each.
MOST_DIMENSIONS = 4096
SCALE, OFFSET = 64, 1_000_000
_EPS = float(np.finfo(float).eps)
_ROOM = 2.0**62  # sums of long numbers below this do not overflow
#: Eigenvalues below this share of the largest are rounding.
_RANK = 1e-12


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH: each step maps the singular
    values by the best rational function of its kind, by QR while they are far from 1, then
    by Cholesky factors."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = max(_EPS, _least(x))
    for _ in range(30):
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        h = np.sqrt(1 + d) + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))) / 2
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))[0]
            new = (b / c) * x + (h - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        else:
            half = np.linalg.solve(np.linalg.cholesky(np.eye(n) + c * x.T @ x), x.T)
            full = np.linalg.solve(np.linalg.cholesky(np.eye(n) + c * x.T @ x).T, half)
            new = (b / c) * x + (h - b / c) * full.T
        low = min(1.0, low * (h + b * square) / (1 + c * square))
        moved = np.linalg.norm(new - x)
        x = (new + new.T) / 2
        if moved < _EPS ** (1 / 3) and 1 - low < 10 * _EPS:
            break
    return x


def _least(x: np.ndarray) -> float:
    """A lower estimate of the smallest singular value."""
    try:
        inverse = np.linalg.inv(x)
    except np.linalg.LinAlgError:
        return 0.0
    most = float(np.linalg.norm(inverse, 1)) * np.sqrt(len(x))
    return 0.9 / most if np.isfinite(most) else 0.0


def _halves(a: np.ndarray, size: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the components above and below a shift; None where all eigenvalues are equal up to rounding."""
    n = len(a)
    middle = float(np.trace(a)) / n
    spread = float(np.linalg.norm(a - middle * np.eye(n)))
    if spread <= n * _EPS * size:
        return None
    shift = float(np.median(np.diag(a)))
    for attempt in range(60):
        sign = polar(a - shift * np.eye(n))
        above = (sign + np.eye(n)) / 2
        rank = round(float(np.trace(above)))
        if 0 < rank < n and np.linalg.norm(above @ above - above) < 1e-10 * n:
            q = np.linalg.qr(above @ rng.standard_normal((n, n)))[0]
            first = np.linalg.qr(above @ q[:, :rank])[0]
            rest = q[:, rank:] - first @ (first.T @ q[:, rank:])
            second = np.linalg.qr(rest - above @ rest)[0]
            if np.linalg.norm(second.T @ a @ first) <= 100 * n * _EPS * size:
                return first, second
        shift = middle + spread * float(rng.uniform(-1, 1)) / np.sqrt(n) * min(1.0, 0.1 * (attempt + 1))
    raise ArithmeticError("no shift splits the matrix")


def spectral(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix."""
    size, rng = float(np.linalg.norm(a)), np.random.default_rng(0)
    done, open_ = [], [np.eye(len(a))]
    while open_:
        basis = open_.pop()
        part = basis.T @ a @ basis
        split = _halves((part + part.T) / 2, size, rng) if basis.shape[1] > 1 else None
        if split is None:
            done.append(basis)
        else:
            open_ += [basis @ half for half in split]
    x = np.hstack(done) if done else np.zeros((0, 0))
    values = np.einsum("ij,ij->j", x, a @ x)
    by = np.argsort(-values, kind="stable")
    return values[by], x[:, by]


@dataclasses.dataclass
class Whitening:
    """What tasks need to whiten: n vectors, sums per dimension, components as columns, their
    eigenvalues, the trace, and the largest deviation of whitened vectors' covariance from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        # whole part and remainder by themselves: long sums lose nothing
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        """Components over the root of their eigenvalues; those without variance are not numbers."""
        real = self.eigenvalues > _RANK * max(float(self.eigenvalues.max(initial=0.0)), 0.0)
        return self.components / np.where(real, np.sqrt(np.where(real, self.eigenvalues, 1.0)), np.nan)


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite entries, nor empty."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda v: F.coalesce(bad(v.cast("double")), F.lit(True))), F.lit(False))


def quantised(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry; entries beyond 2 to the power 60 count as that."""
    most = 2.0**60
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(most)), F.lit(-most))) + OFFSET)


def _matrix(x: pa.Array, d: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for b in batches:
        if b.num_rows:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            part = x.sum(axis=0) if float(np.abs(x.astype(float)).max()) * len(x) < _ROOM else x.astype(object).sum(axis=0)
            n, part = n + len(x), np.array([int(p) for p in part], object)
            total = part if total is None else total + part
    if n:
        yield pa.RecordBatch.from_pydict({"dimension": pa.array(range(len(total)), pa.int32()), "rows": pa.array([n] * len(total), pa.int64()), "total": [str(t) for t in total]})


def _products(fit: DataFrame, mean: np.ndarray, projection: np.ndarray | None) -> np.ndarray:
    """The sum over all rows of the products of two dimensions of x - mean, projected if wanted."""
    d, size = len(mean), len(mean) if projection is None else projection.shape[1]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            y = _matrix(b.column(0), d) - mean
            y = y if projection is None else y @ projection
            total += y.T @ y
        i, j = np.indices((size, size))
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "s": pa.array(total.ravel())})

    out = np.zeros((size, size))
    for r in fit.select("x").mapInArrow(parts, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = r.s
    return (out + out.T) / 2


def fit(vectors: DataFrame, most: int) -> Whitening | None:
    """Of the distinct vectors x (array<long>, all of one size); None if there are none. They
    are made distinct partially before the shuffle, written once and read three times."""
    distinct = cut(vectors.select("x").distinct(), "whitening-distinct")
    # one row a dimension
    sums = distinct.mapInArrow(_sums, "dimension int, rows long, total string").groupBy("dimension").agg(F.sum("rows").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).orderBy("dimension").collect()
    if not sums:
        return None
    if len(sums) > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} dimensions")
    n = sums[0].n
    made = Whitening(n, [int(r.s) for r in sums], np.zeros((len(sums), 0)), np.zeros(0), 0.0, None)
    covariance = _products(distinct, made.mean, None) / n
    values, components = spectral(covariance)
    made.components, made.eigenvalues, made.trace = components[:, :most], values[:most], float(np.trace(covariance))
    real = np.isfinite(made.projection).all(axis=0)
    if real.any():
        # x - mean has mean zero up to rounding, so its projections are centred
        whitened = _products(distinct, made.mean, made.projection[:, real]) / n
        made.identity_error = float(np.abs(whitened - np.eye(int(real.sum()))).max())
    return made


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """Adds deviation long, the sum over dimensions of (n * x - sums)^2, and whitened
    array<double>, the projections of x - mean on the components over the root of their
    eigenvalues, for the column x. A deviation beyond a long is null, as is the projection on a
    component without variance. Other columns pass unread."""
    n, sums, mean, projection, d = model.n, model.sums, model.mean, model.projection, len(model.sums)

    def deviations(x: np.ndarray) -> list[int | None]:
        about = (((x - mean) * n) ** 2).sum(axis=1)
        if float(about.max(initial=0.0)) < _ROOM and float(np.abs(x.astype(float)).max(initial=1.0)) * n < _ROOM:
            return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]

    @F.arrow_udf("struct<deviation: bigint, whitened: array<double>>")
    def parts(x: pa.Array) -> pa.Array:
        m = _matrix(x, d)
        flat = ((m - mean) @ projection).ravel()
        ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * projection.shape[1])
        return pa.StructArray.from_arrays([pa.array(deviations(m), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat, from_pandas=True))], names=["deviation", "whitened"])

    return _with_parts(no_clash(vectors, "deviation", "whitened"), parts("x"))


def usual_size(vectors: DataFrame) -> int | None:
    """The commonest number of entries, ties to the larger; one row reaches the driver."""
    found = vectors.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first().m
    return found and found.d


def op12_whitening(spark: SparkSession, sf_dir: str, most: int = 16) -> DataFrame:
    """Repeated rows and null ids stay, each for itself. Vectors of another size than the
    commonest take no part. Components without variance have no whitened value; a trace of
    zero has no explained shares."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("x"))
    d = usual_size(rows)
    rows = rows.filter(F.size("x") == (d or 0))
    model = fit(rows, most) if d else None
    if model is None:
        schema = rows.select("vec_id").schema[0].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {schema}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else None).cast("double") for e in model.eigenvalues])
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


QUERIES: dict[str, Callable] = {"op12_whitening": op12_whitening}
ORACLE_SQL: dict[str, str] = {}
