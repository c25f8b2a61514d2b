"""Near-duplicate embeddings by Euclidean p-stable hashing and an exact cosine check.

Vectors scaled to length one are projected on Gaussian directions; the projections, shifted
and cut into steps of a width, are the bucket of a table. Two vectors of cosine 0.95 lie
0.316 apart: one projection agrees with probability 0.82, all 12 of a table with 0.092, and
one table of 32 at least with 0.955; closer pairs meet almost surely.

Buckets of few vectors give candidate pairs of ids, each once. A sketch goes with the
ids: the vector's place in a quarter as many orthonormal directions as it has components, a
byte each. Two vectors are no nearer to each
other than their places, so that a pair whose sketches lie further apart than the radius and
their rounding is below 0.95 for certain. Only for what is left the two vectors are fetched.
Larger buckets are dealt into blocks that carry their vectors, as they hold many true pairs.
Every candidate's cosine is computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm.common import block_pairs, cut, table
from claimgraph.llm.components import components

MIN_COSINE = 0.95
TABLES, PROJECTIONS, WIDTH, SEED = 32, 12, 1.4, 20
BLOCK_ROWS = 512
#: Up to so many vectors a bucket gives pairs of ids; the results do not depend on it.
FEW_ROWS = 64
LEAST_SKETCH, STEPS = 16, 127
_SCALE = float(1 << 20)


def _hashes(unit: np.ndarray) -> np.ndarray:
    """(n, dim) vectors of length one -> (n, TABLES) bucket ids. Components and directions are
    rounded to whole numbers, whose products add up exactly in any order: a vector has the
    same buckets in every batch."""
    rng = np.random.default_rng([SEED, unit.shape[1]])
    directions = rng.standard_normal((unit.shape[1], TABLES * PROJECTIONS))
    shift = rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    odd = rng.integers(0, 1 << 63, PROJECTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    whole = np.rint(unit * _SCALE) @ np.rint(directions * _SCALE)
    steps = np.floor((whole / _SCALE**2 + shift) / WIDTH).astype(np.int64).view(np.uint64)
    mixed = (steps.reshape(-1, TABLES, PROJECTIONS) * odd).sum(axis=2, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def _unit(vectors: list) -> np.ndarray:
    v = np.array(vectors, np.float64)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _sketches(unit: np.ndarray) -> np.ndarray:
    """(n, dim) -> (n, k) bytes: places in orthonormal directions, in steps of 1/STEPS."""
    dim = unit.shape[1]
    k = min(dim, max(LEAST_SKETCH, dim // 4))
    directions = np.linalg.qr(np.random.default_rng([SEED, dim, 1]).standard_normal((dim, k)))[0]
    return np.rint(unit @ directions * STEPS).astype(np.int8)


def _may_link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False only for rows of sketches of vectors that lie further apart than the radius."""
    radius = STEPS * np.sqrt(2 - 2 * MIN_COSINE) + np.sqrt(x.shape[1]) + 1e-3
    return ((x.astype(np.int32) - y) ** 2).sum(axis=1) <= radius * radius


def _by_length(vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length, as lengths may differ, and their unit vectors."""
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, _unit([vectors[i] for i in at])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All tables' buckets of each vector, and its sketch."""
    for b in batches:
        ids = b.column("rep").to_numpy()
        for at, unit in _by_length(b.column("embedding").to_pylist()):
            lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * TABLES, _hashes(unit).ravel())
            dims = pa.array(np.full(len(at), unit.shape[1], np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), dims, pa.array([x.tobytes() for x in _sketches(unit)], pa.binary()), lists], names=["rep", "dim", "sketch", "hashes"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of ids of small buckets whose sketches are near."""
    for b in batches:
        out: list[np.ndarray] = []
        for choice, members in zip(b.column("choice").to_pylist(), b.column("members").to_pylist()):
            members.sort(key=lambda m: m["rep"])
            rep = np.array([m["rep"] for m in members], np.int64)
            sketch = np.frombuffer(b"".join(m["sketch"] for m in members), np.int8).reshape(len(rep), -1)
            i, j = np.triu_indices(len(rep), 1)
            near = _may_link(sketch[i], sketch[j])
            i, j = i[near], j[near]
            out.append(np.stack([rep[i], rep[j], np.full(len(i), choice)]))
        a, c, choice = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(choice.astype(np.int32))], names=["a", "b", "choice"])


def _checked_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _checked, of pairs with their vectors."""
    for t in batches:
        a, b, choice, copies_a, copies_b = (t.column(c).to_numpy() for c in ("a", "b", "choice", "copies_a", "copies_b"))
        other = t.column("vector_b").to_pylist()
        kept = []
        for at, x in _by_length(t.column("vector_a").to_pylist()):
            y = _unit([other[i] for i in at])
            near = (x * y).sum(axis=1) >= MIN_COSINE
            at, x, y = at[near], x[near], y[near]
            if len(at):
                kept.append(at[(_hashes(x) == _hashes(y)).argmax(axis=1) == choice[at]])
        at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        low = np.minimum(a, b)[at]
        columns = [np.concatenate([a[at], b[at]]), np.concatenate([copies_b[at], copies_a[at]]), np.concatenate([low, low])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep", "more", "root"])


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    up = np.arange(n)
    if len(pairs) > 4 * n:  # dense: spread the smallest index along the links
        while True:
            low = up.copy()
            np.minimum.at(low, pairs[:, 0], up[pairs[:, 1]])
            np.minimum.at(low, pairs[:, 1], up[pairs[:, 0]])
            low = low[low]
            if (low == up).all():
                return up
            up = low

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    return np.array([root(i) for i in range(n)])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks: the vectors with links there, how many linked vectors each
    gains, and a member that spans its part of the links. A pair counts only in the first
    table where it meets, so that no pair counts twice."""
    for b in batches:
        out: list[tuple] = []
        for k, same, members in zip(b.column("choice").to_pylist(), b.column("same").to_pylist(), b.column("members").to_pylist()):
            members.sort(key=lambda m: not m["in_a"])
            n, n_a = len(members), sum(m["in_a"] for m in members)
            unit = _unit([m["embedding"] for m in members])
            near = (unit @ unit.T if same else unit[:n_a] @ unit[n_a:].T) >= MIN_COSINE
            i, j = np.nonzero(np.triu(near, 1)) if same else np.nonzero(near)
            if not len(i):
                continue
            j = j if same else j + n_a
            h = _hashes(unit)
            first = np.concatenate([(h[i[s : s + 65536]] == h[j[s : s + 65536]]).argmax(axis=1) for s in range(0, len(i), 65536)]) == k
            i, j = i[first], j[first]
            if not len(i):
                continue
            copies = np.array([m["copies"] for m in members], np.int64)
            more = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
            roots = _roots(n, np.stack([i, j], axis=1))
            out += [(members[x]["rep"], int(more[x]), members[roots[x]]["rep"]) for x in np.flatnonzero(more)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["rep", "more", "root"])


def usable(embedding: str = "embedding") -> F.Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    finite = f"x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')"
    return F.expr(f"{embedding} IS NOT NULL AND forall({embedding}, {finite}) AND exists({embedding}, x -> x <> 0)")


def near_vectors(vectors: DataFrame, block_rows: int = BLOCK_ROWS, few_rows: int = FEW_ROWS) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (vec_id, n_links, component_id, kept), one row for
    each vec_id.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing. Equal vectors are hashed once and counted with their number of copies; of rows
    that repeat an id, the smallest vector that can link counts. Vectors of different
    lengths never link. Rows without an id are left out. Other columns are not read. No
    rows: no rows."""
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter("vec_id is not null")
    rows = cut(own.withColumn("embedding", F.when(usable(), F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    reps = cut(rows.filter("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")
    hashed = reps.select("rep", "embedding").mapInArrow(_buckets, "rep long, dim int, sketch binary, hashes array<long>")
    hashed = cut(hashed, "buckets").select("rep", "dim", "sketch", F.posexplode("hashes").alias("choice", "bucket"))
    key = ["choice", "bucket", "dim"]
    counts = hashed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # written first: joined from its table, both sides are dealt anew and Spark splits a hot bucket
    met = cut(hashed.join(cut(counts, "shared-buckets"), key), "met")
    link = "rep long, more long, root long"

    few = met.filter(F.col("n") <= few_rows).groupBy(*key).agg(F.collect_list(F.struct("rep", "sketch")).alias("members"))
    pairs = few.select("choice", "members").mapInArrow(_pairs, "a long, b long, choice int").groupBy("a", "b").agg(F.min("choice").alias("choice"))
    side = lambda s: reps.select(F.col("rep").alias(s), F.col("copies").alias(f"copies_{s}"), F.col("embedding").alias(f"vector_{s}"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_checked_pairs, link)

    large = block_pairs(met.filter(F.col("n") > few_rows).drop("sketch"), key, block_rows, "rep", "n").join(reps, "rep")
    groups = large.groupBy(*key, "block_a", "block_b").agg(F.collect_list(F.struct("rep", "copies", "embedding", (F.col("side") == F.col("block_a")).alias("in_a"))).alias("members"))
    same = (F.col("block_a") == F.col("block_b")).alias("same")
    dense = groups.filter("size(members) > 1").select("choice", same, "members").mapInArrow(_checked, link)

    links = cut(found.unionByName(dense), "links")
    found = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), "embeddings")
    more = links.groupBy("rep").agg(F.sum("more").alias("more"))
    named = (
        reps.join(more, "rep", "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select("embedding", (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = rows.filter("embedding is not null").join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
ORACLE_SQL: dict[str, str] = {}
