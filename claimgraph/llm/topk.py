"""Exact top-k search by inner product without random access.

The rows of a part are taken in blocks; a block keeps one list for each component, sorted by
value. For a query the best end of a component's list is its head if the query's component
is positive and its tail otherwise, so that each list yields its contributions in falling
order. Lists are read in step, in large chunks, and queries of a block are read together.

What has been read bounds a row's score from above: a contribution that was not read is at
most the last one read. Its bound from below is the k-th best score of the blocks before,
which a query carries from block to block. A block whose first entries cannot reach it is
left unread; rows whose upper bound is under it are outside; reading stops when few rows
are inside, and the rest of the lists is read for these alone. Where nothing is carried yet
the lists are read to their ends, and their sums are the scores. One row in k of a query
leaves a part, however many blocks it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgraph.llm.common import cut, table

K = 20
PART_ROWS, BLOCK_ROWS, QUERY_ROWS = 65_536, 4096, 512
#: Shares of the lists after which bounds are looked at, and the share of rows that are few.
DEPTHS, FEW = (0.25, 0.5, 0.75), 0.02
_LOW = -(1 << 62)
_PAIRS = 1 << 15


class Best:
    """The k best rows of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores = np.full((n, k), _LOW, np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(query)
        who = np.concatenate([np.repeat(touched, self.k), query])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        order = np.lexsort((ids, -scores, who))
        first = np.searchsorted(who[order], touched)
        keep = order[first[:, None] + np.arange(self.k)]
        self.ids[touched], self.scores[touched] = ids[keep], scores[keep]


class Search:
    """Of a block of queries (ids, q), block by block of rows. read and entries count list
    entries that were read and that there were; early and blocks the pairs of a query and a
    block that ended before the lists did, and all."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q = ids, q
        self.best = Best(len(ids), k)
        self.read = self.entries = self.early = self.blocks = 0

    def block(self, ids: np.ndarray, x: np.ndarray) -> None:
        n, k = len(ids), self.best.k
        # sums of whole numbers are exact in the smallest type whose digits hold them
        most = float(np.abs(self.q).astype(float).sum(axis=1).max(initial=0)) * float(np.abs(x).max(initial=0))
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        x, q = x.astype(kind), self.q.astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        lists = np.sort(np.ascontiguousarray(x.T), axis=1)
        self.entries += x.size * len(q)
        self.blocks += len(q)
        kth = self.best.kth()
        live = np.flatnonzero(up @ lists[:, -1] + down @ lists[:, 0] >= kth)
        self.early += len(q) - len(live)
        done = 0
        for depth in (int(n * share) for share in DEPTHS):
            if not len(live) or depth < 1 or kth[live].min() == _LOW:
                break
            upper = up[live] @ np.maximum(x, lists[:, n - depth]).T + down[live] @ np.minimum(x, lists[:, depth - 1]).T
            inside = upper >= kth[live, None]
            self.read += (depth - done) * x.shape[1] * len(live)
            done = depth
            some = inside.any(axis=1)
            self.early += len(live) - int(some.sum())
            live, inside = live[some], inside[some]
            if inside.mean() <= FEW if len(live) else True:
                self.early += len(live)
                self.rest(live, inside, ids, x, q, done)
                return
        if len(live):
            self.read += (n - done) * x.shape[1] * len(live)
            scores = q[live] @ x.T
            scores[self.ids[live][:, None] == ids[None, :]] = _LOW
            least = np.maximum(kth[live], np.partition(scores, n - min(k, n), axis=1)[:, n - min(k, n)])
            i, j = np.nonzero((scores >= least[:, None]) & (scores > _LOW))
            self.best.add(live[i], ids[j], scores[i, j].astype(np.int64))

    def rest(self, live: np.ndarray, inside: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, done: int) -> None:
        """The lists' rest for the rows inside."""
        i, j = np.nonzero(inside)
        self.read += len(i) * x.shape[1] * (len(ids) - done) // max(1, len(ids))
        i = live[i]
        other = self.ids[i] != ids[j]
        i, j = i[other], j[other]
        for at in range(0, len(i), _PAIRS):
            a, b = i[at : at + _PAIRS], j[at : at + _PAIRS]
            scores = (q[a] * x[b]).sum(axis=1).astype(np.int64)
            use = scores >= self.best.kth()[a]
            if use.any():
                self.best.add(a[use], ids[b][use], scores[use])


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, v = t.column("vec_id").combine_chunks(), t.column("v").combine_chunks()
    return ids.to_numpy(), v.flatten().to_numpy().reshape(len(ids), -1)


def _searched(k: int, block_rows: int):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if rows.num_rows and queries.num_rows:
            (ids, x), own = _matrix(rows), Search(*_matrix(queries), k)
            for at in range(0, len(ids), block_rows):
                own.block(ids[at : at + block_rows], x[at : at + block_rows])
            i, j = np.nonzero(own.best.scores > _LOW)
            out = [own.ids[i], own.best.ids[i, j], own.best.scores[i, j]]
        return pa.table(out, names=["query_id", "vec_id", "score"])

    return search


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """rows and queries (vec_id long, v array<long>) -> (query_id, rank, vec_id, score): the
    k rows of largest inner product with each query, other than those of its own id; ties
    to the smaller id. Vectors meet those of their own length; rows that repeat an id all
    take part, and queries that share one are ranked together. Blocks of queries meet parts
    of rows by key; the best of each part are ranked again. No rows or queries: no rows."""
    sizes = rows.agg(F.count(F.lit(1))).first()[0], queries.agg(F.count(F.lit(1))).first()[0]
    n_parts, n_query_blocks = (max(1, -(-n // per)) for n, per in zip(sizes, (part_rows, query_rows)))
    part, query_block = F.expr(f"pmod(xxhash64(vec_id, v, 1), {n_parts}L)"), F.expr(f"pmod(xxhash64(vec_id, v, 2), {n_query_blocks}L)")
    each = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    dealt = rows.select("vec_id", "v", F.size("v").alias("dim"), part.alias("part"), each(n_query_blocks).alias("query_block"))
    asked = queries.select("vec_id", "v", F.size("v").alias("dim"), each(n_parts).alias("part"), query_block.alias("query_block"))
    key = ["part", "query_block", "dim"]
    columns = lambda df: df.select(*key, "vec_id", "v").groupBy(*key)
    found = columns(dealt).cogroup(columns(asked)).applyInArrow(_searched(k, block_rows), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x, one row for each row. Vectors that
    are null, empty or hold null or non-finite components, and rows without an id, are left
    out. Other columns are not read."""
    finite = F.expr("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    rows = vectors.filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(integer_vectors(table(spark, sf_dir, "embeddings")), "integer-vectors")
    return top_k(rows, rows.filter("vec_id % 20 = 0"))


QUERIES = {"op4_topk": op4_topk}
ORACLE_SQL = {
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
}
