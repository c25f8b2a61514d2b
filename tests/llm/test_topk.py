"""Top-k search against whole products: scores, ties, and how much of the lists is read."""

import numpy as np
import pytest

from claimgraph.llm import topk


def best(ids, x, own, q, k):
    return sorted((-int(v), int(i)) for v, i in zip(x @ q, ids) if i != own)[:k]


def searched(ids, x, query_ids, q, k, block):
    s = topk.Search(query_ids, q, k)
    for at in range(0, len(ids), block):
        s.block(ids[at : at + block], x[at : at + block])
    return s


@pytest.mark.parametrize("most", [2, 40, 1 << 20, 1 << 27])
def test_blocks_against_products(most):
    """Small values tie often, across blocks too; large ones need wider numbers."""
    rng = np.random.default_rng(1)
    x = rng.integers(-most, most, (3000, 8))
    ids = rng.permutation(3000)
    s = searched(ids, x, ids[:30], x[:30], 7, 300)
    for i in range(30):
        assert [(-int(v), int(r)) for v, r in zip(s.best.scores[i], s.best.ids[i])] == best(ids, x, ids[i], x[i], 7)


def test_lists_are_read_in_part():
    """Few components, and vectors unlike in length: most blocks end early, some unread."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20000, 4)) * rng.exponential(size=(20000, 1)) * 100
    x = np.floor(x[np.argsort(-(x * x).sum(axis=1))]).astype(np.int64)
    ids = np.arange(20000)
    at = rng.choice(20000, 50, replace=False)
    s = searched(ids, x, ids[at], x[at], 10, 1000)
    for i, row in enumerate(at):
        assert [(-int(v), int(r)) for v, r in zip(s.best.scores[i], s.best.ids[i])] == best(ids, x, row, x[row], 10)
    assert s.read < 0.2 * s.entries and s.early > 0.9 * s.blocks


def test_whole_tables(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)]
    rows += [(400, None), (401, [float("nan")] * 6), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (403, []), (None, [1.0] * 6), (404, [2.0]), (420, [3.0]), (5, [9.0] * 6), (40, [-9.0] * 6)]
    raw = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, rank int, v string")
    v = topk.integer_vectors(raw).cache()
    assert v.count() == 404
    use = [(i, [int(64 * c) for c in e]) for i, e in rows if i is not None and e and None not in e and np.isfinite(e).all()]
    got = topk.top_k(v, v.filter("vec_id % 20 = 0"), 7, part_rows=90, block_rows=25, query_rows=6).collect()
    for q in {i for i, _ in use if i % 20 == 0}:
        want = sorted((-sum(a * b for a, b in zip(e, x)), j) for i, e in use if i == q for j, x in use if j != q and len(x) == len(e))[:7]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [(-r.score, r.vec_id) for r in mine] == want and [r.rank for r in mine] == list(range(1, len(want) + 1)), q
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0
