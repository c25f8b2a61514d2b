"""Near-duplicate vectors against all cosines."""

import numpy as np
import pytest

from claimgraph.llm import embedding_dedup


def brute(rows):
    """{vec_id: (n_links, component_id)} of rows (vec_id, vector), by all cosines."""
    best = {}
    for i, v in rows:
        good = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if i is not None:
            best[i] = min([x for x in (best.get(i), list(v) if good else None) if x is not None], default=None)
    links = {i: set() for i in best}
    for size in {len(v) for v in best.values() if v}:
        ids = [i for i, v in best.items() if v and len(v) == size]
        m = np.array([best[i] for i in ids])
        m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.95, 1))):
            links[ids[a]].add(ids[b])
            links[ids[b]].add(ids[a])
    up = {}
    for i in sorted(links):
        if i not in up:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in up:
                    up[x] = i
                    todo += links[x]
    return {i: (len(links[i]), up[i]) for i in links}


def check(spark, rows, exact=True, **bounds):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, choice string, n int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df, **bounds).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    if exact:
        assert got == want
    return got, want


@pytest.mark.parametrize("bounds", [{}, {"few_rows": 3, "block_rows": 4}, {"few_rows": 1, "block_rows": 512}])
def test_groups_of_copies(spark, bounds):
    """Links far over the threshold are all found: members, numbers, components, kept."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(size=16) * 0.02).tolist()) for i in range(300)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("inf")] * 16), (403, [1.0]), (404, [3.0]), (405, []), (406, [1.0] * 15 + [None]), (None, [1.0] * 16)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (7, [0.5] * 16), (5, [1.0] * 15 + [None]), (502, [2 * x for x in rows[3][1]])]
    got, _ = check(spark, rows, **bounds)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id for r in embedding_dedup.near_vectors(df).collect() if r.kept} == {i for i, (_, c) in got.items() if i == c}


def test_a_bad_vector_does_not_hide_a_good_one(spark):
    got, _ = check(spark, [(5, [1.0, 2.0]), (5, [None, 9.0]), (20, [1.0, 2.1])])
    assert got == {5: (1, 5), 20: (1, 5)}


def test_recall_at_the_border(spark):
    """Pairs of planted cosines just over the threshold: nine of ten are found, none below."""
    rng = np.random.default_rng(5)
    rows, n = [], 1500
    for k in range(n):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9501, 0.96) if k % 3 else rng.uniform(0.9, 0.9499)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (a * c + b * np.sqrt(1 - c * c)).tolist())]
    got, want = check(spark, rows, exact=False)
    assert all(got[i][0] <= want[i][0] for i in want)
    recall = sum(g[0] for g in got.values()) / sum(w[0] for w in want.values())
    print("recall at 0.95 to 0.96:", round(recall, 4))
    assert recall >= 0.9


def test_no_rows(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sketches_lose_no_link_and_buckets_ignore_the_batch():
    """Pairs at the border pass the bound, in any dimension; unrelated ones mostly do not."""
    rng = np.random.default_rng(5)
    for dim in (2, 7, 16, 64, 300):
        x = embedding_dedup._unit(rng.standard_normal((20000, dim)).tolist())
        away = rng.standard_normal(x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        cosine = rng.uniform(0.95, 0.952, (len(x), 1))
        y = embedding_dedup._unit(cosine * x + np.sqrt(1 - cosine**2) * embedding_dedup._unit(away.tolist()))
        sketch = embedding_dedup._sketches(x)
        assert embedding_dedup._may_link(sketch, embedding_dedup._sketches(y)).all(), dim
        if dim >= 64:
            assert embedding_dedup._may_link(sketch, sketch[::-1]).mean() < 0.01
        h = embedding_dedup._hashes(x[:700])
        assert all((embedding_dedup._hashes(x[k : k + n]) == h[k : k + n]).all() for k, n in ((0, 1), (5, 2), (100, 37), (3, 600)))
