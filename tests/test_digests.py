import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from claimgraph.functions import clients
from claimgraph.operators import digests, matching, order, packing


def packed(new, old, budget):
    """Chunks of (is_new, ord) of one document, by plain loops."""
    base = sum(s for _, s in new) + 2 * max(len(new), 1)
    fixed = [(True, o) for o, _ in new] if base < budget else []
    if fixed or not new:
        moving = [(False, o, s) for o, s in old]
    else:
        base, moving = 0, []
        for k in range(max(len(new), len(old))):
            moving += [(True, *new[k])] if k < len(new) else []
            moving += [(False, *old[k])] if k < len(old) else []
    out, used, held = [[]], base, 0
    for side, o, s in moving:
        if held and used + s > budget:
            out.append([])
            used, held = base, 0
        out[-1].append((side, o))
        used, held = used + s, held + 1
    return [sorted(fixed + c) for c in out]


def test_chunks(spark):
    docs = {
        1: ([(0, 10), (2, 20)], [(1, 40), (3, 50), (5, 30), (7, 90)]),
        2: ([(0, 80), (1, 70), (2, 5)], [(3, 60)]),
        3: ([(0, 10), (1, 10)], []),
        4: ([(0, 10)], []),
        5: ([(0, 30), (1, 30)], [(2, 500), (3, 1)]),
    }
    rows = [(d, side, o, s) for d, sides in docs.items() for side, part in zip((True, False), sides) for o, s in part]
    got = defaultdict(list)
    for r in digests.chunks(spark.createDataFrame(rows, "doc_id long, is_new boolean, ord long, size long"), budget=100).collect():
        got[r.doc_id, r.chunk].append((r.is_new, r.ord))
    want = {(d, k): c for d, (new, old) in docs.items() for k, c in enumerate(packed(new, old, 100)) if len(c) > 1}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_json_text(spark):
    scope = {"label": 'é"\n', "end": None}
    texts = ["", "plain ~!", 'q"uo\\te', "tab\t\r\n\b\f\x00\x1f\x7f", "é漢🎉\u2028", "\\u0041", None, "line\n"]
    numbers = [0.0, 1.0, -0.5, 0.1, 1e-4, 1.5e-5, -2e-7, 123456.789, 1e7, 12345678.9, 9.999e15, 1e16, -1.5e22, 2.5e-300, 1.7976931348623157e308, 0.001, 100.0, None]
    rows = [(i, t, numbers[i % len(numbers)], None if i % 3 else scope, [i, None], i % 2 == 0) for i in range(len(numbers)) for t in [texts[i % len(texts)]]]
    df = spark.createDataFrame(rows, "id long, text string, n double, scope struct<label: string, end: string>, some array<int>, yes boolean")
    names = ["id", "text", "n", "scope", "some", "yes"]
    for r in digests.with_json(df, names).collect():
        made = dict(zip(names, rows[r.id]))
        assert r.json == json.dumps(made)


def test_candidate_links_hold_all_candidates(spark):
    rows = [(1, "Acme Ltd", "a1", "total revenue"), (2, "Acme Limited", None, "revenue"), (3, "Zed", "A1", "head count"), (4, "Other", None, "of the"), (5, "Acmee", None, None)]
    f = spark.createDataFrame(rows, "id long, entity_name string, entity_id string, attribute string")
    links = {tuple(r)[:3] for r in matching.candidate_links(f, f).collect()}
    p = {r.id: r for r in matching.prepared(f).collect()}
    by_class = lambda r: (r.key, " ".join(sorted(r.tokens or [])), r.name)
    linked = {(a, b) for a in p for b in p if a != b and any((k, x, y) in links for k, (x, y) in enumerate(zip(by_class(p[a]), by_class(p[b])), 1))}
    assert linked == {(r.new_id, r.old_id) for r in matching.candidates(f, f).collect()} and len(linked) > 3


def plain_batches(sizes, budget, base, counted):
    """The fold, item by item."""
    batch, used, n, out = 0, base, 0, []
    for size in sizes:
        if (n if counted else used > 0) and used + size > budget:
            batch, used, n = batch + 1, base, 0
        used, n = used + size, n + 1
        out.append(batch)
    return out


def test_next_fit(spark):
    rng = random.Random(1)
    rows = [(k if k else None, i, rng.choice([0, 3, 7, 12, None])) for k in range(20) for i in range(rng.randint(1, 40))]
    got = {(r.k, r.i): r.batch for r in packing.next_fit(spark.createDataFrame(rows, "k long, i long, n long"), "k", "i", "n", 12).collect()}
    for key in [None, *range(1, 20)]:
        own = [r for r in rows if r[0] == key]
        assert [got[key, i] for _, i, _ in own] == plain_batches([n or 0 for _, _, n in own], 12, 0, False)


@pytest.mark.parametrize("counted", [False, True])
@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_fold_over_blocks(spark, counted, block):
    """Blocks of any size give what one fold gives; orders have gaps, items may outgrow the budget."""
    rng = random.Random(block)
    rows = []
    for k in range(30):
        base, places = (rng.choice([0, 4, 11, 12, 30]) if counted else 0), sorted(rng.sample(range(300), rng.randint(1, 90)))
        sizes = rng.choice([[0, 1, 2, 3], [0, 0, 0, 5, 13], [12, 13, 40], [1, 6, 11]])
        rows += [(f"k{k}", p, rng.choice(sizes), base, f"r{p}") for p in places]
    df = spark.createDataFrame(rows, "k string, o int, size long, base long, rest string")
    got = {(r.k, r.o): (r.batch, r.rest) for r in packing.fold(df, "k", "o", 12, counted, block).collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        assert [got[k, r[1]] for r in own] == [(b, r[4]) for b, r in zip(plain_batches([r[2] for r in own], 12, own[0][3], counted), own)]
    assert packing.fold(df.limit(0), "k", "o", 12, counted, block).count() == 0


def test_a_key_of_a_million_items_lies_in_many_tasks(spark):
    size = F.when(F.col("id") % 97 == 0, 900).otherwise((F.col("id") * 2654435761) % 61)
    items = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("o"), size.alias("n"))
    out = packing.next_fit(items, "k", "o", "n", 1000).withColumn("task", F.spark_partition_id()).toPandas().sort_values("o")
    sizes = [900 if i % 97 == 0 else (i * 2654435761) % 61 for i in range(1_000_000)]
    assert out.batch.tolist() == plain_batches(sizes, 1000, 0, False) and out.task.nunique() >= 3


def test_order(spark):
    rng = random.Random(3)
    rows = [(g, k) for g in "ab" for k in rng.sample(range(0, 10**12, 7), 60)]
    df = spark.createDataFrame(rows, "g string, k long")
    numbered = order.row_numbers(df, "k", "no", ["g"], width=1 << 30)
    after = {(r.g, r.k): r.next.k if r.next else None for r in order.next_rows(df, "k", ["k"], ["k"], ["g"], width=1 << 38).collect()}
    for r in numbered.collect():
        own = sorted(k for g, k in rows if g == r.g)
        assert own[r.no - 1] == r.k and after[r.g, r.k] == (own[r.no] if r.no < len(own) else None)


def test_calls(spark):
    tried = [("a", 1, False), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, False), ("c", 9, True)] + [("d", k, k == 8) for k in range(9)]
    got = {tuple(r) for r in clients.calls(spark.createDataFrame(tried, "k string, n int, ok boolean"), "k", "n", "ok").collect()}
    assert got == {("a", 3, 3, 3, False), ("a", 4, 1, 0, False), ("b", 1, 1, 0, True), ("c", 9, 1, 0, False), ("d", 8, 9, 121, True)}


@pytest.mark.parametrize("small", [0, 5, 256])
def test_chunks_of_small_and_large_documents(spark, monkeypatch, small):
    """A row or blocks a document: the same chunks, places and columns that pass."""
    monkeypatch.setattr(digests, "SMALL", small)
    rng = random.Random(12)
    docs = {}
    for d in range(60):
        sides = [[(o, rng.choice([0, 3, 9, 40, 120])) for o in sorted(rng.sample(range(90), rng.randint(0, 6)))] for _ in "ab"]
        docs[d] = sides if any(sides) else [[(1, 1)], []]
    rows = [(d, side, o, s, f"{d}/{o}") for d, sides in docs.items() for side, part in zip((True, False), sides) for o, s in part]
    got = defaultdict(list)
    for r in digests.chunks(spark.createDataFrame(rows, "doc_id long, is_new boolean, ord long, size long, name string"), budget=100, take=["name"]).collect():
        assert r.name == f"{r.doc_id}/{r.ord}"
        got[r.doc_id, r.chunk].append((r.place, r.is_new, r.ord))
    want = {(d, k): c for d, (new, old) in docs.items() for k, c in enumerate(packed(new, old, 100)) if len(c) > 1}
    assert {k: sorted(x[1:] for x in v) for k, v in got.items()} == want
    for d, k in got:
        _, sides, ords = zip(*sorted(got[d, k]))
        new = [o for s, o in zip(sides, ords) if s]
        assert new == sorted(new) and len(set(got[d, k])) == len(got[d, k])


def test_small_documents_need_one_shuffle_and_no_python(spark):
    from claimgraph.queries import queries

    run = queries()["digest_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    plan = run.executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" not in plan
    # the rows are made once: a filter by their number would make them again
    assert run.optimizedPlan().toString().count("zip_with(") == 1
