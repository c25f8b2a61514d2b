import random
from difflib import SequenceMatcher

import numpy as np

from claimgraph.functions import ratios
from claimgraph.operators import evidence, matching

FACTS = [
    (1, "Kestrel Harbour Limited", "U10203MH1998PLC004455", "dock_length"),
    (2, "Kestrel Harbour Ltd.", None, "crew_size"),
    (3, "Plover Mills Limited", None, "spindle_count"),
    (4, "Bureau of Tides", "TIDE77", "spring_range"),
    (5, "Unrelated Works", None, "dock_length_planned"),
    (6, "Kestrel Harbour", "L10203MH1998PLC004455", "berth_fees"),
]


def test_candidates(spark):
    f = spark.createDataFrame(FACTS, "id long, entity_name string, entity_id string, attribute string")
    got = {(r.old_id, r.criterion) for r in matching.candidates(f.filter("id = 1"), f).collect()}
    assert got == {(2, 3), (5, 2), (6, 1)}


def test_fuzzy_names_lose_none(spark):
    names = ["acme", "acmee", "amce", "ab", "ba", "abc", "plover", "ploverr", "tide", "diet", "x", "x y"]
    f = spark.createDataFrame([(i, n, None, "") for i, n in enumerate(names)], "id long, entity_name string, entity_id string, attribute string")
    p = matching.prepared(f)
    got = {(r.a, r.b) for r in matching.similar_names(p, p).collect()}
    assert got == {(a, b) for a in names for b in names if SequenceMatcher(None, a, b).ratio() >= 0.8}


def test_fuzzy_names_of_all_kinds(spark):
    """Random names and names with some characters changed, frequent pairs and repeats too."""
    rng = random.Random(9)
    names = {"".join(rng.choices("ab c", k=rng.randint(1, 14))).strip() for _ in range(150)} | {f"works number {k:05}" for k in range(40)}
    for n in list(names):
        for _ in range(2):
            k = rng.randrange(len(n) + 1)
            names.add((n[:k] + rng.choice(["", "x", "ab"]) + n[k + rng.randint(0, 1) :]).strip())
    names = sorted(n for n in names if n)
    p = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.a, r.b) for r in matching.similar_names(p, p).collect()}
    assert got == {(a, b) for a in names for b in names if SequenceMatcher(None, a, b).ratio() >= 0.8}


def test_links_of_all_criteria_against_pairs(spark):
    """Every pair of facts that any criterion joins is linked by its classes, and none else."""
    rng = random.Random(2)
    words = ["north", "south", "mill", "dock", "pier", "works"]
    rows = [(i, " ".join(rng.choices(words, k=2)), rng.choice([None, "a1", "A2 "]), "_".join(rng.choices(words, k=2))) for i in range(40)]
    f = spark.createDataFrame(rows, "id long, entity_name string, entity_id string, attribute string")
    links = {tuple(r)[:3] for r in matching.candidate_links(f, f).collect()}
    classes = lambda r: ((r[2] or "").strip().upper() or None, " ".join(sorted(set(r[3].split("_")))), r[1])
    want = set()
    for x in rows:
        for y in rows:
            a, b = classes(x), classes(y)
            want |= {(1, a[0], b[0])} if a[0] and a[0] == b[0] else set()
            want |= {(2, a[1], b[1])} if set(a[1].split()) & set(b[1].split()) else set()
            want |= {(3, a[2], b[2])} if SequenceMatcher(None, a[2], b[2]).ratio() >= 0.8 else set()
    assert links == want


def test_evidence(spark):
    pages = spark.createDataFrame([(1, 5, "alpha beta\ngamma a \\E(b"), (1, 6, "beta gamma")], "key long, page_number int, text string")
    quotes = spark.createDataFrame([(1, 1, "beta gamma"), (2, 1, "alpha  beta"), (3, 1, "nowhere"), (4, 1, "a  \\E(b"), (5, 1, "a \\E(c"), (6, 1, "")], "quote_id long, key long, quote string")
    assert {tuple(r) for r in evidence.locate(quotes, pages).collect()} == {(1, 6, 0), (2, 5, 0), (3, 5, -1), (4, 5, 17), (5, 5, -1), (6, 5, -1)}


def test_facts_are_sought_in_their_sections(spark):
    sections = [(1, 0, "One", 0), (1, 1, "Two", 0), (1, 2, "Two", 0), (1, 3, "Three", 1), (1, 4, "Two", 1)]
    texts = {0: ["zero", "the quote"], 1: ["the  quote"], 2: ["no", "the quote"], 3: ["x the quote"], 4: ["last"]}
    pages = [(1, s, k, 10 * s + k, t) for s, parts in texts.items() for k, t in enumerate(parts)]
    facts = [(1, 1, 0, "One", "the quote"), (2, 1, 0, "Two", "the quote"), (3, 1, 0, None, "the quote"), (4, 1, 0, "Three", "no"), (5, 1, 1, "Two", "the quote"), (6, 1, 1, "Nine", "the quote")]
    found = evidence.locate_facts(
        spark.createDataFrame(facts, "fact_id long, doc long, batch int, section_path string, quote string"),
        spark.createDataFrame(sections, "doc long, section_no int, section_path string, batch int"),
        spark.createDataFrame(pages, "doc long, section_no int, page_no int, page_number int, text string"),
    )
    # the last "Two" is in batch 1: for batch 0 that name leads to all its sections
    assert {tuple(r) for r in found.collect()} == {(1, "One", 1, 4 - 4), (2, "One", 1, 0), (3, "One", 1, 0), (4, "Two", 20, 0), (5, "Two", 40, -1), (6, "Three", 30, 2)}


def test_links_of_names_against_all_pairs(spark, monkeypatch):
    """A row for each fact, its links counted over small blocks; no link is lost, equal names hang together."""
    monkeypatch.setattr(matching, "BLOCK", 16)
    rng = random.Random(4)
    names = [f"works number {k:05}" for k in range(60)] + ["".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(60)] + ["", "z" * 205, "z" * 204 + "y", "alone here"]
    rows = [(k, n) for k, n in enumerate(names)]
    got = {r.id: r for r in matching.name_links(spark.createDataFrame(rows, "id long, name string")).collect()}
    distinct = {n for n in names if n}
    links = {n: {m for m in distinct if m != n and SequenceMatcher(None, n, m).ratio() >= 0.8} for n in distinct}
    smallest = {n: min(k for k, m in rows if m == n) for n in distinct}
    for _ in distinct:
        for n in distinct:
            for m in links[n]:
                smallest[n] = smallest[m] = min(smallest[n], smallest[m])
    assert len(got) == len(rows)
    for k, n in rows:
        assert (got[k].name, got[k].n_links, got[k].component_id) == (n, len(links.get(n, ())), smallest.get(n, k))


def test_ratios_at_once_equal_difflib_s():
    """Prefixes that repeat themselves, ties, and long texts, in which difflib leaves out frequent characters."""
    rng = random.Random(6)
    for k in range(24):
        begin, letters = ["", "supplier 0000", "aaaaa", "abab"][k % 4], ["ab", "ab c", "0123456789", "é漢ab"][k // 4 % 4]
        a = sorted({begin + "".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(40)}) + (["ab" * 108] if k < 3 else [])
        b = a[:10] + [(n[:p] + rng.choice(["", "a", "ab"]) + n[p + 1 :]) or "a" for n in a for p in [rng.randrange(len(n) + 1)]]
        want = {(x, y): r for x, n in enumerate(a) for y, m in enumerate(b) if (r := SequenceMatcher(None, n, m).ratio()) >= 0.8}
        for whole in (True, False):
            found = ratios.alike(a, b, 0.8, lambda part: np.ones((part.stop - part.start, len(b)), bool), whole)
            got = {(x, y): 2.0 * m / (len(a[x]) + len(b[y])) for i, j, n in found for x, y, m in zip(i.tolist(), j.tolist(), n.tolist())}
            assert got.keys() == want.keys() and (not whole or all(abs(got[p] - want[p]) < 1e-12 for p in got))


def test_fuzzy_query_gives_a_row_for_each_supplier(spark):
    """The query gives a row for each supplier, not for each pair of names."""
    from claimgraph.queries import queries

    links = queries()["candidate_join_fuzzy"](spark, "/root/testdata/sf0.01")
    assert links.columns == ["id", "name", "n_links", "component_id"] and links.count() == spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").count()


def test_names_of_large_classes_against_all_pairs(spark, monkeypatch):
    """Names that differ in their last characters are counted by patterns, others and those of two classes in
    pairs: as all pairs give it. A class that does not hang together, and one whose beginning repeats itself, go in pairs."""
    for name, value in (("MANY", 24), ("COUNTED", 16), ("BLOCK", 16), ("PARTS", 3)):
        monkeypatch.setattr(matching, name, value)
    rng = random.Random(8)
    many = lambda begin, letters, n: {begin + "".join(rng.choices(letters, k=6)) for _ in range(n)}
    names = {f"supplier {k:09}" for k in [*range(60), *range(1_000_000, 1_000_030)]} | many("supplier 002", "0123456789", 30) | many("aaaaaaaaaaaa", "ab", 30) | many("begins so", "abcdefghij", 30) | {"supplier", "alone here"}
    rows = [(k, n) for k, n in enumerate(sorted(names, key=lambda n: n[::-1]))]
    facts = spark.createDataFrame(rows, "id long, name string")
    classes = {r["class"] for r in matching._classes(facts.withColumnRenamed("id", "node")).select("class").distinct().collect()}
    assert classes == {"18:supplier 000", "18:supplier 001"}
    got = {r.id: r for r in matching.name_links(facts).collect()}
    links = {n: {m for m in names if m != n and SequenceMatcher(None, n, m).ratio() >= 0.8} for n in names}
    smallest = {n: k for k, n in rows}
    for _ in range(9):
        for n in names:
            for m in links[n]:
                smallest[n] = smallest[m] = min(smallest[n], smallest[m])
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == {k: (len(links[n]), smallest[n]) for k, n in rows}


def test_alike_names_are_counted_without_pairs():
    """Some of 300,000 names, by every 97th against difflib, and against all of them."""
    names = [f"supplier {k:09}" for k in range(300_000)]
    need = ratios.needed_behind(names[:1000], 0.8, 6)
    assert set(need) == {3}
    for n in (names[0], names[123456], names[299999]):
        part = names[::97]
        found = ratios.Alike(6, 3).counts([n[12:]], "".join(m[12:] for m in part))
        assert found.tolist() == [sum(SequenceMatcher(None, n, m).ratio() >= 0.8 for m in part)]
    assert ratios.Alike(6, 3).counts([n[12:] for n in names[:5]], "".join(m[12:] for m in names)).min() > 5_000
