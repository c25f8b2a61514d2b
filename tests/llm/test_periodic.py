import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimgraph.llm import periodic


def plain(words):
    """All runs by definition, from every period."""
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - p:
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j - i >= 2 * p:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items() if b - a >= 24)


def left(words, found):
    drop = {i for start, length, p in found for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def fibonacci(n):
    a, b = ["x"], ["x", "y"]
    while len(b) < n:
        a, b = b, b + a
    return b


def text(rng):
    words = []
    for _ in range(rng.randint(0, 7)):
        letters = rng.choice([1, 2, 3, 50])
        base = [f"w{rng.randrange(letters)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 21, 40, 90]))]
        words += [base[i % len(base)] for i in range(int(len(base) * rng.choice([1, 1, 2, 3, 3.3, 4, 7, 12.5])))]
        if rng.random() < 0.3:
            words = (words * rng.choice([1, 3, 4]))[:2500]
    return rng.choice([" ", "  \n", "\t"]).join(words) + rng.choice(["", " "])


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_those_of_every_period(seed):
    rng = random.Random(seed)
    texts = [text(rng) for _ in range(60)] + [" ".join(fibonacci(1500)), "a " * 800, None, "", " \n "]
    collapsed, each = periodic._found(pa.array(texts, pa.string()))
    assert sum(map(len, each)) > 20
    for t, c, found in zip(texts, collapsed.to_pylist(), each):
        words = re.findall(periodic.WORD, t or "")
        assert found == plain(words)
        assert c == left(words, found)


def test_edges(spark):
    """Null, empty and long texts, repeated rows, clashing columns, an empty table."""
    long_text = " ".join(f"u{k}" for k in range(150_000)) + " end" * 24
    rows = [(1, "a b c " * 9), (1, "a b c " * 9), (None, "a b c " * 7 + "a b c"), (2, None), (3, ""), (4, long_text), (5, "a b c " * 7 + "a b"), (6, "no run\n here")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("runs", "collapsed", "words", "start")})
    got = {(r.doc_id, i): (r.runs, r.collapsed, r.start) for i, r in enumerate(periodic.runs(d).collect())}
    assert got[1, 0] == got[1, 1] == ([(0, 27, 3)], "a b c", "x") and got[None, 2][0] == [(0, 24, 3)]
    assert got[2, 3] == got[3, 4] == ([], "", "x") and got[5, 6][0] == []
    assert got[4, 5][0] == [(150_000, 24, 1)] and got[4, 5][1] == long_text[: -4 * 23]
    assert periodic.runs(d.limit(0)).count() == 0
    shorter = {r.doc_id: r.text for r in periodic.collapse(d).collect()}
    assert shorter[1] == "a b c" and shorter[6] == "no run\n here" and periodic.collapse(d).columns == d.columns


def test_op13_is_the_contract(spark, sf):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = periodic.op13_periodic_runs(spark, sf).collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows)
    for r in rows:
        words = re.findall(periodic.WORD, docs[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if n > 4000:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = plain(words)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in found)) and r.collapsed_sha256 == sha(left(words, found))


def test_planted_texts_without_words_or_id(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    d = spark.createDataFrame([(ids[0], None), (ids[1], "  "), (None, "a b"), (ids[0], "one")], "doc_id long, text string")
    assert [r.text for r in periodic.planted(d).collect()] == [None, "  ", "a b", "one"]
