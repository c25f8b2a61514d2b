"""The secret scan against plain loops over the texts."""

import random
import re
import time

from claimgraph.llm import secrets


def spans_of(text):
    """(base, wide) spans (start, kind_no, end, value) of one text."""
    base = [(m.start(), 0, m.end(), m[2]) for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    wide = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{24,}", text) if all(re.search(x, m[0]) for x in ("[a-z]", "[A-Z]", "[0-9]"))]
    return sorted(base), [w for w in wide if not any(b[0] < w[2] and w[0] < b[2] for b in base)]


def test_random_texts(spark):
    rng = random.Random(6)
    parts = ["password", "Token", "api_key", "=", ": ", '"', " ", "\n", "é", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "aB3xY9", "aB3" * 9, "abc.def", "-", "_", "zZ9" * 10]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 40))), f"s{i % 3}") for i in range(300)]
    rows += [(300, None, None), (301, "", "s1"), (302, rows[7][1], "s2"), (7, rows[7][1], rows[7][2]), (None, "aB3" * 12, None), (None, "cD4" * 12, None)]
    got = secrets.scan(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, spans string, row int")).collect()
    found = [(i, s, *spans_of(t or "")) for i, t, s in rows]
    owners, documents = {}, {}
    for i, s, base, wide in found:
        for x in base + wide:
            owners.setdefault(x[3], set()).add(s)
            documents.setdefault(x[3], set()).add(i)
    live = {v for v in owners if len(owners[v]) <= 1 and len(documents[v]) <= 10}
    plain = lambda spans: tuple((x.start, x.kind_no, x.end, x.value) for x in spans)
    want = [(i, tuple(base), tuple(sorted(base + [w for w in wide if w[3] in live])), sum(x[3] in live for x in base + wide), sum(x[3] not in live for x in base + wide)) for i, s, base, wide in found]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted([(r.doc_id, plain(r.base), plain(r.spans), r.n_live, r.n_copied) for r in got], key=key) == sorted(want, key=key)
    assert sum(len(w[2]) - len(w[1]) for w in want) > 20


def test_time_goes_with_the_matches(spark):
    """Eight times the matches in one text take ten times as long at most."""
    def seconds(n):
        text = " ".join(f"token=k{i:07d}x aB3{i:07d}zzzzzzzzzzzzzzzzzzzz" for i in range(n // 2))
        d = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string").cache()
        d.count()
        began = time.time()
        row = secrets.scan(d).first()
        assert len(row.base) == n // 2 and len(row.spans) == n
        return time.time() - began

    seconds(400)
    assert seconds(32_000) < 10 * seconds(4000)
