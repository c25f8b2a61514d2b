import random
import re

import pytest

from claimgraph.operators import passages


def plain(quote, pages):
    """By trying every page: (page, offset, way)."""
    for number, text in sorted(pages):
        if text and quote.strip() and quote in text:
            return number, text.index(quote), "exact"
    words = quote.split()
    for number, text in sorted(pages):
        if words and text and (m := re.search(r"\s+".join(map(re.escape, words)), text)):
            return number, m.start(), "loose"
    return min(pages)[0], -1, "degraded"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = ["revenue", "of", "the", "Rs.", "1,234.5", "crore", "é", "漢字かな", "a", "EBITDA(x)", "🎉", "was", "\\Q", "zz" * 9]
    pages = {key: [(n, rng.choice(["", " "]) + "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t ", " "]) for _ in range(rng.randint(0, 120)))) for n in range(rng.randint(1, 6))] for key in range(12)}
    pages[0][0] = (0, None)
    pages[12] = [(3, "a" * 400 + " b"), (4, "a" * 100)]
    quotes = []
    for key, held in pages.items():
        for _ in range(25):
            text = rng.choice(held)[1] or "nothing here"
            at = rng.randrange(len(text) or 1)
            q = text[at : at + rng.choice([1, 2, 5, 14, 25, 60, 300])]
            q = rng.choice([q, q, q.replace(" ", "\n "), " ".join(q.split()), q + "!", q[:-1]])
            quotes.append((len(quotes), key, q))
    return pages, quotes + [(len(quotes), 1, ""), (len(quotes) + 1, 1, None), (len(quotes) + 2, 99, "no such key")]


def test_locate_equals_a_search_of_every_page(spark, corpus):
    pages, quotes = corpus
    p = spark.createDataFrame([(k, n, t) for k, held in pages.items() for n, t in held], "key int, page_number int, text string")
    q = spark.createDataFrame(quotes, "quote_id int, key int, quote string")
    got = {r.quote_id: (r.page_number, r.char_offset, r.way) for r in passages.locate(q, p).collect()}
    want = {i: plain(q or "", pages[k]) for i, k, q in quotes if k in pages}
    assert got == want
    assert {w for _, _, w in want.values()} == {"exact", "loose", "degraded"}
    kept = {0: passages.index(p, 0)}
    assert {r.quote_id: (r.page_number, r.char_offset, r.way) for r in passages.locate(q, p, kept).collect()} == want


def test_hits_are_all_places(spark, corpus):
    pages, quotes = corpus
    p = spark.createDataFrame([(k, n, t) for k, held in pages.items() for n, t in held], "key int, page_number int, text string")
    q = spark.createDataFrame([x for x in quotes if x[2] and len(x[2]) > 20], "quote_id int, key int, quote string")
    got = {(r.quote_id, r.page_number, r.char_offset) for r in passages.hits(q, p).filter("exact").collect()}
    want = {(i, n, m.start()) for i, k, q in quotes if q and len(q) > 20 and q.strip() for n, t in pages.get(k, []) if t for m in re.finditer(f"(?={re.escape(q)})", t)}
    assert got == want


def test_no_quotes_no_pages_and_the_density_of_the_index(spark):
    p = spark.createDataFrame([(1, 1, " ".join(f"word{k * k}" for k in range(4000)))], "key int, page_number int, text string")
    q = spark.createDataFrame([], "quote_id int, key int, quote string")
    assert passages.locate(q, p).count() == passages.hits(q, p).count() == passages.locate(q, p.limit(0)).count() == 0
    letters = sum(len(f"word{k * k}") for k in range(4000))
    assert 0.1 < passages.index(p).count() / letters < 0.2


def test_a_frequent_gram_is_not_met(spark):
    """Boiler-plate of every page is passed over for the one word that only some have."""
    plate = "the company has prepared its financial statements on a going concern basis "
    p = spark.createDataFrame([(1, n, plate * 3 + (f"number{n}of the kind" if n % 40 == 0 else "")) for n in range(400)], "key int, page_number int, text string")
    q = spark.createDataFrame([(1, 1, "going concern basis number80of the kind")], "quote_id int, key int, quote string")
    got = passages.hits(q, p).collect()
    assert [(r.page_number, r.exact) for r in got] == [(80, True)]
    assert passages.locate(q, p).first().char_offset == 3 * len(plate) - len("going concern basis ")
