"""Quotes in pages by a positional index of character grams.

White space aside, a quote that stands in a page stands in it letter by letter. Of the letters
of a page those grams are kept that have the smallest hash of some window of neighbouring grams, so
every stretch of enough letters keeps one, and keeps the same ones wherever it stands. A quote
meets the pages through its rarest kept gram, at a known place in each, and is compared there.
Quotes too short for a level's windows use the next level, whose index holds every gram."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of a gram and grams of a window, by level; a quote uses the first level that its letters fill.
LEVELS = [(12, 12), (4, 1), (1, 1)]
_SPACES = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's code points, and the places of those that are no white space."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.flatnonzero(~_SPACES[np.minimum(codes, len(_SPACES) - 1)])


def _kept(letters: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the grams with the smallest hash of a whole window that holds them."""
    n = len(letters) - size + 1
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h + letters[k : k + n].astype(np.uint64) + np.uint64(1)) * _BASE
        h ^= h >> np.uint64(29)
    low = np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1)
    # the largest of the minima of the windows that hold a gram is its own hash if one chose it
    ends = np.pad(low, window - 1)
    most = np.lib.stride_tricks.sliding_window_view(ends, window).max(axis=1)
    at = np.flatnonzero(most == h)
    return h[at], at


def _listed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.cumsum([0, *[len(h) for h, _ in parts]]).astype(np.int32)
    grams = np.concatenate([h for h, _ in parts] or [np.zeros(0, np.uint64)]).view(np.int64)
    places = np.concatenate([p for _, p in parts] or [np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(grams), pa.array(places, pa.int64())], names=["gram", "place"]))


def _grams(column: str, level: int):
    size, window = LEVELS[level]

    @F.arrow_udf("array<struct<gram: bigint, place: bigint>>")
    def grams(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            codes, at = _codes(t or "")
            out.append(_kept(codes[at], size, window))
        return _listed(out)

    return grams(F.col(column))


@F.arrow_udf(T.IntegerType())
def _level(quotes: pa.Array) -> pa.Array:
    letters = [len(_codes(q or "")[1]) for q in quotes.to_pylist()]
    return pa.array([next((k for k, (size, window) in enumerate(LEVELS) if n >= size + window - 1), None) for n in letters], pa.int32())


@F.arrow_udf(T.StructType([T.StructField("at", T.LongType()), T.StructField("exact", T.BooleanType())]))
def _compared(texts: pa.Array, quotes: pa.Array, places: pa.Array, quote_places: pa.Array) -> pa.Array:
    """Where the quote begins, given that a gram of it stands at a place of the text; null if
    letters differ, or white space is missing on one side. exact: with the same white space."""
    at, exact = [], []
    text, codes, letters = None, None, None
    for t, q, place, own in zip(texts.to_pylist(), quotes.to_pylist(), places.to_pylist(), quote_places.to_pylist()):
        if t is not text:
            text, (codes, letters) = t, _codes(t)
        q_codes, q_letters = _codes(q)
        first, n = place - own, len(q_letters)
        mine = letters[first : first + n] if first >= 0 else letters[:0]
        same = len(mine) == n and (codes[mine] == q_codes[q_letters]).all() and ((np.diff(mine) > 1) == (np.diff(q_letters) > 1)).all()
        begin = int(mine[0]) - int(q_letters[0]) if same else -1
        whole = same and begin >= 0 and begin + len(q_codes) <= len(codes) and bool((codes[begin : begin + len(q_codes)] == q_codes).all())
        at.append((begin if whole else int(mine[0])) if same else None)
        exact.append(whole if same else None)
    return pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(exact, pa.bool_())], names=["at", "exact"])


def index(pages: DataFrame, level: int = 0) -> DataFrame:
    """pages(key, page_number, text) -> (key, page_number, gram, place): the kept grams of a
    level. It may be written and read again; of a long page it holds a sixth of the letters
    at level 0. Null texts have none."""
    found = pages.select("key", "page_number", F.explode(_grams("text", level)).alias("g"))
    return found.select("key", "page_number", "g.gram", "g.place")


def hits(quotes: DataFrame, pages: DataFrame, indexes: dict[int, DataFrame] | None = None) -> DataFrame:
    """quotes(quote_id, key, quote) and pages(key, page_number, text) -> every place of every
    quote in the pages of its key: (quote_id, page_number, char_offset, exact).

    Loose hits have other white space where the quote has some. Offsets count code points from
    0. indexes holds written indexes by level; others are made here. A quote of no letters
    stands nowhere. Frequent grams stay out unless a quote has no rarer one."""
    levelled = quotes.select("quote_id", "key", "quote").withColumn("level", _level("quote"))
    used = sorted(r.level for r in levelled.filter("level is not null").select("level").distinct().collect())  # three at most
    out = None
    for level in used:
        held = (indexes or {}).get(level)
        held = index(pages, level) if held is None else held
        own = levelled.filter(F.col("level") == level)
        grams = own.select("quote_id", "key", F.explode(_grams("quote", level)).alias("g")).select("quote_id", "key", "g.gram", F.col("g.place").alias("own_place"))
        counts = held.join(grams.select("key", "gram").distinct(), ["key", "gram"], "left_semi").groupBy("key", "gram").agg(F.count(F.lit(1)).alias("n"))
        # a quote with a gram that no page has stands nowhere
        numbered = grams.join(counts, ["key", "gram"], "left").groupBy("quote_id", "key").agg(F.min_by(F.struct("gram", "own_place", "n"), F.struct(F.coalesce("n", F.lit(0)), "gram", "own_place")).alias("rarest"))
        rarest = numbered.filter("rarest.n is not null").select("quote_id", "key", "rarest.gram", "rarest.own_place")
        met = held.join(rarest, ["key", "gram"]).select("quote_id", "key", "page_number", "place", "own_place")
        full = met.join(own.select("quote_id", "key", "quote"), ["quote_id", "key"]).join(pages.select("key", "page_number", "text"), ["key", "page_number"])
        some = full.select("quote_id", "page_number", _compared("text", "quote", "place", "own_place").alias("c")).filter("c.at is not null")
        some = some.select("quote_id", "page_number", F.col("c.at").alias("char_offset"), "c.exact")
        out = some if out is None else out.unionByName(some)
    if out is None:
        fields = [f"quote_id {quotes.schema['quote_id'].dataType.simpleString()}", f"page_number {pages.schema['page_number'].dataType.simpleString()}"]
        return quotes.sparkSession.createDataFrame([], ", ".join([*fields, "char_offset long", "exact boolean"]))
    return out


def locate(quotes: DataFrame, pages: DataFrame, indexes: dict[int, DataFrame] | None = None) -> DataFrame:
    """quotes(quote_id, key, quote) and pages(key, page_number, text) -> (quote_id,
    page_number, char_offset, way): the first page with an exact hit, else the first with a
    loose one, else (degraded) the first page of the key with offset -1. Quotes of a key
    without pages have no row; quote_id and the pages of a key are unique."""
    place = F.struct("page_number", "char_offset")
    found = hits(quotes, pages, indexes).groupBy("quote_id").agg(F.min(F.when(F.col("exact"), place)).alias("exact"), F.min(place).alias("loose"))
    first = pages.groupBy("key").agg(F.min("page_number").alias("start"))
    each = quotes.select("quote_id", "key").join(first, "key").join(found, "quote_id", "left")
    hit = F.coalesce("exact", "loose", F.struct(F.col("start").alias("page_number"), F.lit(-1).cast("long").alias("char_offset")))
    way = F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "loose").otherwise("degraded")
    return each.select("quote_id", hit.alias("hit"), way.alias("way")).select("quote_id", "hit.page_number", "hit.char_offset", "way")
