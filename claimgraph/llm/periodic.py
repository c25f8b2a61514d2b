"""Periodic runs of words: stretches that repeat with some period three times or more.

Per scale t = 4, 8, 16, ... a string synchronising set holds the positions whose t words have the
smallest hash of the t + 1 windows that begin there and after: equal surroundings choose equal
positions. Equal contexts of 2t words at such positions, at a distance from 1.5t to 3t, propose a
period, and words are compared to extend it. Windows of a period of at most t/3 choose nothing;
they lie in runs of smaller periods, which lower scales have found, and periods under 6 come from
where words equal those 1 to 5 before.

Texts of a batch lie behind each other, the longest first, so that higher scales read a shorter
beginning. A distance's candidates that touch are one. All work is linear in the words of a batch
a scale; memory is some 80 bytes a word of the longest text or batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm.bpe import _with_parts
from claimgraph.llm.common import no_clash, small_batches, table

#: A run has this many words and periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
WORD = r"[^\x20\x09-\x0D]+"
_FIRST_SCALE = 4
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(32))) * _ODD[2]
    return a ^ (a >> np.uint64(29))


def _smallest_period_of_scale(t: int) -> int:
    """A run of this period or more has room for a chosen position whose context stands once more a period on."""
    return (3 * t - 1) // 2 + (3 * t - 1) % 2


def _extents(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many values the two have in common from their beginnings."""
    done, step, most = 0, 64, min(len(a), len(b))
    while done < most:
        differ = np.flatnonzero(a[done : done + step] != b[done : done + step]) if done + step <= most else np.flatnonzero(a[done:most] != b[done:most])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 2
    return most


def _synchronising(h: np.ndarray, t: int, quiet: np.ndarray) -> np.ndarray:
    """Positions i such that of the windows of t words that begin from i to i + t the first or the last has the smallest hash. quiet windows have none."""
    if len(h) <= t:
        return np.zeros(0, np.int64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.where(quiet, none, h)
    low, width = h, 1
    while width < t:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(h) - t], h[t:])
    return np.flatnonzero((low != none) & ((low == h[: len(h) - t]) | (low == h[t:])))


def _proposed(h: np.ndarray, t: int, chosen: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(begin, end, period): words from begin to end equal those a period later, as far as contexts tell."""
    chosen = chosen[chosen + t < len(h)]
    context = _mixed(h[chosen] * _ODD[0] + h[chosen + t] * _ODD[1])
    by = np.argsort(context, kind="stable")
    context, at = context[by], chosen[by]
    starts, periods, k = [], [], 1
    while k < len(at):
        near = (context[k:] == context[:-k]) & (at[k:] - at[:-k] < hi)
        if not near.any():  # contexts of no small period stand over t/3 apart, so this ends
            break
        near &= at[k:] - at[:-k] >= lo
        starts.append(at[:-k][near])
        periods.append((at[k:] - at[:-k])[near])
        k += 1
    if not sum(map(len, starts)):
        return []
    start, period = np.concatenate(starts), np.concatenate(periods)
    by = np.lexsort((start, period))
    start, period = start[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] > start[:-1] + 2 * t)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return list(zip(start[first].tolist(), (start[last] + 2 * t).tolist(), period[first].tolist()))


def runs_of(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All runs of three periods or more in texts that lie behind each other in words, each
    followed by one number that stands nowhere else; lengths (with that one) fall. Rows of
    (start, end, period), of the smallest period, sorted."""
    n = len(words)
    found: dict[tuple[int, int], int] = {}
    for p in range(1, _smallest_period_of_scale(_FIRST_SCALE)):
        begin, end = _extents(words[p:] == words[:-p]) if n > p else (np.zeros(0, int),) * 2
        long = end - begin >= (LEAST_PERIODS - 1) * p
        for a, b in zip(begin[long].tolist(), (end[long] + p).tolist()):
            found.setdefault((a, b), p)
    ends = np.cumsum(lengths)
    h = _mixed(words.astype(np.uint64) * _ODD[0] + np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths) * _ODD[1])
    width, t = 1, _FIRST_SCALE
    while True:
        lo, hi = _smallest_period_of_scale(t), _smallest_period_of_scale(2 * t)
        # texts too short for a run of this scale end the sequence
        n = int(ends[np.count_nonzero(lengths > LEAST_PERIODS * lo) - 1]) if (lengths > LEAST_PERIODS * lo).any() else 0
        if not n:
            break
        h = h[:n]
        while width < t:
            h = _mixed(h[:-width] * _ODD[0] + h[width:] * _ODD[1])
            width *= 2
        quiet = np.zeros(len(h) + 1, np.int32)
        for (a, b), p in found.items():
            if 3 * p <= t <= b - a and a < len(h):
                quiet[a] += 1
                quiet[min(b - t + 1, len(h))] -= 1
        chosen = _synchronising(h, t, np.cumsum(quiet[:-1]) > 0)
        covered: dict[int, int] = {}
        for a, b, p in sorted(_proposed(h, t, chosen, lo, hi), key=lambda x: x[2]):
            if b <= covered.get(p, 0):
                continue
            forth = a + _reach(words[a : n - p], words[a + p : n])
            back = a - _reach(words[:a][::-1], words[p : a + p][::-1])
            covered[p] = forth
            if forth - back >= (LEAST_PERIODS - 1) * p:
                found.setdefault((back, forth + p), p)
        t *= 2
    out = np.array([(a, b, p) for (a, b), p in found.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words, their numbers, and each text's count of words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words, counts = parts.flatten(), pc.list_value_length(parts).to_numpy()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not real.all():
        rows = np.repeat(np.arange(len(texts)), counts)[real]
        words, counts = words.filter(pa.array(real)), np.bincount(rows, minlength=len(texts))
    return words, words.dictionary_encode().indices.to_numpy().astype(np.int64), counts.astype(np.int64)


def _found(texts: pa.Array) -> tuple[pa.Array, list[list[tuple[int, int, int]]], list[bool]]:
    """Texts without the repeats of their runs, and the runs (start, length, period) of each."""
    words, ids, counts = _numbered(texts)
    n_texts, begins = len(counts), np.cumsum(counts) - counts
    by = np.argsort(-counts, kind="stable")
    lengths = counts[by] + 1
    places = np.cumsum(lengths) - lengths  # where each text of that order begins
    sequence = np.empty(int(lengths.sum()), np.int64)
    sequence[places + lengths - 1] = -1 - np.arange(n_texts)
    word_at = np.ones(len(sequence), bool)
    word_at[places + lengths - 1] = False
    rank = np.empty(n_texts, np.int64)
    rank[by] = np.arange(n_texts)
    source = np.repeat(begins[by], counts[by]) + np.arange(len(ids)) - np.repeat(np.cumsum(counts[by]) - counts[by], counts[by])
    sequence[word_at] = ids[source]
    each: list[list[tuple[int, int, int]]] = [[] for _ in range(n_texts)]
    dropped = np.zeros(len(ids) + 1, np.int32)
    for a, b, p in runs_of(sequence, lengths).tolist():
        if b - a < LEAST_WORDS:
            continue
        r = int(np.searchsorted(places, a, side="right")) - 1
        text = int(by[r])
        start = a - int(places[r])
        each[text].append((start, b - a, p))
        dropped[begins[text] + start + p] += 1
        dropped[begins[text] + start + b - a] -= 1
    keep = np.cumsum(dropped[:-1]) == 0
    left = np.concatenate(([0], np.cumsum(keep)))[np.append(begins, len(ids))]
    kept = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.filter(pa.array(keep)))
    return pc.binary_join(kept, pa.scalar(" ", pa.large_string())), each


def runs(docs: DataFrame) -> DataFrame:
    """Adds runs array<struct<start, length, period>> and collapsed, the words of text that no
    run holds after its first period, joined by spaces. Words are what stands between
    ASCII white space, numbered from 0; runs go by start, then period, and have 24 words and
    three periods or more.

    Null and empty texts have no words. Each row stands for itself, so repeated rows, null ids
    and extra columns pass; columns named as the added ones are replaced. A text is one row's,
    and lies in one task whole."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>")
    def parts(texts: pa.Array) -> pa.Array:
        collapsed, each = _found(texts)
        flat = np.array([r for rows in each for r in rows], np.int64).reshape(-1, 3)
        fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
        ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), fields), collapsed.cast(pa.string())], names=["runs", "collapsed"])

    return _with_parts(no_clash(docs, "runs", "collapsed"), parts(F.col("text").cast("string")))


def collapse(docs: DataFrame) -> DataFrame:
    """docs with collapsed texts in text's place where a run was found; other texts stay byte by byte."""
    found = runs(docs)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("text").cast("string"))
    return found.withColumn("text", text).select(*[f"`{c}`" for c in docs.columns])


def strongest(found: Column) -> Column:
    """Of runs the one of the greatest length over period, exactly; ties go to the smallest start, then period."""
    before = lambda x, y: x.length * y.period - y.length * x.period
    better = lambda x, y: (before(x, y) > 0) | ((before(x, y) == 0) & (F.struct(x.start, x.period) < F.struct(y.start, y.period)))
    return F.aggregate(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), F.get(found, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """The contract's texts: where crc32(doc_id) ends in 0, words from a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0))
    chosen = docs.withColumn("words", F.when(h % 10 == 0, words)).withColumn("n", F.size("words"))
    g = F.floor(h / 10)
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, (g % F.col("n")).cast("int")))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))
    chosen = chosen.withColumn("p", p.cast("int"))
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.get(F.col("words"), F.col("a") + i % F.col("p")))
    made = F.array_join(F.concat(F.slice("words", 1, F.col("a")), tail), " ")
    return chosen.withColumn("text", F.when(F.col("n") > 0, made).otherwise(F.col("text"))).drop("words", "n", "a", "p")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable] = {"op13_periodic_runs": op13_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
