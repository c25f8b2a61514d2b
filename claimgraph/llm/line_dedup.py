"""Line dedup by pairwise alignment: the blocks of lines that a later document shares with
any earlier one.

A block is a run of consecutive lines of min_chars characters or more in sum that stands in
both documents. Every line of such a block lies in a run within it that cannot lose its
last line (from some start on) or its first line (up to some end) without falling below
min_chars: at most two runs a line. Documents that share a run's hash overlap, and a
document is paired with the first holder of each of its runs, however many hold it: pairs
grow with the shared runs, not with the square of a group.

The shared runs of a pair are aligned by patience diff, and the lines that they cover are
the common blocks. Runs that the alignment passes over stand elsewhere in the earlier
document, or more often than there: they are blocks that moved, and go too unless asked
otherwise. A block's runs all have first holders, so that nothing is lost by one partner a
run: every block that any earlier document holds is covered.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph.llm.common import cut, no_clash, small_batches, table

MIN_CHARS = 30
_BASE = 0x9E3779B97F4A7C15 | 3
_RUN_LINES = 1 << 16  # runs a batch

def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, sorted by their first, that rises in the second too."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before[k] = ends[at - 1] if at else -1
        tops[at : at + 1] = [j]
        ends[at : at + 1] = [k]
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences: equal beginnings and ends, then between the values
    that are unique in both and rise in both, and so on within each gap."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {v: k for k, v in enumerate(b[j:j_end], j) if in_b[v] == 1}
        anchors = _rising([(k, place[v]) for k, v in enumerate(a[i:i_end], i) if in_a[v] == 1 and v in place])
        if anchors:
            out += anchors
            edges = [(i - 1, j - 1), *anchors, (i_end, j_end)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


def runs(text: str, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the runs of lines, end excluded, that have min_chars characters
    or more but not without their last line, or not without their first."""
    lines = [x.strip(" ") for x in text.split("\n")]
    total = np.zeros(len(lines) + 1, np.int64)
    np.cumsum([len(x) for x in lines], out=total[1:])
    ends = np.searchsorted(total, total + min_chars, "left")
    starts = np.searchsorted(total, total - min_chars, "right") - 1
    some, others = np.flatnonzero(ends < len(total)), np.flatnonzero(starts >= 0)
    both = np.unique(np.concatenate([some * len(total) + ends[some], starts[others] * len(total) + others]))
    p, q = both // len(total), both % len(total)
    # wraps at 64 bits; the base is odd, so that its powers have inverses
    power = np.full(len(total), _BASE, np.uint64)
    back = np.full(len(total), pow(_BASE, -1, 1 << 64), np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    sums = np.zeros(len(total), np.uint64)
    h = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in lines], np.uint64)
    np.cumsum(h * power[:-1], out=sums[1:])
    return p, q, ((sums[q] - sums[p]) * back[p]).view(np.int64)


def _runs(min_chars: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, versions, texts = (b.column(c) for c in ("doc_id", "version", "text"))
            rows: list[int] = []
            parts: list[tuple] = []
            held = 0
            for k in range(b.num_rows):
                parts.append(runs(texts[k].as_py(), min_chars))
                rows.append(k)
                held += len(parts[-1][0])
                if held >= _RUN_LINES or k == b.num_rows - 1:
                    of = pa.array(np.repeat(rows, [len(x[0]) for x in parts]), pa.int64())
                    start, end, h = (np.concatenate([x[c] for x in parts]) for c in range(3))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(of), versions.take(of), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(h)], names=["doc_id", "version", "start", "end", "h"]
                    )
                    rows, parts, held = [], [], 0

    return find


def _places(runs: list[tuple[int, int]]) -> list[int]:
    """The places that runs (start, end) cover."""
    at, places = 0, []
    for start, end in sorted(runs):
        places += range(max(at, start), end)
        at = max(at, end)
    return places


def aligned(shared: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The shared runs (start, end, place in the earlier document) of one pair, in order of
    the later one: those that patience diff aligns, and those that moved."""
    keys = [(place, end - start) for start, end, place in shared]
    hit = {i for i, _ in patience(keys, sorted(set(keys)))}
    in_order = [x[:2] for k, x in enumerate(shared) if k in hit]
    return in_order, [x[:2] for k, x in enumerate(shared) if k not in hit]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a document's runs with their first holders: the places of the lines of aligned
    blocks, and of those of moved ones besides."""
    for b in batches:
        removed, moved = [], []
        for found in b.column("found").to_pylist():
            inside: list[tuple[int, int]] = []
            others: list[tuple[int, int]] = []
            rows = sorted((x["first"], x["start"], x["end"], x["place"]) for x in found)
            for _, pair in groupby(rows, key=lambda x: x[0]):
                for kept, new in zip((inside, others), aligned([x[1:] for x in pair])):
                    kept += new
            removed.append(_places(inside))
            own = set(removed[-1])
            moved.append([x for x in _places(others) if x not in own])
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), pa.array(removed, kind), pa.array(moved, kind)], names=["doc_id", "version", "removed", "moved"])


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs(doc_id, version, text) -> (doc_id, version, removed array<int>, moved
    array<int>): places of the lines, counted from 0, in blocks that an earlier document
    holds in the same order, and of those in blocks that it holds elsewhere."""
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", "version", "text").mapInArrow(_runs(max(1, min_chars)), "doc_id long, version long, start int, end int, h long")
    held = found.groupBy("h").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last")).filter("first.doc_id < last")
    # written first: joined from its table, both sides are dealt anew and Spark splits a hot run
    held = cut(held.select("h", F.col("first.doc_id").alias("first"), F.col("first.start").alias("place")), "held-runs")
    later = found.join(held, "h").filter("doc_id > first").select("doc_id", "version", "first", "place", "start", "end")
    each = later.groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "place", "start", "end")).alias("found"))
    return each.mapInArrow(_aligned, "doc_id long, version long, removed array<int>, moved array<int>")


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    def cut_lines(text, places):
        if places is None:
            return text
        gone = set(places.tolist())
        return "\n".join([x for k, x in enumerate(text.split("\n")) if k not in gone])

    return pd.Series([cut_lines(t, r) for t, r in zip(texts, removed)], dtype=object)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, moved: bool = True) -> DataFrame:
    """The rows of docs with text cut to the lines that stay; adds n_lines (of the input;
    an empty text has one, a null text none), n_removed and n_moved (how many of those stand
    in blocks that moved; with moved false these stay, and count nowhere).

    Null and empty texts lose nothing. Documents are ordered by doc_id; rows that repeat an
    id never lose lines to each other, and rows that repeat id and text fare alike. Rows
    without an id take no part. Input columns of those names are replaced. No rows: no
    rows."""
    docs = no_clash(docs, "n_lines", "n_removed", "n_moved", "removed", "moved", "version").withColumn("version", F.xxhash64("text"))
    found = repeated_lines(docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "version", "text"), min_chars)
    none = F.array().cast("array<int>")
    found = found if moved else found.withColumn("moved", none)
    own_id, own_version = (f"_{k}_" + "_".join(docs.columns) for k in ("id", "version"))  # names that no column has
    r = found.select(F.col("doc_id").alias(own_id), F.col("version").alias(own_version), F.concat("removed", "moved").alias("removed"), F.size("moved").alias("moved"))
    joined = docs.join(r, (F.col("doc_id") == F.col(own_id)) & (F.col("version") == F.col(own_version)), "left").drop(own_id, own_version, "version")
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    out = joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long"))
    out = out.withColumn("n_removed", F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long"))
    out = out.withColumn("n_moved", F.coalesce("moved", F.lit(0)).cast("long"))
    return out.withColumn("text", _without("text", "removed")).drop("removed", "moved")


def drop_emptied(docs: DataFrame) -> DataFrame:
    """dedup_lines with its columns gone, without the documents of which nothing is left."""
    out = dedup_lines(docs)
    return out.filter("n_removed = 0 or trim(text) <> ''").drop("n_lines", "n_removed", "n_moved")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "n_moved")


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE_SQL: dict[str, str] = {}
