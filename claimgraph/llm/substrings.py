"""Removal of repeated byte strings by merging sorted shards of suffixes.

Suffixes are dealt by content, not by place: the smallest hash of the 24-byte strings in a
100-byte window is its anchor, so that equal windows meet under one anchor wherever they
stand. Windows that follow each other under one anchor form a segment. An anchor that
occurs once ends there; of segments that are equal as a whole the first stands for all.

The different segments of an anchor are shards of one suffix order. Their order is merged
by refining an interleave: at first all windows of an anchor are one block, and each round
reads the next eight bytes of the windows in a block and splits it. A block of one window
is settled and leaves; a round's new borders are common prefixes of eight bytes a round; the
blocks that outlive all rounds are the repeated intervals of 100 bytes. Windows whose
anchor has too many different segments for one task meet by two hashes of all their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph.llm.common import cut, forget, no_clash, small_batches, table

LENGTH = 100
ANCHOR = 24
#: Different segments of an anchor: up to the first bound many anchors share a batch, up to
#: the second one anchor (some 3 MB of bytes) is a batch of its own.
FEW_SEGMENTS, MOST_SEGMENTS = 256, 16_384
_SLICE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_RNG = np.random.default_rng(9)
_BYTE = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [(int(x) * 4 + 1) % (1 << 64) for x in _RNG.integers(0, 1 << 62, 2)]
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    got = _POWERS.get((base, 0))
    if got is None or len(got) < n:
        got = np.full(max(n, _SLICE + 4096), base, np.uint64)
        got[0] = 1
        got = _POWERS[base, 0] = np.multiply.accumulate(got)
    return got[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Of any substring of some bytes, by prefix sums modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        base = _BASE[which]
        n = len(data) + 1
        self.back = _powers(pow(base, -1, 1 << 64), n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[which][data] * _powers(base, n)[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data: the bytes of some texts in a row, fewer than 2**20; ends: where each ends.
    Gives of each segment its first window, its number of windows, and the hashes of its
    anchor and of all its bytes."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = Hashes(data)
    n_grams = n - ANCHOR + 1
    gram = hashes.of(slice(0, n_grams), slice(ANCHOR, n + 1))
    least = (gram & ~_PLACE) | np.arange(n_grams, dtype=np.uint64)  # ties: the leftmost
    width, have = LENGTH - ANCHOR + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least & _PLACE).astype(np.int64)
    starts = np.arange(n - LENGTH + 1)
    within = starts + LENGTH <= ends[np.searchsorted(ends, starts, side="right")]
    starts, anchor = starts[within], anchor[within]
    if not len(starts):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    lo = starts[first]
    return lo, size, gram[anchor[first]], hashes.of(lo, lo + size + LENGTH - 1)


def _parts(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Texts in a row, in parts of bounded size; a longer text in slices that overlap so
    that each window lies in one of them. Gives row, offset, bytes and ends of each."""
    rows, offsets, parts, size = [], [], [], 0

    def done():
        return rows, offsets, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])

    for row, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), _SLICE):
            part = t[at : at + _SLICE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if size + len(part) > _SLICE + LENGTH and parts:
                yield done()
                rows, offsets, parts, size = [], [], [], 0
            rows.append(row)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield done()


_SEGMENT = "doc_id long, lo int, n int, anchor long, content long"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id").to_numpy()
        for rows, offsets, data, ends in _parts(b.column("bytes").to_pylist()):
            lo, n, anchor, content = segments(data, ends)
            part = np.searchsorted(ends, lo, side="right")
            begin = np.append(0, ends[:-1])[part]
            values = [ids[np.array(rows)[part]], (lo - begin + np.array(offsets)[part]).astype(np.int32), n.astype(np.int32), anchor.view(np.int64), content.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["doc_id", "lo", "n", "anchor", "content"])


def _runs(doc: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Removed bytes (doc, from, to) of repeated windows; windows in a row are one run."""
    if not len(doc):
        return iter(())
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return zip(doc[first].tolist(), start[first].tolist(), (start[last] + LENGTH).tolist())


def merge_shards(data: bytes, at: np.ndarray, block: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Windows of data (at) in blocks -> which of them a smaller (doc, start) repeats.

    Each round refines the interleave of a block's windows by their next eight bytes, and
    drops blocks of one; after the last, a block is an interval of equal windows."""
    word = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    live = np.arange(len(at))
    for k in [*range(0, LENGTH - 7, 8), *([LENGTH - 8] if LENGTH % 8 else [])]:
        key = word[at[live] + k].astype(np.uint64)
        order = np.lexsort((key, block))
        live, block, key = live[order], block[order], key[order]
        border = np.ones(len(live) + 1, bool)
        border[1:-1] = (block[1:] != block[:-1]) | (key[1:] != key[:-1])
        alone = border[:-1] & border[1:]
        block = np.cumsum(border[:-1])[~alone]
        live = live[~alone]
        if not len(live):
            return live
    order = np.lexsort((start[live], doc[live], block))
    live, block = live[order], block[order]
    # a window that equals the first of its block in place, too, is not later than it
    head = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    head = np.repeat(head, np.diff(np.append(head, len(block))))
    later = (doc[live] != doc[live[head]]) | (start[live] != start[live[head]])
    return live[later]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        column = b.column("members")
        sizes = column.value_lengths().to_numpy()
        doc, lo, n, raw = (column.flatten().field(x) for x in ("doc_id", "lo", "n", "bytes"))
        doc, lo, n = (x.to_numpy().astype(np.int64) for x in (doc, lo, n))
        group = np.repeat(np.arange(len(sizes)), sizes)
        # groups in a row, about 4 MB of bytes at a time
        step = np.cumsum(np.bincount(group, n + LENGTH, len(sizes))) // (4 << 20)
        for s in np.unique(step):
            use = np.flatnonzero(step[group] == s)
            parts = raw.take(pa.array(use)).to_pylist()
            begin = np.cumsum([0, *map(len, parts)])[:-1]
            count = n[use]
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            of = np.repeat(use, count)
            found = merge_shards(b"".join(parts), np.repeat(begin, count) + k, group[of], doc[of], lo[of] + k)
            out += _runs(doc[of][found], (lo[of] + k)[found])
        yield _spans(out)


def _merged_alone(group: pa.Table) -> pa.Table:
    fields = [group.column(c).combine_chunks() for c in ("doc_id", "lo", "n", "bytes")]
    members = pa.StructArray.from_arrays(fields, names=["doc_id", "lo", "n", "bytes"])
    whole = pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), members)
    return pa.Table.from_batches(list(_merged(iter([pa.RecordBatch.from_arrays([whole], names=["members"])]))))


def _spans(out: list[tuple]) -> pa.RecordBatch:
    d, f, t = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(f, pa.int32()), pa.array(t, pa.int32())], names=["doc_id", "begin", "end"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each document."""
    for b in batches:
        for doc, data, wanted in zip(b.column("doc_id").to_pylist(), b.column("bytes").to_pylist(), b.column("wanted").to_pylist()):
            lo = [w["lo"] for w in wanted]
            n = [w["n"] for w in wanted]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w["anchor"] for w in wanted], pa.int64()), pa.array([w["n_kinds"] for w in wanted], pa.int64()), pa.array([doc] * len(lo), pa.int64()),
                    pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array([data[x : x + c + LENGTH - 1] for x, c in zip(lo, n)], pa.binary()),
                ],
                names=["anchor", "n_kinds", "doc_id", "lo", "n", "bytes"],
            )


def _batched(batches: Iterator[pa.RecordBatch], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for anchor, doc, lo, n, data in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc_id", "lo", "n", "bytes"))):
            raw = np.frombuffer(data, np.uint8)
            h = [Hashes(raw, w).of(slice(0, n), slice(LENGTH, LENGTH + n)).view(np.int64) for w in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(np.full(n, doc)), pa.array(np.arange(lo, lo + n, dtype=np.int32))], names=["h0", "h1", "doc_id", "lo"])


def repeated_spans(docs: DataFrame, few_segments: int = FEW_SEGMENTS, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """docs(doc_id, bytes) -> (doc_id, begin, end): bytes covered by a string of LENGTH
    bytes that also starts earlier; spans may overlap."""
    small_batches(docs.sparkSession)
    place = lambda: F.struct("doc_id", "lo")
    found = docs.filter(F.length("bytes") >= LENGTH).select("doc_id", "bytes").mapInArrow(_segments, _SEGMENT)
    often = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor")
    # written first: joined from its table, both sides are dealt anew and Spark splits a hot anchor
    often = cut(often, "frequent-anchors", drop_shuffles=True)
    again = cut(found.join(often, "anchor"), "segments", drop_shuffles=True)
    forget(often)
    kinds = again.groupBy("anchor", "content", "n").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("times"))
    kinds = cut(kinds, "segment-kinds", drop_shuffles=True)
    repeats = again.join(kinds.filter("times > 1").drop("times"), ["anchor", "content", "n"]).filter(place() > F.col("first"))
    whole = repeats.select("doc_id", F.col("lo").alias("begin"), (F.col("lo") + F.col("n") + (LENGTH - 1)).alias("end"))
    # the different segments of an anchor are compared byte by byte
    unlike = cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_kinds")).filter("n_kinds > 1"), "unlike-anchors", drop_shuffles=True)
    shards = kinds.join(unlike, "anchor").select("anchor", "n_kinds", "n", "first.doc_id", "first.lo")
    wanted = shards.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "n_kinds", "lo", "n")).alias("wanted"))
    cut_out = docs.join(wanted, "doc_id").select("doc_id", "bytes", "wanted").mapInArrow(lambda b: _batched(_cut_out(b)), "anchor long, n_kinds long, doc_id long, lo int, n int, bytes binary")
    sized = cut(cut_out.dropDuplicates(["anchor", "doc_id", "lo"]), "segment-bytes", drop_shuffles=True)
    forget(unlike)
    span = "doc_id long, begin int, end int"
    few = sized.filter(F.col("n_kinds") <= few_segments).groupBy("anchor").agg(F.collect_list(F.struct("doc_id", "lo", "n", "bytes")).alias("members"))
    merged = few.select("members").mapInArrow(_merged, span)
    more = sized.filter((F.col("n_kinds") > few_segments) & (F.col("n_kinds") <= most_segments)).groupBy("anchor").applyInArrow(_merged_alone, span)
    many = sized.filter(F.col("n_kinds") > most_segments)
    hashed = many.select("anchor", "doc_id", "lo", "n", "bytes").mapInArrow(lambda b: _batched(_window_hashes(b)), "h0 long, h1 long, doc_id long, lo int")
    hashed = cut(hashed, "windows", drop_shuffles=True)
    firsts = hashed.groupBy("h0", "h1").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    later = hashed.join(firsts, ["h0", "h1"]).filter(place() > F.col("first"))
    single = later.select("doc_id", F.col("lo").alias("begin"), (F.col("lo") + LENGTH).alias("end"))
    # written, so that the documents are dealt to their spans when all else is gone
    spans = cut(whole.unionByName(merged).unionByName(more).unionByName(single), "spans", drop_shuffles=True)
    for done in (again, kinds, sized, hashed):
        forget(done)
    return spans


@F.pandas_udf(T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_spans", T.LongType())]))
def _kept(raw: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for data, own in zip(raw, spans):
        if own is None:
            rows.append((data, 0))
            continue
        parts, runs, at = [], 0, -1
        for s in sorted((s["begin"], s["end"]) for s in own):
            if s[0] > at:
                parts.append(data[max(at, 0) : s[0]])
                runs += 1
            at = max(at, s[1])
        rows.append((b"".join([*parts, data[at:]]), runs))
    return pd.DataFrame(rows, columns=["kept", "n_spans"])


def dedup_substrings(docs: DataFrame, few_segments: int = FEW_SEGMENTS, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, n_removed, n_spans, kept binary), one row
    for each row.

    Null and empty texts have no bytes and lose none. Rows that repeat an id are one
    document: their spans are shared, and equal places do not repeat each other. Rows
    without an id lose nothing. Other columns are not read. No rows: no rows."""
    raw = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("bytes"))
    spans = repeated_spans(raw.filter("doc_id is not null"), few_segments, most_segments)
    by_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    joined = raw.join(by_doc, "doc_id", "left").withColumn("k", _kept("bytes", "spans"))
    return joined.select("doc_id", F.length("bytes").cast("long").alias("n_bytes"), (F.length("bytes") - F.length("k.kept")).cast("long").alias("n_removed"), F.col("k.n_spans").alias("n_spans"), F.col("k.kept").alias("kept"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(no_clash(table(spark, sf_dir, "documents"), "bytes"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_substrings": op9_substrings}
ORACLE_SQL: dict[str, str] = {}
