"""Next-fit packing: items in order, a new batch where the next one would not fit.

A key's items are dealt by their order into blocks. Within a block prefix sums give each item the
item that begins the next batch if it begins one itself, and doubling these pointers gives every
possible first batch of the block its last one: so a block tells how full it leaves the last batch, for
each amount that it may find in use. These summaries are followed from block to block, a few
numbers each, and then all blocks number their items at once. A key may have any number of items:
they lie in as many tasks as it has blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_CHARS = 12_000
#: Values of the order in a block, and so items at most, as it is unique within a key.
BLOCK = 1 << 14


def _next_starts(sums: np.ndarray, budget: int, base: int, counted: bool) -> np.ndarray:
    """For each item as the first of a batch the first item of the next, or the number of items."""
    n = len(sums)
    before = np.concatenate(([0], sums[:-1]))
    over = np.searchsorted(sums, before + (budget - base), side="right")
    # something must be in a batch that an item does not fit: an item, or a size over zero
    least = np.arange(n) + 1 if counted or base else np.minimum(np.searchsorted(sums, before, side="right"), n - 1) + 1
    return np.minimum(np.maximum(over, least), n)


def _first_start(sums: np.ndarray, budget: int, used: int, some: bool, counted: bool) -> int:
    """The first item that opens a batch in a block that finds so much in use."""
    over = int(np.searchsorted(sums, budget - used, side="right"))
    if counted and not some:
        over = max(over, 1)
    elif not counted and not used:
        over = max(over, int(np.searchsorted(sums, 0, side="right")) + 1)
    return min(over, len(sums))


def _last_starts(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pointers from each item end within the block, and how many batches begin till there."""
    n = len(following)
    at = np.where(following < n, following, np.arange(n))
    steps = (following < n).astype(np.int64)
    while True:
        steps, new = steps + steps[at], at[at]
        if (new == at).all():
            return at, steps + 1
        at = new


def _blocks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, int, list[pa.RecordBatch]]]:
    """The rows of each (key, block) as they come, sorted."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys, blocks = b.column(key).to_pylist(), b.column("_block").to_numpy()
        at = 0
        for i in range(1, b.num_rows + 1):
            if i == b.num_rows or keys[i] != keys[at] or blocks[i] != blocks[at]:
                if now is not None and now != (keys[at], blocks[at]):
                    yield *now, held
                    held = []
                now = keys[at], int(blocks[at])
                held.append(b.slice(at, i - at))
                at = i
    if now is not None:
        yield *now, held


def _together(parts: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Small batches as fewer large ones."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += p.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _column(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([p.column(name).to_numpy() for p in parts])


_SUMMARY = "_block long, base long, total long, n long, sums array<bigint>, left array<bigint>, begun array<bigint>"


def _summary(sums: np.ndarray, base: int, budget: int, counted: bool) -> tuple:
    """What a block of running sums tells those behind it."""
    last, begun = _last_starts(_next_starts(sums, budget, base, counted))
    left = base + sums[-1] - np.concatenate(([0], sums[:-1]))[last]
    # of the items that can be the block's first to open a batch: up to the first that does not fit an empty one
    fits = _first_start(sums, budget, 0, False, counted) + 1
    return base, int(sums[-1]), len(sums), sums[:fits], left[:fits], begun[:fits]


def _summaries(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=["_key", "_block", "base", "total", "n", "sums", "left", "begun"])


def _entries(found: DataFrame, kind: str, budget: int, counted: bool) -> DataFrame:
    """Summaries of blocks -> (_key, _block, _used, _some, _batch): how each block finds the last batch."""

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, some, batch = object(), 0, False, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["_key"] != now:
                    now, used, some, batch = r["_key"], r["base"], False, 0
                out.append((used, some, batch))
                sums = np.array(r["sums"], np.int64)
                first = _first_start(sums, budget, used, some, counted)
                if first < len(sums) and first < r["n"]:
                    used, batch = r["left"][first], batch + r["begun"][first]
                else:
                    used += r["total"]
                some = True
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_block"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64()))]], names=["_key", "_block", "_used", "_some", "_batch"])

    return found.repartition("_key").sortWithinPartitions("_key", "_block").mapInArrow(followed, f"_key {kind}, _block long, _used long, _some boolean, _batch long")


def _numbers(sums: np.ndarray, base: int, used: int, some: bool, batch: int, budget: int, counted: bool) -> np.ndarray:
    """The batch of each item of a block that finds the last one so."""
    following = _next_starts(sums, budget, base, counted)
    opens = np.zeros(len(sums), np.int64)
    at = _first_start(sums, budget, used, some, counted)
    while at < len(sums):
        opens[at] = 1
        at = int(following[at])
    return (batch + np.cumsum(opens)).astype(np.int32)


def fold(rows: DataFrame, key: str, order: str, budget: int, counted: bool, block: int = BLOCK) -> DataFrame:
    """rows(key, order, size, base, ...) -> the same with batch, from 0 in each key. order is a
    whole number, unique within a key; base is one of a key. A batch begins at base; the next
    item opens a new one if it would pass the budget and there is something in the batch: an
    item, if counted, else a size over zero (or a base)."""
    kind, names = rows.schema[key].dataType.simpleString(), rows.columns
    blocks = rows.withColumn("_block", F.floor(F.col(order) / F.lit(float(block))).cast("long"))
    dealt = blocks.repartition(key, "_block").sortWithinPartitions(key, "_block", order)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for k, no, parts in _blocks(batches, key):
            held.append((k, no, *_summary(np.cumsum(_column(parts, "size")), int(parts[0].column("base")[0].as_py()), budget, counted)))
            if len(held) == 1000:
                yield _summaries(held, parts[0].column(key).type)
                held = []
        if held:
            yield _summaries(held, parts[0].column(key).type)

    entries = _entries(dealt.select(key, "_block", "size", "base").mapInArrow(summaries, f"_key {kind}, {_SUMMARY}"), kind, budget, counted)
    entries = entries.withColumnRenamed("_block", "_b")
    both = blocks.join(entries, blocks[key].eqNullSafe(entries["_key"]) & (blocks["_block"] == entries["_b"])).drop("_key", "_b")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch int"

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _together(with_batch(batches))

    def with_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, parts in _blocks(batches, key):
            sums = np.cumsum(_column(parts, "size"))
            first = parts[0]
            numbers, at = _numbers(sums, *(first.column(c)[0].as_py() for c in ("base", "_used", "_some", "_batch")), budget, counted), 0
            for p in parts:
                cols = [p.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(numbers[at : at + p.num_rows])], names=[*names, "batch"])
                at += p.num_rows

    return both.repartition(key, "_block").sortWithinPartitions(key, "_block", order).mapInArrow(numbered, schema)


def fold_listed(blocks: DataFrame, key: str, sizes: str, items: list[str], budget: int) -> DataFrame:
    """blocks(key, _block, base, sizes, items), a row a block with arrays of its items' sizes and
    values in order, one item at least -> (key, _block, base, batch, items): the items of each batch
    in a block, batches numbered as fold() numbers them, counted. key is not null. Blocks are rows, so
    that they are not dealt again."""
    kind = blocks.schema[key].dataType.simpleString()
    told = "".join(f", `{c}` {blocks.schema[c].dataType.simpleString()}" for c in items)

    def sums_of(column: pa.Array) -> Iterator[np.ndarray]:
        at, flat = column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten().to_numpy()
        for low, high in zip(at[:-1], at[1:]):
            yield np.cumsum(flat[low:high])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = zip(*[b.column(c).to_pylist() for c in (key, "_block", "base")], sums_of(b.column(sizes)))
            yield _summaries([(k, no, *_summary(sums, base, budget, True)) for k, no, base, sums in places], b.column(key).type)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, numbers, cuts, n = [], [], [0], 0
            for row, sums, *state in zip(range(b.num_rows), sums_of(b.column(sizes)), *[b.column(c).to_pylist() for c in ("base", "_used", "_some", "_batch")]):
                own = _numbers(sums, *state, budget, True)
                begins = np.flatnonzero(np.diff(own, prepend=-1))
                of += [row] * len(begins)
                numbers.append(own[begins])
                cuts += [n + x for x in [*begins[1:].tolist(), len(own)]]
                n += len(own)
            if not n:
                continue
            parts = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), b.column(c).flatten()) for c in items]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(of)) for c in (key, "_block", "base")], pa.array(np.concatenate(numbers)), *parts], names=[key, "_block", "base", "batch", *items])

    found = blocks.select(key, "_block", "base", sizes).mapInArrow(summaries, f"_key {kind}, {_SUMMARY}")
    entries = _entries(found, kind, budget, True).withColumnRenamed("_key", key)
    return blocks.join(entries.hint("merge"), [key, "_block"]).mapInArrow(parted, f"`{key}` {kind}, _block long, base long, batch int{told}")


def next_fit(items: DataFrame, key: str, order: str, size: str, budget: int = BATCH_CHARS, block: int = BLOCK) -> DataFrame:
    """Adds batch (from 0 in each key) to (key, order). An item over the budget is a batch
    of its own; a null size counts as none."""
    rows = items.select(key, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), F.lit(0).cast("long").alias("base"))
    return fold(rows, key, order, budget, counted=False, block=block).select(key, order, "batch")
