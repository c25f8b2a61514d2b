"""SimHash near-duplicate detection with BK-trees over shards of fingerprints.

64 bits fall into five blocks. Two fingerprints with at most three differing bits agree on
at least two whole blocks, so the ten choices of two blocks key shards in which every such
pair meets: exact, whatever the data. A shard's BK-tree keys the children of a node by
their Hamming distance to it, and a search follows only the edges within the radius. A
shard with many fingerprints is dealt into trees of bounded size that every block of its
members searches, so no group goes to one task whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm.common import block_pairs, cut, no_clash, small_batches, table
from claimgraph.llm.components import components

RADIUS = 3
TREE_ROWS = 1024
_CUTS = [0, 13, 26, 39, 52, 64]
_SLICE = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text (null or no words: 0)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, _SLICE):
        part = w[at : at + _SLICE + words - 1]
        grams = zip(*(part[k:] for k in range(words))) if len(part) >= words else [part]
        h = np.array([digest(join(g), 42) for g in grams], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp), one row for each row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _masks() -> list[int]:
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(_CUTS, _CUTS[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(a | b) for a, b in combinations(blocks, 2)]


class BKTree:
    """Of fingerprints with their nodes; linked ones share a set. A subtree that lies in
    one set is left out of a search that has joined this set already."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.kids: list[dict[int, int]] = []
        self.up: list[int] = []
        self.whole: list[bool] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def new(self, key: int) -> int:
        self.keys.append(key)
        self.kids.append({})
        self.up.append(len(self.up))
        self.whole.append(True)
        return len(self.keys) - 1

    def link_near(self, x: int, top: int, radius: int) -> None:
        key, joined, todo = self.keys[x], set(), [top]
        while todo:
            i = todo.pop()
            r = self.root(i)
            if r in joined and self.whole[i]:
                continue
            d = (self.keys[i] ^ key).bit_count()
            if d <= radius and r not in joined:
                self.up[r] = self.root(x)
                joined = {self.root(x)}
            todo += [c for e, c in self.kids[i].items() if d - radius <= e <= d + radius]

    def insert(self, x: int, top: int) -> None:
        i, path, key = top, [], self.keys[x]
        while True:
            path.append(i)
            d = (self.keys[i] ^ key).bit_count()
            if d not in self.kids[i]:
                self.kids[i][d] = x
                break
            i = self.kids[i][d]
        own = self.root(x)
        for i in path:
            self.whole[i] = self.whole[i] and self.root(i) == own


def _tree_links(side_a: list, side_b: list | None) -> Iterator[tuple[int, int]]:
    """Spanning links (node, node) of one tree's own members, or of the other block with them."""
    tree, nodes = BKTree(), []
    for fp, node in side_a:
        x = tree.new(fp)
        nodes.append(node)
        if x:
            if side_b is None:
                tree.link_near(x, 0, RADIUS)
            tree.insert(x, 0)
    for fp, node in side_b or []:
        x = tree.new(fp)
        nodes.append(node)
        tree.link_near(x, 0, RADIUS)
    for x, node in enumerate(nodes):
        if (r := tree.root(x)) != x:
            yield node, nodes[r]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a_out: list[int] = []
        b_out: list[int] = []
        for same, members in zip(b.column("same").to_pylist(), b.column("members").to_pylist()):
            sides: dict[bool, list] = {True: [], False: []}
            for m in members:
                sides[same or m["in_a"]].append((m["fp"] & ((1 << 64) - 1), m["node"]))
            for x, y in _tree_links(sides[True], None if same else sides[False]) if sides[True] else ():
                a_out.append(x)
                b_out.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def near_links(fps: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """fps(fp, node), distinct -> links (a, b) that span the near-duplicate groups."""
    keyed = fps.select("fp", "node", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks()])).alias("choice", "shard"))
    pairs = block_pairs(keyed, ["choice", "shard"], tree_rows, "fp")
    shards = pairs.groupBy("choice", "shard", "block_a", "block_b").agg(
        F.collect_list(F.struct("fp", "node", (F.col("side") == F.col("block_a")).alias("in_a"))).alias("members")
    )
    return shards.select((F.col("block_a") == F.col("block_b")).alias("same"), "members").mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp, component_id), one row for each row.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows
    and repeated ids stay rows of their own. A row with a null doc_id takes its group's id,
    or null if no row of the group has one. Other columns are not read. No rows: no rows."""
    own = cut(fingerprints(docs), "fingerprints")
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(near_links(nodes.filter("node is not null"), tree_rows), "simhash")
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(no_clash(table(spark, sf_dir, "documents"), "fp", "component_id"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE_SQL: dict[str, str] = {}
