"""Near-duplicates by the Jaccard similarity of their sets of five-word shingles.

First op5's trees link: fingerprints of the shingles that differ in few bits meet in BK-trees, and
what these connect is a link if the whole sets have the similarity. At 0.8 fingerprints may
differ in more bits than the trees' radius, so what they leave apart goes on:
MinHash finds candidates: 24 bands of five minima each, so that two texts of similarity s
meet in a band with probability 1 - (1 - s^5)^24, which is 0.9999 at 0.8. A candidate pair
becomes a link only if its whole sets have the similarity. Each text is compared with
one that it meets. Texts of bands that this leaves in several components are then joined
exactly, by prefix: with shingles ordered from rare to frequent, similar sets have their
first common shingle near both beginnings, and its two places bound what can follow. So
boiler-plate, which many share, is hardly ever a key. Each text is compared with the
smallest that shares such a key, and what stays in different components in blocks: every
pair that meets is linked, already connected, or ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import block_pairs, cut, no_clash, small_batches
from claimgraph.llm.components import components
from claimgraph.llm.simhash import near_links

WORDS = 5
MIN_JACCARD = 0.8
BANDS, ROWS = 24, 5
BLOCK_ROWS = 512
_SLICE = 1 << 13
_random = np.random.default_rng(11)
_FACTORS = _random.integers(1 << 62, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _random.integers(1 << 62, 1 << 63, ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's runs of words (fewer words: the one run of all)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    grams = zip(*(w[k:] for k in range(words))) if len(w) >= words else [w]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(g), 42) for g in grams], np.uint64))


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed number (none: 0)."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _SLICE):
        ones += np.unpackbits(h[at : at + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def bands(h: np.ndarray) -> np.ndarray:
    least = np.full(len(_FACTORS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), _SLICE):
        np.minimum(least, (h[at : at + _SLICE, None] * _FACTORS).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def similar(x: np.ndarray, y: np.ndarray, min_jaccard: float) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= min_jaccard * (len(x) + len(y) - common) - 1e-9


def _sketches(words: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, prints, found = [], [], []
            for t in b.column("text"):
                h = shingles(t.as_py(), words)
                nodes.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63) if len(h) else 0)
                prints.append(fingerprint(h))
                found.append(bands(h) if len(h) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row_hash"), pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "row_hash", "node", "fp", "bands"],
            )

    return sketch


def _verified(words: int, min_jaccard: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, None
        for b in batches:
            ok = []
            for a, node, text, other in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("text_a"), b.column("text_b")):
                if last != node:
                    last, hub = node, shingles(other.as_py(), words)
                ok.append(similar(shingles(text.as_py(), words), hub, min_jaccard))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return verify


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), pa.array([len(h) for h in found], pa.int64()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["node", "size", "tokens"]
            )

    return sets


def _block_pairs(min_jaccard: float):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.zeros((2, 0), np.int64)]
            for same, members in zip(b.column("same").to_pylist(), b.column("members").to_pylist()):
                node, size, left, component, in_a = np.array([tuple(m.values()) for m in members], np.int64).T
                i, j = np.nonzero((in_a == 1)[:, None] & ((node[:, None] < node) if same else (in_a == 0)))
                keep = (np.minimum(left[i], left[j]) * (1 + min_jaccard) >= min_jaccard * (size[i] + size[j]) - 1e-6) & (component[i] != component[j])
                out.append(np.stack([np.maximum(node[i], node[j])[keep], np.minimum(node[i], node[j])[keep]]))
            a, c = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])

    return pairs


def _postings(sets: DataFrame, min_jaccard: float) -> DataFrame:
    """sets(node, size, tokens) -> (node, size, token, left): the tokens that can be the first
    common one of similar sets, and how many of a set's tokens are left from there on, in
    the order of their frequency. Tokens of one set come first and match nothing."""
    each = sets.select("node", "size", F.explode("tokens").alias("token"))
    # written first, so that Spark splits a hot token of the join
    repeated = cut(each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "tokens")
    ranked = each.join(repeated, "token").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))
    left = ranked.select("node", "size", F.size("shared").alias("n_shared"), F.posexplode("shared").alias("k", "x")).withColumn("left", (F.col("n_shared") - F.col("k")).cast("long"))
    return left.filter(F.col("left") >= F.col("size") * min_jaccard - 1e-6).select("node", "size", "x.token", "left")


def _tree_pairs(nodes: DataFrame) -> DataFrame:
    """nodes(node, fp) -> (a, b): each node with the first of its fingerprint, and what op5's
    trees connect of these. No text: no pair."""
    some = nodes.filter("node <> 0").select("node", "fp")
    first = cut(some.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    copies = some.join(first, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return cut(copies.unionByName(near_links(first.select("fp", F.col("first").alias("node")))), "tree-pairs")


def _with_rows(docs: DataFrame) -> DataFrame:
    """Adds row_hash, of all columns; nulls count by their column."""
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in docs.columns])
    return docs.withColumn("row_hash", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], nulls))


def groups(docs: DataFrame, words: int = WORDS, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """docs(doc_id, text, row_hash, ...) -> (doc_id, row_hash, component), one row for each
    row. Texts without words are one group."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), "row_hash", F.col("text").cast("string"))
    own = cut(texts.mapInArrow(_sketches(words), "doc_id long, row_hash long, node long, fp long, bands array<long>"), "sketches")
    nodes = own.groupBy("node").agg(F.min("row_hash").alias("row_hash"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    trees = _tree_pairs(nodes)
    keyed = nodes.select("node", "row_hash", F.posexplode("bands").alias("band", "sig"))
    keyed = keyed.select("node", "row_hash", F.xxhash64("band", "sig").alias("bucket"))
    hubs = keyed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").drop("high")
    # written first, so that Spark splits a hot key of the join
    met = cut(keyed.join(cut(hubs, "hubs"), "bucket").select("node", "row_hash", "bucket", "low"), "met")
    in_trees = trees.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = met.select("node", "row_hash").unionByName(nodes.select("node", "row_hash").join(in_trees, "node")).distinct()
    bodies = cut(texts.select("row_hash", "text").join(wanted, "row_hash").dropDuplicates(["node"]).select("node", "text"), "candidate-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs")
        sides = [bodies.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
        return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b").mapInArrow(_verified(words, min_jaccard), "a long, b long")

    def placed(df: DataFrame, found: DataFrame, node: str = "node", name: str = "component") -> DataFrame:
        of = found.select(F.col("node").alias(node), F.col("component").alias("of"))
        return df.join(of, node, "left").withColumn(name, F.coalesce("of", node)).drop("of")

    def mixed(df: DataFrame, key: str) -> DataFrame:
        """The keys whose rows are in several components, with their number of rows."""
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select(key, "n")

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        return placed(placed(pairs, found, "a", "of_a"), found, "b", "of_b").filter("of_a <> of_b").select("a", "b")

    links = cut(verified(trees), "links")
    found = components(links, "simhash")
    low = met.filter("node <> low").groupBy(F.col("node").alias("a")).agg(F.min("low").alias("b"))
    links = cut(links.unionByName(verified(apart(low, found))), "links")
    found = components(links, "shingles")
    open_ = met.join(cut(mixed(placed(met.select("node", "bucket"), found), "bucket"), "open"), "bucket", "left_semi").select("node").distinct()
    sets = cut(bodies.join(open_, "node", "left_semi").mapInArrow(_sets(words), "node long, size long, tokens array<long>"), "sets")
    postings = cut(_postings(sets, min_jaccard), "postings")

    hubs = cut(postings.groupBy("token").agg(F.min(F.struct("node", "size", "left")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "hubs")
    near = postings.join(hubs, "token").filter("node <> hub.node").filter(F.least("left", "hub.left") * (1 + min_jaccard) >= (F.col("size") + F.col("hub.size")) * min_jaccard - 1e-6)
    near = near.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
    links = cut(links.unionByName(verified(apart(near, found))), "links")
    found = components(links, "shingles")

    rest = cut(placed(postings, found), "placed")
    rest = block_pairs(rest.join(cut(mixed(rest, "token"), "open-tokens"), "token"), ["token"], BLOCK_ROWS, "node", "n")
    member = F.struct("node", "size", "left", "component", (F.col("side") == F.col("block_a")).cast("int").alias("in_a"))
    blocks = rest.groupBy("token", "block_a", "block_b").agg(F.collect_list(member).alias("members")).filter("size(members) > 1")
    blocks = blocks.select((F.col("block_a") == F.col("block_b")).alias("same"), "members")
    links = cut(links.unionByName(verified(blocks.mapInArrow(_block_pairs(min_jaccard), "a long, b long").distinct())), "links")
    found = components(links, "shingles")
    return own.join(found, "node", "left").select("doc_id", "row_hash", F.coalesce("component", "node").alias("component"))


def keep_first(docs: DataFrame, words: int = WORDS, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """One row of every group of docs: that of the smallest id, a row with an id before one
    without, and of rows that repeat the id, that of the smallest hash. Rows that share an
    id, or have none, stay if their texts are unlike. No rows: no rows."""
    docs = _with_rows(no_clash(docs, "row_hash"))
    first = groups(docs, words, min_jaccard).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("first"))
    kept = cut(first.select("first.row_hash"), "kept-rows")
    return docs.join(kept, "row_hash", "left_semi").dropDuplicates(["row_hash"]).drop("row_hash")
