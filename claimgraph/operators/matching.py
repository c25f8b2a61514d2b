"""Candidate pairs of facts by three equi-joins: identifier, attribute token, fuzzy name.

A join on "identifier or token or name" would compare all pairs. Each criterion has its own
key instead; a pair keeps the first criterion that it meets."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph.functions import normalize as N
from claimgraph.functions import ratios
from claimgraph.operators import components
from claimgraph.sources import scratch

THRESHOLD = 0.8
#: Names of each side that a task compares at once: so many squared are the pairs held as bits.
BLOCK = 4096
#: Names that are alike but for their last characters, so many, are counted together from so many names on.
BEHIND = 6
MANY = 4096
#: Names that a task counts at once, and parts into which those to be counted are dealt.
COUNTED = 1 << 18
PARTS = 64


def prepared(facts: DataFrame) -> DataFrame:
    return facts.select("id", N.identifier(F.col("entity_id")).alias("key"), N.attribute_tokens(F.col("attribute")).alias("tokens"), N.entity_name(F.col("entity_name")).alias("name"))


def by_identifier(new: DataFrame, old: DataFrame) -> DataFrame:
    a, b = new.select(F.col("id").alias("new_id"), "key"), old.select(F.col("id").alias("old_id"), "key")
    return a.join(b, "key").filter("new_id <> old_id").select("new_id", "old_id")


def by_token(new: DataFrame, old: DataFrame) -> DataFrame:
    a, b = new.select(F.col("id").alias("new_id"), F.explode("tokens").alias("token")), old.select(F.col("id").alias("old_id"), F.explode("tokens").alias("token"))
    return a.join(b, "token").filter("new_id <> old_id").select("new_id", "old_id").distinct()


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of matching characters in the longest common blocks; the order of arguments counts."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def _name_grams(df: DataFrame, name: str) -> DataFrame:
    """Distinct names with their pairs of adjacent characters, the n-th of equal ones marked
    with n; names of three characters or fewer have their single characters too."""
    names = df.select(F.col("name").alias(name)).filter("name <> ''").distinct()
    pairs = F.expr(f"transform(sequence(1, greatest(length({name}) - 1, 1)), i -> substring({name}, i, 2))")
    marked = F.expr("transform(pairs, (g, i) -> concat(g, size(filter(slice(pairs, 1, i + 1), x -> x = g))))")
    singles = F.when(F.length(name) <= 3, F.split(name, "")).otherwise(F.array().cast("array<string>"))
    return names.select(name, pairs.alias("pairs")).select(name, F.explode(F.array_distinct(F.concat(marked, singles))).alias("gram"))


def _suffices(name: str) -> Column:
    """Whether a gram at a place in an order of a name's grams is among those to join on."""
    met = F.greatest(F.ceil(F.length(name) / 3.0 - 1), F.lit(1))
    return (F.length(name) <= 3) | (F.col("place") <= F.length(name) - met)


def prefix_grams(df: DataFrame) -> DataFrame:
    """(name, gram) of distinct names: as similar_names joins on them, but in the order of a
    hash, which stays when names are added: any fixed order will do."""
    place = F.row_number().over(W.partitionBy("name").orderBy(F.xxhash64("gram"), "gram"))
    return _name_grams(df, "name").withColumn("place", place).filter(_suffices("name")).select("name", "gram")


def most_in_common(a: Column, b: Column) -> Column:
    """How many characters two texts can have in common at most, each as often as both hold it."""
    counted = lambda c: F.array_sort(F.split(c, ""))
    marked = lambda c: F.transform(counted(c), lambda x, i: F.concat(x, (i - F.array_position(counted(c), x) + 1).cast("string")))
    return F.size(F.array_intersect(marked(a), marked(b)))


def verified(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) of names with a ratio of 0.8 or more, and the ratio. Lengths and the characters
    in common bound it from above, as Columns; what these leave is compared."""
    lengths = F.length("a") + F.length("b")
    near = pairs.filter("3 * least(length(a), length(b)) >= 2 * greatest(length(a), length(b))").filter(2 * most_in_common(F.col("a"), F.col("b")) >= THRESHOLD * lengths - 1e-9)
    return near.withColumn("ratio", ratio("a", "b")).filter(F.col("ratio") >= THRESHOLD)


def _rare_grams(side: DataFrame, often: DataFrame) -> DataFrame:
    """(name, gram, earlier) of distinct names: the grams that suffice to find a name, from rare to
    frequent, and with each the ones before it."""
    ranked = _name_grams(side, "name").join(often, "gram").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    met = F.greatest(F.ceil(F.length("name") / 3.0 - 1), F.lit(1)).cast("int")
    suffice = F.when(F.length("name") <= 3, F.size("grams")).otherwise(F.greatest(F.length("name") - met, F.lit(0)))
    rare = ranked.select("name", F.slice(F.transform("grams", lambda g: g["gram"]), F.lit(1), suffice).alias("grams"))
    return rare.select("name", "grams", F.posexplode("grams").alias("place", "gram")).select("name", "gram", F.slice("grams", F.lit(1), F.col("place")).alias("earlier"))


def _dealt(new: DataFrame, old: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(gram, block_a, block_b, is_new, name, earlier): the names under each gram in blocks of
    about BLOCK names, each block of new ones with each of old ones. Names of one of classes(name,
    class), if given, do not meet each other."""
    a, b = new.select("name"), old.select("name")
    grams = _name_grams(a, "a").select("gram").unionByName(_name_grams(b, "b").select("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    sides = [_rare_grams(x, often).withColumn("is_new", F.lit(k == 0)) for k, x in enumerate((a, b))]
    both = sides[0].unionByName(sides[1])
    classed = both.withColumn("class", F.lit("")) if classes is None else both.join(classes.select("name", "class"), "name", "left").na.fill("", ["class"])
    postings = scratch.kept(classed, "name-grams")
    sizes = postings.groupBy("gram", "is_new", "class").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("long").alias("blocks"))
    each = sizes.select("gram", "is_new", "class", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("own"))
    side = lambda which, s: each.filter(which).select("gram", F.col("class").alias(f"class_{s}"), F.col("own").alias(s), F.concat_ws(":", "class", "own").alias(f"block_{s}"))
    pairs = side(F.col("is_new"), "a").join(side(~F.col("is_new"), "b"), "gram").filter("class_a = '' or class_a <> class_b")
    of = lambda s: F.struct(F.lit(s == "a").alias("is_new"), F.col(f"class_{s}").alias("class"), F.col(s).alias("own"))
    met = pairs.select("gram", "block_a", "block_b", F.inline(F.array(of("a"), of("b"))))
    own = postings.join(sizes, ["gram", "is_new", "class"]).withColumn("own", F.expr("pmod(xxhash64(name), blocks)"))
    dealt = own.join(met, ["gram", "is_new", "class", "own"]).select("gram", "block_a", "block_b", "is_new", "name", "earlier")
    # the work goes with pairs, not with bytes: not to be put together into few tasks
    return dealt.repartition(4 * new.sparkSession.sparkContext.defaultParallelism, "gram", "block_a", "block_b")


def _met_in_blocks(table: pa.Table, whole: bool) -> tuple[list[str], list[str], Iterator]:
    """Of two blocks under a gram the names of both and the alike pairs that share no earlier gram,
    so that a pair is compared under the first gram that it shares alone."""
    new = table.column("is_new").to_numpy()
    names, earlier = table.column("name").to_pylist(), table.column("earlier").combine_chunks()
    code = earlier.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(names)), earlier.value_lengths().to_numpy())
    gram = code.indices.to_numpy()
    bits = np.zeros((len(code.dictionary) // 64 + 1, len(names)), np.uint64)
    np.bitwise_or.at(bits, (gram // 64, row), np.uint64(1) << (gram % 64).astype(np.uint64))
    a, b = np.flatnonzero(new), np.flatnonzero(~new)
    bits_a, bits_b = bits[:, a], bits[:, b]

    def first_met(part: slice) -> np.ndarray:
        shared = np.zeros((bits_a[:, part].shape[1], len(b)), np.uint64)
        for x, y in zip(bits_a[:, part], bits_b):
            shared |= x[:, None] & y[None, :]
        return shared == 0

    a_names, b_names = [names[k] for k in a], [names[k] for k in b]
    return a_names, b_names, ratios.alike(a_names, b_names, THRESHOLD, first_met, whole) if len(a) and len(b) else iter(())


def _pairs_of_blocks(table: pa.Table) -> pa.Table:
    a, b, found = _met_in_blocks(table, True)
    out = [(a[i], b[j], 2.0 * m / (len(a[i]) + len(b[j]))) for x, y, z in found for i, j, m in zip(x.tolist(), y.tolist(), z.tolist())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.string(), pa.float64()))], names=["a", "b", "ratio"])


def _links_of_blocks(table: pa.Table) -> pa.Table:
    """For each name how many others it links to here, and links that span what hangs together."""
    a, b, found = _met_in_blocks(table, False)
    alike = np.zeros((len(a), len(b)), bool)
    for i, j, _ in found:
        alike[i, j] = True
    place = {name: j for j, name in enumerate(b)}
    for i, name in enumerate(a):
        if name in place:
            alike[i, place[name]] = False
    n, out, left = alike.sum(axis=1), [], np.ones(len(a), bool)
    for first in np.flatnonzero(n):
        if not left[first]:
            continue
        left[first] = False
        seen, reach = np.zeros(len(b), bool), alike[first]
        while (new := reach & ~seen).any():
            out += [(a[first], b[j], 0) for j in np.flatnonzero(new)]
            seen |= new
            more = np.flatnonzero(left & alike[:, new].any(axis=1))
            left[more] = False
            out += [(a[i], a[first], 0) for i in more]
            reach = alike[more].any(axis=0)
    out += [(a[i], None, int(n[i])) for i in np.flatnonzero(n)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.string(), pa.int64()))], names=["a", "b", "n"])


def similar_names(new: DataFrame, old: DataFrame) -> DataFrame:
    """(a, b, ratio) of distinct names.

    A ratio of 0.8 needs lengths within a factor of 1.5, and 0.4 of both lengths matched in
    blocks that unmatched characters divide: 0.2 of both lengths, less one, are equal pairs
    of adjacent characters, at least one from six characters on. Of a name of n characters
    with n - 1 pairs, n / 3 - 1 are therefore met, and the rarest ones but so many suffice to
    find it. Shorter names share a single character. Names under a gram meet in blocks, within
    a task, so that pairs that are not alike are never rows."""
    return _dealt(new, old).groupBy("gram", "block_a", "block_b").applyInArrow(_pairs_of_blocks, "a string, b string, ratio double")


@F.pandas_udf(T.IntegerType())
def _needed_behind(names: pd.Series) -> pd.Series:
    return pd.Series(ratios.needed_behind(names.tolist(), THRESHOLD, BEHIND), dtype="Int32")


def _classes(nodes: DataFrame) -> DataFrame | None:
    """nodes(name, node) of distinct names -> (name, node, class, rest, need): the names of one length and
    one beginning, at least MANY, that differ in their last BEHIND characters, where need of these must
    match. Only classes that hang together: names with the same first need of these characters are
    alike, and so are those with the same last need, so that beginnings and ends are followed, not pairs."""
    of = F.concat(F.length("name").cast("string"), F.lit(":"), F.expr(f"left(name, length(name) - {BEHIND})"))
    long = nodes.filter(F.length("name").between(BEHIND + 1, ratios.LONG - 1)).withColumn("class", of)
    many = long.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MANY).select("class")
    # of classes there are few to so many names: lists of them may be broadcast, while a class may hold all names
    names = long.join(F.broadcast(many), "class").withColumn("rest", F.expr(f"right(name, {BEHIND})")).withColumn("need", _needed_behind("name"))
    names = scratch.kept(names, "classes-of-names")
    if names.isEmpty():
        return None
    known = names.groupBy("class").agg(F.bool_and(F.col("need").isNotNull() & F.col("need").between(0, BEHIND)).alias("clear")).filter("clear").select("class")
    ends = names.join(F.broadcast(known), "class").select("class", "node", F.expr("left(rest, need)").alias("head"), F.expr("right(rest, need)").alias("tail"))
    least = lambda c: ends.groupBy("class", c).agg(F.min("node").alias(f"{c}_node"))
    edges = scratch.kept(ends.join(least("head"), ["class", "head"]).join(least("tail"), ["class", "tail"]).select("class", "head_node", "tail_node").distinct(), "ends-of-names")
    found = components.components(edges.select(F.col("head_node").alias("a"), F.col("tail_node").alias("b")))
    of = edges.select("class", F.col("head_node").alias("node")).unionByName(edges.select("class", F.col("tail_node").alias("node"))).distinct()
    reached = of.join(found, "node", "left").groupBy("class").agg(F.min(F.coalesce("component", "node")).alias("least"), F.max(F.coalesce("component", "node")).alias("most"))
    return names.join(F.broadcast(reached.filter("least = most").select("class")), "class")


def _links_of_classes(names: DataFrame) -> DataFrame:
    """_classes() -> links as those of blocks: for each name how many of its class it links to, and one link."""
    n = names.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(COUNTED))).cast("long").alias("blocks"), F.min_by("name", "node").alias("least"))
    own = names.join(F.broadcast(n), "class").withColumn("own", F.expr("pmod(xxhash64(name), blocks)"))
    held = F.array_join(F.array_distinct(F.array_sort(F.split("rest", ""))), "")
    part = F.pmod(F.xxhash64(held), F.lit(PARTS)).alias("part")
    asked = own.select("class", "need", part, F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "name", "rest", (F.col("block") == F.col("own")).cast("int").alias("itself"), F.lit(None).cast("string").alias("texts"))
    listed = own.groupBy("class", "need", F.col("own").alias("block")).agg(F.array_join(F.collect_list("rest"), "").alias("texts"))
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    told = listed.select("class", "need", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"), "block", null("string", "name"), null("string", "rest"), null("int", "itself"), "texts")
    dealt = asked.unionByName(told).repartition(4 * names.sparkSession.sparkContext.defaultParallelism, "class", "part", "block")
    counted = dealt.groupBy("class", "part", "block").applyInArrow(_counted, "a string, b string, n long")
    return counted.unionByName(own.filter("name <> least").select(F.col("name").alias("a"), F.col("least").alias("b"), F.lit(0).cast("long").alias("n")))


@lru_cache(maxsize=8)
def _counter(width: int, need: int) -> ratios.Alike:
    return ratios.Alike(width, need)


def _counted(table: pa.Table) -> pa.Table:
    """Rows of names to be counted, and one of the texts of a block: how many of these each is alike to."""
    texts = table.column("texts").drop_null().to_pylist()
    asked = table.filter(pc.is_valid(table.column("name")))
    if not asked.num_rows:
        return pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64())], names=["a", "b", "n"])
    n = _counter(BEHIND, asked.column("need")[0].as_py()).counts(asked.column("rest").to_pylist(), "".join(texts))
    name = asked.column("name").combine_chunks()
    return pa.table([name, pa.nulls(len(name), pa.string()), pa.array(n - asked.column("itself").to_numpy(), pa.int64())], names=["a", "b", "n"])


def name_links(facts: DataFrame) -> DataFrame:
    """prepared facts(id, name) -> (id, name, n_links, component_id), a row for each: how many other
    names have a ratio of 0.8 or more with its own as the first, and the smallest id that such links,
    in either order, lead to, its own included. Facts of one name hang together; blank names link with
    nothing. No pair of names is a row, but for those that span a component. Large classes of names that
    differ in their last characters alone are counted by patterns, not by pairs."""
    nodes = scratch.kept(facts.filter("name <> ''").groupBy("name").agg(F.min("id").alias("node")), "nodes")
    classes = _classes(nodes)
    links = _dealt(facts, facts, classes).groupBy("gram", "block_a", "block_b").applyInArrow(_links_of_blocks, "a string, b string, n long")
    links = scratch.kept(links if classes is None else links.unionByName(_links_of_classes(classes)), "name-links")
    counts = links.groupBy("a").agg(F.sum("n").alias("n_links"))
    named = scratch.kept(nodes.join(counts, F.col("name") == F.col("a"), "left").select("name", "node", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "names")
    end = lambda s: named.select(F.col("name").alias(s), F.col("node").alias(f"{s}_node"))
    edges = links.filter("b is not null").select("a", "b").distinct().join(end("a"), "a").join(end("b"), "b")
    found = components.components(edges.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    classes = named.join(found, "node", "left").select("name", "n_links", F.coalesce("component", "node").alias("of"))
    blank = F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    return facts.select("id", "name").join(classes, "name", "left").select("id", "name", blank, F.coalesce("of", "id").alias("component_id"))


def by_name(new: DataFrame, old: DataFrame) -> DataFrame:
    a, b = new.select(F.col("id").alias("new_id"), F.col("name").alias("a")), old.select(F.col("id").alias("old_id"), F.col("name").alias("b"))
    return a.join(similar_names(new, old), "a").join(b, "b").filter("new_id <> old_id").select("new_id", "old_id")


def candidates(new: DataFrame, old: DataFrame) -> DataFrame:
    """facts(id, entity_name, entity_id, attribute) twice -> (new_id, old_id, criterion)."""
    new, old = prepared(new), prepared(old)
    found = [f(new, old).withColumn("criterion", F.lit(k)) for k, f in enumerate((by_identifier, by_token, by_name), 1)]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("new_id", "old_id").agg(F.min("criterion").alias("criterion"))


def candidate_links(new: DataFrame, old: DataFrame) -> DataFrame:
    """The pairs of candidates(), the same fact included, by class: facts with one
    identifier, attribute or name stand together, and no pair of facts is made.

    facts(id, entity_name, entity_id, attribute) twice -> (criterion, new_class, old_class,
    new_facts, old_facts): a new and an old fact are candidates if their classes are linked
    by any criterion; the last two columns count the facts of a class."""
    def classes(side: DataFrame, by, s: str) -> DataFrame:
        named = side.select(by.alias(f"{s}_class")).filter(F.col(f"{s}_class").isNotNull())
        return named.groupBy(f"{s}_class").agg(F.count(F.lit(1)).alias(f"{s}_facts"))

    def both(by):
        return classes(new, by, "new"), classes(old, by, "old")

    ids_new, ids_old = both(N.identifier(F.col("entity_id")))
    same = ids_new.join(ids_old, F.col("new_class") == F.col("old_class"))
    words_new, words_old = both(F.array_join(F.array_sort(N.attribute_tokens(F.col("attribute"))), " "))
    token = lambda s: F.explode(F.split(f"{s}_class", " ")).alias("token")
    shared = words_new.select("*", token("new")).join(words_old.select("*", token("old")), "token").filter("token <> ''").drop("token").distinct()
    names_new, names_old = both(N.entity_name(F.col("entity_name")))
    near = similar_names(names_new.select(F.col("new_class").alias("name")), names_old.select(F.col("old_class").alias("name")))
    near = near.join(names_new, F.col("a") == F.col("new_class")).join(names_old, F.col("b") == F.col("old_class"))
    kinds = [x.select(F.lit(k).alias("criterion"), "new_class", "old_class", "new_facts", "old_facts") for k, x in enumerate((same, shared, near), 1)]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
