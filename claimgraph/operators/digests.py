"""Digests of facts for the judge, cut into chunks of a bounded serialised size.

New facts that fit the budget are repeated in every chunk before a slice of the candidates;
new facts that do not fit alternate with the candidates, and all are packed in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgraph.functions import jsontext
from claimgraph.operators.order import row_numbers
from claimgraph.operators.packing import BLOCK, fold, fold_listed
from claimgraph.sources import scratch

BUDGET = 25_000
LEAST = 2
#: Facts of a document up to which one row holds them all.
SMALL = 256


#: The fields of a fact that the judge sees, in their order (fixed).
FIELDS = ["id", "entity_name", "entity_id", "attribute", "raw_value", "unit", "time_scope", "entity_scope", "verbatim_quote", "confidence"]


def with_json(df: DataFrame, fields: list[str] = FIELDS, name: str = "json") -> DataFrame:
    """Adds the JSON text of the columns fields."""
    return df.withColumn(name, jsontext.record([(c, F.col(c), df.schema[c].dataType) for c in fields]))


def in_order(facts: DataFrame) -> DataFrame:
    """facts(doc_id, is_new, first, id, ...), none of these null: adds ord, from 1 among
    a document's new facts and among its candidates, by first, then id. Groups of one first are numbered apart."""
    by = ["doc_id", "is_new"]
    groups = facts.groupBy(*by, "first").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("first")) - F.col("_n")
    return row_numbers(facts, "id", "ord", [*by, "first"], after=groups.select(*by, "first", before.alias("_after")), nulls=False)


def chunks(facts: DataFrame, budget: int = BUDGET, least: int = LEAST, take: list[str] = [], numbered: bool = False) -> DataFrame:  # noqa: B006
    """facts(doc_id, is_new, ord, size) -> (doc_id, chunk, is_new, ord, place), chunks from 0
    and places in the order of a chunk's facts; the columns take pass. numbered: ord counts a
    document's new facts and its candidates from 1, as in_order gives it.

    The size of the new facts counts list brackets and separators, that of candidates does
    not; the first fact behind the new ones always fits. Chunks of fewer than least facts
    are left out."""
    sized = facts.select("doc_id", "is_new", F.col("ord").cast("long").alias("ord"), F.col("size").cast("long").alias("size"), *take).filter("doc_id is not null")
    many = scratch.kept(sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL).select("doc_id"), "large-documents")
    if many.isEmpty():
        return _whole(sized, budget, least, take)
    few = _whole(sized.join(many.hint("merge"), "doc_id", "left_anti"), budget, least, take)
    return few.unionByName(_in_blocks(sized.join(many.hint("merge"), "doc_id", "left_semi"), budget, least, take, numbered))


def _whole(sized: DataFrame, budget: int, least: int, take: list[str]) -> DataFrame:
    """chunks() of documents of no more than SMALL facts, each a row of its own: one shuffle
    by document, and its facts folded as arrays, without Python."""
    fields = "".join(f", '{c}', x['{c}']" for c in take)
    listed = sized.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((~F.col("is_new")).alias("is_old"), "ord", "size", *take))).alias("facts"))
    placed = lambda side, old: F.expr(f"transform(filter(facts, x -> {side}), (x, i) -> named_struct('place', 2L * (i + 1) + {old}, 'turn', i + 1L, 'is_new', not x.is_old, 'ord', x.ord, 'size', x.size{fields}))")
    sides = listed.select("doc_id", placed("not x.is_old", 0).alias("new"), placed("x.is_old", 1).alias("old"))
    sizes = sides.withColumn("new_size", F.expr("aggregate(new, 0L, (s, x) -> s + x.size) + 2 * greatest(size(new), 1)"))
    bases = sizes.withColumn("fits", F.col("new_size") < budget).withColumn("base", F.expr("if(fits, new_size, 0L)")).withColumn("moving", F.expr("if(fits, old, sort_array(concat(new, old)))"))
    opens = f"(acc.held and acc.used + x.size > {budget}L)"
    step = f"named_struct('chunk', acc.chunk + int({opens}), 'used', if({opens}, base, acc.used) + x.size, 'held', true, 'all', concat(acc.all, array(acc.chunk + int({opens}))))"
    start = "named_struct('chunk', 0, 'used', base, 'held', false, 'all', cast(array() as array<int>))"
    packed = bases.withColumn("chunks", F.expr(f"aggregate(moving, {start}, (acc, x) -> {step}, acc -> acc.all)"))
    row = lambda chunk, place: f"named_struct('chunk', {chunk}, 'is_new', x.is_new, 'ord', x.ord, 'place', {place}{fields})"
    again = f"flatten(transform(sequence(0, coalesce(array_max(chunks), 0)), c -> transform(new, x -> {row('c', f'x.turn - {1 << 40}L')})))"
    rows = packed.select("doc_id", "chunks", F.expr("if(fits, size(new), 0)").alias("fixed"), F.expr(f"concat(zip_with(moving, chunks, (x, c) -> {row('c', 'x.place')}), if(fits, {again}, array()))").alias("rows"))
    kept = rows.select("doc_id", F.expr(f"filter(rows, r -> fixed + size(filter(chunks, c -> c = r.chunk)) >= {least})").alias("rows"))
    # outer: else Spark filters by the rows' number first, and makes them for that many times over
    return kept.select("doc_id", F.inline_outer("rows")).filter("chunk is not null")


def _in_blocks(sized: DataFrame, budget: int, least: int, take: list[str], numbered: bool) -> DataFrame:
    """chunks() of documents of any number of facts, by ranges and blocks of them."""
    new = F.when(F.col("is_new"), F.col("size"))
    totals = sized.groupBy("doc_id").agg((F.coalesce(F.sum(new), F.lit(0)) + 2 * F.greatest(F.count(new), F.lit(1))).alias("new_size"), F.count_if(~F.col("is_new")).alias("n_old"))
    # ranges of the order are numbered apart: no task sorts a document's facts whole
    turns = sized.withColumn("turn", F.col("ord")) if numbered else row_numbers(sized, "ord", "turn", ["doc_id", "is_new"])
    each = turns.withColumn("is_old", ~F.col("is_new")).join(totals, "doc_id").withColumn("fits", F.col("new_size") < budget)
    rows = each.filter("is_old or not fits").select("doc_id", "is_new", "is_old", "ord", "turn", "size", F.when(F.col("fits"), F.col("new_size")).otherwise(0).alias("base"), *take)
    rows = rows.withColumn("place", (2 * F.col("turn") + F.col("is_old").cast("int")).cast("long"))
    packed = fold(rows, "doc_id", "place", budget, counted=True).select("doc_id", F.col("batch").alias("chunk"), "is_new", "ord", "place", *take)
    packed = scratch.kept(packed, "chunks")
    last = packed.groupBy("doc_id").agg(F.max("chunk").alias("last"))
    repeated = each.filter("is_new and fits").join(last, "doc_id", "left")
    again = repeated.select("doc_id", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))).alias("chunk"), "is_new", "ord", (F.col("turn") - (1 << 40)).alias("place"), *take)
    rows = packed.unionByName(again)
    whole = rows.groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")
    return rows.join(whole.hint("merge"), ["doc_id", "chunk"])


def blocks(facts: DataFrame, budget: int = BUDGET) -> DataFrame:
    """facts(doc_id, is_new, ord, size, id), ord from 1 among a document's new facts and among its
    candidates -> (doc_id, _block, base, moving, sizes, fixed), a row for each block of a document's
    places: the (id, is_new) to be packed in order and their sizes, and the new ones that each chunk
    repeats. The facts are dealt once."""
    new = F.when(F.col("is_new"), F.col("size"))
    totals = facts.groupBy("doc_id").agg((F.coalesce(F.sum(new), F.lit(0)) + 2 * F.greatest(F.count(new), F.lit(1))).alias("new_size"))
    bases = totals.select("doc_id", F.when(F.col("new_size") < budget, F.col("new_size")).otherwise(0).cast("long").alias("base"))
    place = (2 * F.col("ord") + (~F.col("is_new")).cast("int")).cast("long")
    rows = facts.filter("doc_id is not null").select("doc_id", place.alias("place"), F.col("size").cast("long").alias("size"), "id")
    rows = rows.withColumn("_block", F.floor(F.col("place") / F.lit(float(BLOCK))).cast("long"))
    # bases come by blocks, as the facts are dealt: not a document's facts to one task
    cells = rows.select("doc_id", "_block").distinct().join(bases.hint("merge"), "doc_id")
    fact, moves = F.struct("place", "size", "id"), (F.col("place") % 2 == 1) | (F.col("base") == 0)
    sorted_ = lambda which: F.sort_array(F.collect_list(F.when(which, fact)))
    listed = rows.join(cells.hint("merge"), ["doc_id", "_block"]).groupBy("doc_id", "_block").agg(F.first("base").alias("base"), sorted_(moves).alias("m"), sorted_(~moves).alias("f"))
    each = lambda c, f: F.transform(c, f)
    # arrays of plain values, as these take the least when they are shuffled
    return listed.select(
        "doc_id", "_block", "base", each("m", lambda x: x["id"]).alias("moving"), each("m", lambda x: x["place"] % 2 == 0).alias("news"),
        each("m", lambda x: x["size"]).alias("sizes"), each("f", lambda x: x["id"]).alias("fixed"),
    )


def listed(blocks: DataFrame, budget: int = BUDGET, least: int = LEAST) -> DataFrame:
    """blocks() -> (doc_id, chunk, ids, news): the chunks of chunks(), a row each, with the ids of
    their facts in order and whether these are new."""
    parts = fold_listed(blocks.filter("size(moving) > 0").select("doc_id", "_block", "base", "sizes", "moving", "news"), "doc_id", "sizes", ["moving", "news"], budget)
    # a chunk that reaches over blocks has a part in each
    held = F.array_sort(F.collect_list(F.struct("_block", "moving", "news")))
    whole = parts.groupBy("doc_id", "batch").agg(F.first("base").alias("base"), held.alias("l"))
    over = lambda c: F.flatten(F.transform("l", lambda b: b[c]))
    whole = scratch.kept(whole.select("doc_id", F.col("batch").alias("chunk"), "base", over("moving").alias("ids"), over("news").alias("news")), "fact-lists", small=True)
    again = blocks.filter("base > 0").groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_block", "fixed"))), lambda b: b["fixed"])).alias("fixed"))
    again = scratch.kept(again, "repeated-facts", small=True)
    both = again.join(whole.filter("base > 0").hint("merge"), "doc_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(whole.schema[c].dataType))
    repeated = both.select("doc_id", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.concat("fixed", none("ids")).alias("ids"), F.concat(F.transform("fixed", lambda x: F.lit(True)), none("news")).alias("news"))
    return whole.filter("base = 0").drop("base").unionByName(repeated).filter(F.size("ids") >= least)
