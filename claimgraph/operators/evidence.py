"""Where a quote stands: exactly, or with any white space for white space, or nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions import normalize as N


def loose_pattern(quote: Column) -> Column:
    """A pattern of the quote's words, taken literally, with any white space between them."""
    literal = lambda p: F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.lit("(?U)"), F.array_join(F.transform(F.split(N.strip(quote), r"(?U)\s+"), literal), "\\s+"))


def exact_at(text: Column, quote: Column) -> Column:
    """Code points before the quote, or -1; an empty quote stands nowhere."""
    return F.when(F.length(quote) > 0, F.instr(text, quote) - 1).otherwise(-1)


def loose_at(text: Column, quote: Column) -> Column:
    """As exact_at, by the loose pattern; texts without the quote's first word are not searched."""
    word = F.get(F.split(N.strip(quote), r"(?U)\s+"), F.lit(0))
    return F.when((F.length(N.strip(quote)) > 0) & F.contains(text, word), F.regexp_instr(text, loose_pattern(quote)) - 1).otherwise(-1)


def locate(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quotes(quote_id, key, quote) and pages(key, page_number, text) -> (quote_id,
    page_number, char_offset): the first page with an exact hit, else the first with a hit
    that takes any white space for white space, else the first page with offset -1.
    Offsets count code points from 0. Only quotes without an exact hit are searched again."""
    first = F.min(F.struct("page_number", "at"))
    each = quotes.join(pages, "key").select("quote_id", "page_number", exact_at(F.col("text"), F.col("quote")).alias("at"))
    found = each.groupBy("quote_id").agg(F.min(F.when(F.col("at") >= 0, F.struct("page_number", "at"))).alias("hit"), F.min("page_number").alias("start"))
    left = quotes.join(found.filter("hit is null").select("quote_id", "start"), "quote_id").join(pages, "key")
    left = left.select("quote_id", "start", "page_number", loose_at(F.col("text"), F.col("quote")).alias("at"))
    loose = left.groupBy("quote_id").agg(F.min("start").alias("start"), F.min(F.when(F.col("at") >= 0, F.struct("page_number", "at"))).alias("hit"))
    both = found.filter("hit is not null").select("quote_id", "hit").unionByName(loose.select("quote_id", F.coalesce("hit", F.struct(F.col("start").alias("page_number"), F.lit(-1).alias("at"))).alias("hit")))
    return both.select("quote_id", "hit.page_number", F.col("hit.at").alias("char_offset"))


def locate_facts(facts: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """facts(fact_id, doc, batch, section_path, quote), sections(doc, section_no,
    section_path, batch) and pages(doc, section_no, page_no, page_number, text) ->
    (fact_id, section_path, page_number, char_offset).

    A fact's declared section is the last one of that path; if it is in the fact's batch the
    quote is sought there alone, else in all sections of the batch in order. A section's
    pages are searched exactly and then loosely before the next section's. A quote that
    stands nowhere has the first page of the first section sought, and offset -1."""
    by_path = sections.groupBy("doc", "section_path").agg(F.max_by(F.struct("section_no", "batch"), "section_no").alias("own"))
    named = facts.join(by_path, ["doc", "section_path"], "left").select("fact_id", "doc", "batch", "quote", F.when(F.col("own.batch") == F.col("batch"), F.col("own.section_no")).alias("own_no"))
    sought = named.join(sections.withColumnRenamed("section_path", "path"), ["doc", "batch"]).filter("own_no is null or own_no = section_no")
    each = sought.join(pages, ["doc", "section_no"])
    exact = exact_at(F.col("text"), F.col("quote"))
    each = each.withColumn("e", exact).withColumn("l", F.when(F.col("e") < 0, loose_at(F.col("text"), F.col("quote"))).otherwise(-1))
    way = F.when(F.col("e") >= 0, 0).when(F.col("l") >= 0, 1)
    hit = F.struct("path", "page_number", F.greatest("e", "l").alias("at"))
    best = each.groupBy("fact_id").agg(
        F.min_by(F.when(way.isNotNull(), hit), F.when(way.isNotNull(), F.struct(F.col("section_no"), way.alias("way"), F.col("page_no")))).alias("hit"),
        F.min_by(F.struct("path", "page_number", F.lit(-1).alias("at")), F.struct("section_no", "page_no")).alias("start"),
    )
    return best.select("fact_id", F.coalesce("hit", "start").alias("x")).select("fact_id", F.col("x.path").alias("section_path"), "x.page_number", F.col("x.at").alias("char_offset"))
