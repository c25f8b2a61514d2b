"""Spans, headings and sections of paged documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgraph.functions import normalize as N
from claimgraph.operators.order import next_rows, row_numbers

# Font ratio and length bounds of headings, headings that make a layout, pages of a fallback section.
LARGE, SHORTEST, LONGEST, HEADINGS, PAGES = 1.3, 3, 80, 3, 10


def median_font(spans: DataFrame) -> DataFrame:
    """Of spans with text; white space of any kind is none."""
    bare = F.length(N.strip(F.col("text"))) > 0
    return spans.filter((F.col("font_size") > 0) & bare).groupBy("doc").agg(F.expr("percentile(font_size, 0.5)").alias("median_font"))


def layout_sections(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """spans (as heading_spans, with char_offset) and pages(doc, page_number) -> (doc,
    section_path, start_page, end_page, start_offset) of documents with enough headings: one
    section from each heading to the page before the next. detect_sections adds the texts."""
    numbered = row_numbers(pages.select("doc", "page_number").distinct(), "page_number", "page_no", ["doc"])
    last = numbered.groupBy("doc").agg(F.max("page_no").alias("last_no"))
    found = heading_spans(spans)
    enough = found.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HEADINGS)
    h = next_rows(found.join(numbered, ["doc", "page_number"]), "page_no", ["page_no", "pos"], ["page_no"], ["doc"]).join(last, "doc").join(enough, "doc")
    h = h.withColumn("end_no", F.greatest(F.col("page_no"), F.coalesce(F.col("next.page_no") - 1, F.col("last_no"))))
    ends = numbered.select("doc", F.col("page_no").alias("end_no"), F.col("page_number").alias("end_page"))
    return h.join(ends, ["doc", "end_no"]).select("doc", N.strip(F.col("text")).alias("section_path"), F.col("page_number").alias("start_page"), "end_page", F.col("char_offset").alias("start_offset"))


def fallback_sections(pages: DataFrame, group: int = PAGES) -> DataFrame:
    """pages(doc, page_number) -> groups of pages by their place in the document."""
    grouped = row_numbers(pages, "page_number", "no", ["doc"]).withColumn("g", F.floor((F.col("no") - 1) / group)).groupBy("doc", "g").agg(F.min("page_number").alias("start_page"), F.max("page_number").alias("end_page"))
    return grouped.select("doc", F.format_string("Pages %d-%d", "start_page", "end_page").alias("section_path"), "start_page", "end_page")


def line_key(y0: Column) -> Column:
    """Spans whose tops round to one number, halves to the even one, stand on one line."""
    return F.bround(F.coalesce(y0, F.lit(0.0)), 0)


def heading_spans(spans: DataFrame) -> DataFrame:
    """spans(doc, page_number, pos, line_key, text, font_size, bold, ...): those that are
    larger than the document's median by a ratio, and the bold ones of a heading's length
    that share their line with no other text."""
    bare = F.length(N.strip(F.col("text")))
    on_line = F.sum(F.when(bare > 0, 1).otherwise(0)).over(W.partitionBy("doc", "page_number", "line_key"))
    marked = spans.withColumn("on_line", on_line).filter(bare > 0).join(median_font(spans), "doc", "left")
    large = F.coalesce(F.col("font_size") > F.col("median_font") * LARGE, F.lit(False))
    return marked.filter(large | (F.col("bold") & bare.between(SHORTEST, LONGEST) & (F.col("on_line") == 1))).drop("on_line", "median_font")


def detect_sections(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """spans (as heading_spans, with char_offset) and pages(doc, page_number, text), all
    pages of each document -> (doc, section_path, start_page, end_page, text).

    Documents with enough headings have a section from each heading to the page before the
    next one's, or up to it on the same page; what stands before the first heading, or above
    a heading at whose page no section is open, belongs to none. Others have one for every
    few pages. Pages are counted by their place, as their numbers may jump."""
    numbered = row_numbers(pages.select("doc", "page_number", "text"), "page_number", "page_no", ["doc"])
    places = numbered.drop("text")
    found = heading_spans(spans)
    enough = found.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HEADINGS).select("doc")
    last = places.groupBy("doc").agg(F.max("page_no").alias("last_no"))
    heads = found.select("doc", "page_number", "pos", "text", "char_offset").join(enough, "doc").join(places, ["doc", "page_number"])
    heads = next_rows(heads, "page_no", ["page_no", "pos"], ["page_no", "char_offset"], ["doc"]).join(last, "doc")
    end_no = F.greatest(F.col("page_no"), F.coalesce(F.col("next.page_no") - 1, F.col("last_no")))
    heads = heads.select("doc", N.strip(F.col("text")).alias("section_path"), F.col("page_no").alias("start_no"), "pos", "char_offset", F.when(F.col("next.page_no") == F.col("page_no"), F.col("next.char_offset")).alias("stop"), F.explode(F.sequence("page_no", end_no)).alias("page_no"))
    size = F.coalesce(F.col("stop"), F.length("text").cast("long")) - F.col("char_offset")
    own = F.when(F.col("page_no") == F.col("start_no"), F.substring(F.col("text"), (F.col("char_offset") + 1).cast("int"), size.cast("int"))).otherwise(F.col("text"))
    layout = _joined(heads.join(numbered, ["doc", "page_no"]).withColumn("text", own), ["doc", "start_no", "pos", "section_path"])
    plain = numbered.join(enough, "doc", "left_anti").withColumn("g", F.floor((F.col("page_no") - 1) / PAGES))
    grouped = _joined(plain, ["doc", "g"]).withColumn("section_path", F.format_string("Pages %d-%d", "start_page", "end_page"))
    names = ["doc", "section_path", "start_page", "end_page", "text"]
    return layout.select(*names).unionByName(grouped.select(*names))


def _joined(pages: DataFrame, key: list[str]) -> DataFrame:
    """The texts of a section's pages, with a blank line between them."""
    held = pages.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("page_no", "page_number", "text"))).alias("p"))
    return held.select(*key, F.get("p", F.lit(0))["page_number"].alias("start_page"), F.element_at("p", -1)["page_number"].alias("end_page"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
