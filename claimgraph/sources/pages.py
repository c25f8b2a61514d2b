"""Spans of pages: from web pages, or from the blocks, lines and tables that a reader of
another format gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgraph.sources import uploads

# The flag of bold type, the size that stands for a table, the share of a block that a table must cover.
BOLD_FLAG, TABLE_FONT, COVERED = 16, 0.0, 0.5
#: Elements that begin and end a block of their own.
BLOCKS = "html|head|body|title|nav|header|footer|main|article|section|aside|div|p|ul|ol|li|dl|dt|dd|table|tr|td|th|blockquote|pre|form|h[1-6]"
HIDDEN = "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
#: A tag, whose quoted attributes may hold its end sign; or text, of which a bare < is a piece of its own.
TAG = "</?[a-zA-Z!?](?:[^>\"']+|\"[^\"]*\"|'[^']*')*>"
TOKEN = TAG + "|[^<]+|<"
# Character references by name; those of LOOSE also stand without a semicolon.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "copy": "©", "reg": "®", "middot": "·", "cent": "¢", "pound": "£", "yen": "¥", "sect": "§", "deg": "°", "plusmn": "±",
    "para": "¶", "times": "×", "laquo": "«", "raquo": "»", "frac12": "½", "apos": "'", "euro": "€", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“",
    "rdquo": "”", "bull": "•", "trade": "™",
}
LOOSE = ["amp", "lt", "gt", "quot", "nbsp", "copy", "reg", "middot", "cent", "pound", "yen", "sect", "deg", "plusmn", "para", "times", "laquo", "raquo", "frac12"]
REFERENCE = rf"&(?:{'|'.join(LOOSE)});?|&[a-zA-Z][a-zA-Z0-9]{{1,31}};|&#[0-9]{{1,7}};?|&#[xX][0-9a-fA-F]{{1,6}};?"


def _character(code: Column) -> Column:
    """The character of a code point; what is none becomes U+FFFD."""
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def decoded(text: Column) -> Column:
    """Text with its character references replaced, by name or number; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    name = lambda t: F.regexp_extract(t, "^&([a-zA-Z0-9]+);?$", 1)
    number = lambda t: F.coalesce(F.conv(F.regexp_extract(t, "^&#[xX]([0-9a-fA-F]+)", 1), 16, 10).try_cast("long"), F.regexp_extract(t, "^&#([0-9]+)", 1).try_cast("long"))
    one = lambda t: F.when(t.startswith("&#"), _character(number(t))).when(t.startswith("&"), F.coalesce(F.try_element_at(names, name(t)), t)).otherwise(t)
    parts = F.regexp_extract_all(text, F.lit(f"{REFERENCE}|[^&]+|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def is_bold(flags: Column, font: Column) -> Column:
    """By flag, or by a font whose name says so."""
    return F.coalesce(flags.bitwiseAND(BOLD_FLAG) != 0, F.lit(False)) | F.coalesce(F.lower(font).contains("bold"), F.lit(False))


def html_tokens(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> the texts of all elements, with block, line and look: a
    document is a host, a page one of its urls. A heading's level becomes a font size;
    headings and what stands in b, strong and th are bold, to the end of their block. A block
    ends where another begins or ends, whether its end tag is there or not; character
    references are decoded."""
    visible = F.regexp_replace("html", HIDDEN, "")
    doc = F.regexp_extract("url", "^https?://([^/]+)", 1)
    each = pages.select(doc.alias("doc"), F.col("page_id").alias("page_number"), F.posexplode(F.regexp_extract_all(visible, F.lit(TOKEN.replace(")*>", ")*+>").replace("]+|", "]++|")), F.lit(0))).alias("pos", "tok"))
    tag = F.lower(F.regexp_extract("tok", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    opens = ~F.col("tok").startswith("</")
    each = each.withColumn("tag", F.when(F.col("tok").startswith("<") & (F.col("tok") != "<"), tag))
    so_far = W.partitionBy("doc", "page_number").orderBy("pos")
    new_block, new_line = F.col("tag").rlike(f"^(?:{BLOCKS})$"), F.col("tag") == "br"
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(so_far)
    each = each.withColumn("block_no", count(new_block)).withColumn("line_no", count(new_block | new_line))
    block = W.partitionBy("doc", "page_number", "block_no")
    step = F.when(F.col("tag").isin("b", "strong", "th"), F.when(opens, 1).otherwise(-1)).otherwise(0)
    level = F.max(F.when(opens, F.regexp_extract("tag", "^h([1-6])$", 1).try_cast("int"))).over(block)
    each = each.withColumn("level", level).withColumn("in_bold", F.sum(step).over(block.orderBy("pos")))
    looks = [F.when(F.col("level").isNotNull(), 24.0 - 2 * F.col("level")).otherwise(11.0).alias("font_size"), (F.col("level").isNotNull() | (F.col("in_bold") > 0)).alias("bold")]
    return each.filter("tag is null").select("doc", "page_number", "pos", "block_no", "line_no", decoded(F.col("tok")).alias("text"), *looks)


def with_offsets(spans: DataFrame) -> DataFrame:
    """spans(doc, page_number, pos, block_no, line_no, text, ...): adds char_offset in the
    page's text, which has a line break behind each line and one more behind each block."""
    page = W.partitionBy("doc", "page_number").orderBy("pos")
    before = page.rowsBetween(W.unboundedPreceding, -1)
    rank = lambda c: F.dense_rank().over(W.partitionBy("doc", "page_number").orderBy(c)) - 1
    # lines and blocks are numbered in the order of pos
    return spans.withColumn("char_offset", (F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) + rank("line_no") + rank("block_no")).cast("long"))


def page_texts(spans: DataFrame) -> DataFrame:
    """(doc, page_number, text) of spans with offsets; a page without spans has no row."""
    page = W.partitionBy("doc", "page_number").orderBy("pos")
    last = lambda c: F.coalesce(F.lead(c).over(page) != F.col(c), F.lit(True))
    ended = spans.withColumn("part", F.concat("text", F.when(last("line_no"), "\n").otherwise(""), F.when(last("block_no"), "\n").otherwise("")))
    return ended.groupBy("doc", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("text"))


def tables_of_blocks(blocks: DataFrame, tables: DataFrame, key: list[str]) -> DataFrame:
    """blocks(key, block_no, kind, x0, y0, x1, y1) and tables(key, table_no, x0, ...) of the
    same pages: adds table_no, the first table that covers half of a text block (kind 0) or
    more, or null; and emits, whether it is the block where its table's text stands."""
    side = lambda df, s, names: df.select(*key, *names, *[F.col(c).alias(f"{s}{c}") for c in ("x0", "y0", "x1", "y1")])
    both = side(blocks, "a", ["block_no", "kind"]).join(side(tables, "b", ["table_no"]), key)
    share = uploads.overlap(*[F.col(f"{s}{c}") for s in "ab" for c in ("x0", "y0", "x1", "y1")])
    held = both.filter((F.col("kind") == 0) & (share >= COVERED)).groupBy(*key, "block_no").agg(F.min("table_no").alias("table_no"))
    first = held.groupBy(*key, "table_no").agg(F.min("block_no").alias("block_no")).withColumn("emits", F.lit(True))
    named = held.join(first, [*key, "table_no", "block_no"], "left")
    return blocks.join(named, [*key, "block_no"], "left").withColumn("emits", F.coalesce("emits", F.lit(False)))


def with_tables(spans: DataFrame, assigned: DataFrame, markdown: DataFrame, key: list[str]) -> DataFrame:
    """spans(key, block_no, line_no, pos, text, font_size, bold) with the blocks of tables
    taken out and each table's markdown(key, table_no, text) in the place of its first block,
    as one span; tables without text have none."""
    plain = spans.join(assigned.filter("table_no is not null").select(*key, "block_no"), [*key, "block_no"], "left_anti")
    at = spans.groupBy(*key, "block_no").agg(F.min("pos").alias("pos"), F.min("line_no").alias("line_no"))
    shown = assigned.filter("emits").join(markdown.filter("text <> ''"), [*key, "table_no"]).join(at, [*key, "block_no"])
    return plain.unionByName(shown.select(*key, "block_no", "line_no", "pos", "text", F.lit(TABLE_FONT).alias("font_size"), F.lit(False).alias("bold")))
