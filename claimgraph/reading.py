"""Queries from pages and replies to stored facts, with their SQL: spans, sections, facts and
relationships in replies, dates, listings, jobs."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from claimgraph.functions import dates, extract, options
from claimgraph.functions import normalize as N
from claimgraph.operators import digests, evidence, matching, order, packing, prompts, replies, sections, views
from claimgraph.plans import comparison, ledgers
from claimgraph.queries import _FACTS, _TOKENS, query, read
from claimgraph.sources import pages as P
from claimgraph.sources import scratch, store, uploads
from claimgraph.streaming import compare, jobs

REFERENCE = datetime.date(2024, 1, 1)

_QUOTED = P.TOKEN.replace("'", "''")
#: The references that the pages hold.
_DECODED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(tok, '&copy;?', '©', 'g'), '&quot;?', '\"', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g')"
_TOKEN_SQL = f"""tok AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS doc, page_id AS page_number, unnest(range(0, len(t))) AS pos, unnest(t) AS tok
  FROM (SELECT url, page_id, regexp_extract_all(regexp_replace(html, '{P.HIDDEN}', '', 'g'), '{_QUOTED}') AS t FROM pages)),
tag AS (SELECT *, CASE WHEN tok LIKE '<_%' THEN lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) END AS tag FROM tok),
blk AS (SELECT *, sum(CASE WHEN regexp_matches(tag, '^(?:{P.BLOCKS})$') THEN 1 ELSE 0 END) OVER w AS block_no, sum(CASE WHEN regexp_matches(tag, '^(?:{P.BLOCKS})$') OR tag = 'br' THEN 1 ELSE 0 END) OVER w AS line_no
  FROM tag WINDOW w AS (PARTITION BY doc, page_number ORDER BY pos ROWS UNBOUNDED PRECEDING)),
lk AS (SELECT *, max(CASE WHEN tok NOT LIKE '</%' AND regexp_matches(tag, '^h[1-6]$') THEN substr(tag, 2, 1)::INT END) OVER (PARTITION BY doc, page_number, block_no) AS level,
  sum(CASE WHEN tag IN ('b', 'strong', 'th') THEN CASE WHEN tok LIKE '</%' THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY doc, page_number, block_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS in_bold FROM blk),
sp AS (SELECT doc, page_number, pos, block_no, line_no, {_DECODED} AS text, (CASE WHEN level IS NULL THEN 11.0 ELSE 24.0 - 2 * level END)::DOUBLE AS font_size, level IS NOT NULL OR in_bold > 0 AS bold FROM lk WHERE tag IS NULL),
spans AS (SELECT *, (coalesce(sum(length(text)) OVER (PARTITION BY doc, page_number ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + dense_rank() OVER (PARTITION BY doc, page_number ORDER BY line_no) + dense_rank() OVER (PARTITION BY doc, page_number ORDER BY block_no) - 2)::BIGINT AS char_offset FROM sp),
ended AS (SELECT *, text || CASE WHEN coalesce(lead(line_no) OVER w <> line_no, true) THEN chr(10) ELSE '' END || CASE WHEN coalesce(lead(block_no) OVER w <> block_no, true) THEN chr(10) ELSE '' END AS part
  FROM spans WINDOW w AS (PARTITION BY doc, page_number ORDER BY pos)),
pt AS (SELECT doc, page_number, string_agg(part, '' ORDER BY pos) AS text FROM ended GROUP BY 1, 2)"""


def _spans(spark, sf_dir):
    return P.with_offsets(P.html_tokens(read(spark, sf_dir, "pages")))


@query(f"WITH {_TOKEN_SQL} SELECT page_number, pos::INTEGER AS pos, text, font_size, bold, char_offset FROM spans")
def document_spans(spark, sf_dir):
    return _spans(spark, sf_dir).select("page_number", "pos", "text", "font_size", "bold", "char_offset")


@query(f"WITH {_TOKEN_SQL} SELECT doc, page_number, text FROM pt")
def page_texts(spark, sf_dir):
    return P.page_texts(_spans(spark, sf_dir))


_HEAD_SQL = f"""{_TOKEN_SQL},
al AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS doc, page_id AS page_number FROM pages),
pg AS (SELECT al.doc, al.page_number, coalesce(text, '') AS text, row_number() OVER (PARTITION BY al.doc ORDER BY al.page_number) AS page_no FROM al LEFT JOIN pt USING (doc, page_number)),
med AS (SELECT doc, median(font_size) AS m FROM spans WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY doc),
o AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS bare, sum(CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page_number, line_no) AS on_line FROM spans),
h AS (SELECT o.doc, o.page_number, o.pos, o.text, o.char_offset, page_no FROM o JOIN med USING (doc) JOIN pg ON pg.doc = o.doc AND pg.page_number = o.page_number
  WHERE bare <> '' AND (font_size > 1.3 * m OR (bold AND length(trim(o.text, ' ' || chr(10) || chr(9) || chr(13))) BETWEEN 3 AND 80 AND on_line = 1)))"""


@query(f"""WITH {_HEAD_SQL},
hn AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n, lead(page_no) OVER w AS next_no, lead(char_offset) OVER w AS next_at FROM h WINDOW w AS (PARTITION BY doc ORDER BY page_no, pos)),
la AS (SELECT doc, max(page_no) AS last_no FROM pg GROUP BY doc),
parts AS (SELECT hn.doc, trim(hn.text, ' ' || chr(10) || chr(9) || chr(13)) AS section_path, hn.page_no AS start_no, hn.pos, pg.page_no, pg.page_number,
  CASE WHEN pg.page_no > hn.page_no THEN pg.text WHEN next_no = hn.page_no THEN substr(pg.text, char_offset + 1, next_at - char_offset) ELSE substr(pg.text, char_offset + 1) END AS text
  FROM hn JOIN la USING (doc) JOIN pg ON pg.doc = hn.doc AND pg.page_no BETWEEN hn.page_no AND greatest(hn.page_no, coalesce(next_no - 1, last_no)) WHERE n >= 3)
SELECT doc, section_path, min(page_number) AS start_page, max(page_number) AS end_page, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text FROM parts GROUP BY doc, section_path, start_no, pos
UNION ALL
SELECT doc, 'Pages ' || min(page_number) || '-' || max(page_number), min(page_number), max(page_number), string_agg(text, chr(10) || chr(10) ORDER BY page_no)
FROM pg WHERE doc NOT IN (SELECT doc FROM hn WHERE n >= 3) GROUP BY doc, (page_no - 1) // 10""")
def detect_sections(spark, sf_dir):
    """Hosts as documents: those with three headings or more by headings, others by pages."""
    spans, every = _outline(spark, sf_dir)
    texts = every.join(P.page_texts(spans), ["doc", "page_number"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    return sections.detect_sections(spans, texts)


def _outline(spark, sf_dir):
    """Spans with their lines, cut once, and all pages."""
    spans = scratch.kept(_spans(spark, sf_dir).withColumn("line_key", F.col("line_no")), "spans")
    return spans, read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("doc"), F.col("page_id").alias("page_number"))


@query(f"WITH {_HEAD_SQL} SELECT doc, m AS median_font FROM med")
def median_font(spark, sf_dir):
    return sections.median_font(_spans(spark, sf_dir))


@query(f"WITH {_HEAD_SQL} SELECT doc, page_number, pos::INTEGER AS pos, text, char_offset FROM h")
def heading_candidates(spark, sf_dir):
    return sections.heading_spans(_outline(spark, sf_dir)[0]).select("doc", "page_number", "pos", "text", "char_offset")


@query(f"""WITH {_HEAD_SQL},
x AS (SELECT h.*, count(*) OVER (PARTITION BY doc) AS n, lead(page_no) OVER (PARTITION BY doc ORDER BY page_no, pos) AS next_no, (SELECT max(page_no) FROM pg q WHERE q.doc = h.doc) AS last_no FROM h)
SELECT x.doc, trim(x.text, ' ' || chr(10) || chr(9) || chr(13)) AS section_path, x.page_number AS start_page, e.page_number AS end_page, char_offset AS start_offset
FROM x JOIN pg e ON e.doc = x.doc AND e.page_no = greatest(x.page_no, coalesce(next_no - 1, last_no)) WHERE n >= 3""")
def layout_sections(spark, sf_dir):
    return sections.layout_sections(*_outline(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice::DOUBLE / 2, 0) AS line_key FROM lineitem")
def line_keys(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sections.line_key(F.col("l_extendedprice").cast("double") / 2).alias("line_key"))


@query("SELECT p_partkey, (p_size & 16) <> 0 OR contains(lower(p_type), 'tin') AS bold FROM part")
def bold_fonts(spark, sf_dir):
    """A type's metal stands for a font's weight."""
    font = F.replace(F.lower("p_type"), F.lit("tin"), F.lit("Bold"))
    return read(spark, sf_dir, "part").select("p_partkey", P.is_bold(F.col("p_size"), font).alias("bold"))


_RECTS = """r AS (SELECT vec_id // 10 AS page, vec_id % 10 AS no, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS y0, embedding[1]::DOUBLE + abs(embedding[3]::DOUBLE) AS x1, embedding[2]::DOUBLE + abs(embedding[4]::DOUBLE) AS y1, embedding[5]::DOUBLE AS e FROM embeddings),
b AS (SELECT page, no AS block_no, CASE WHEN no = 9 THEN 1 ELSE 0 END AS kind, x0, y0, x1, y1 FROM r),
t AS (SELECT page, no AS table_no, x0 - abs(e) - 0.1::DOUBLE AS x0, y0 - abs(e) - 0.1::DOUBLE AS y0, x1 + abs(e) + 0.1::DOUBLE AS x1, y1 + abs(e) + 0.1::DOUBLE AS y1 FROM r WHERE no < 3)"""


@query(f"""WITH {_RECTS}, j AS (SELECT b.page, block_no, min(table_no) AS table_no FROM b JOIN t USING (page)
  WHERE kind = 0 AND (b.x1 - b.x0) * (b.y1 - b.y0) > 0 AND greatest(least(b.x1, t.x1) - greatest(b.x0, t.x0), 0) * greatest(least(b.y1, t.y1) - greatest(b.y0, t.y0), 0) / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.5 GROUP BY 1, 2)
SELECT b.page, b.block_no, table_no, coalesce(b.block_no = min(CASE WHEN table_no IS NOT NULL THEN b.block_no END) OVER (PARTITION BY b.page, table_no), false) AS emits FROM b LEFT JOIN j USING (page, block_no)""")
def rect_overlap_assign(spark, sf_dir):
    """Ten vectors are a page: their components place its blocks, the first three its tables."""
    x = lambda k: F.col("embedding")[k].cast("double")
    r = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("page"), (F.col("vec_id") % 10).alias("no"), x(0).alias("x0"), x(1).alias("y0"), (x(0) + F.abs(x(2))).alias("x1"), (x(1) + F.abs(x(3))).alias("y1"), F.abs(x(4)).alias("e"))
    blocks = r.select("page", F.col("no").alias("block_no"), F.when(F.col("no") == 9, 1).otherwise(0).alias("kind"), "x0", "y0", "x1", "y1")
    wider = [(F.col(c) - F.col("e") - 0.1 if c.endswith("0") else F.col(c) + F.col("e") + 0.1).alias(c) for c in ("x0", "y0", "x1", "y1")]
    tables = r.filter("no < 3").select("page", F.col("no").alias("table_no"), *wider)
    return P.tables_of_blocks(blocks, tables, ["page"]).select("page", "block_no", "table_no", "emits")


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS no, l_linenumber, l_partkey, l_returnflag, l_linestatus FROM lineitem)
SELECT l_orderkey, '| no | part | flag |' || chr(10) || '| --- | --- | --- |' || string_agg(chr(10) || '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag || '\\|' || l_linestatus END || ' |', '' ORDER BY no) AS text FROM r GROUP BY l_orderkey""")
def order_tables(spark, sf_dir):
    """An order's lines as a table; every third row lacks a cell, the others have one too many."""
    def cells(x):
        some = F.array(x["l_linenumber"].cast("string"), F.concat(F.lit(" "), x["l_partkey"].cast("string")))
        full = F.concat(some, F.array(F.concat(x["l_returnflag"], F.lit("|"), x["l_linestatus"], F.lit(" ")), F.lit("extra")))
        return F.when(x["l_linenumber"] % 3 == 0, some).otherwise(full)

    # rows are collected as they are read, and become texts behind that
    names = ["l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"]
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", *names).repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("r"))
    header = F.array(F.array(F.lit("no "), F.lit("part"), F.lit("flag")))
    # a column of its own, as the text reads it several times
    tables = rows.select("l_orderkey", F.concat(header, F.transform("r", cells)).alias("rows"))
    return tables.select("l_orderkey", uploads.markdown_table(F.col("rows")).alias("text"))


_PERIOD = "struct_pack(period_type := CASE WHEN o_orderkey % 2 = 0 THEN 'span' ELSE 'point_in_time' END"


@query("""SELECT o_orderkey, text, CASE k WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 2 THEN printf('%d-%02d-01', y, m) WHEN 3 THEN CASE WHEN d <= 12 THEN printf('%d-%02d-%02d', y, d, m) ELSE printf('%d-%02d-%02d', y, m, d) END ELSE printf('%d-%02d-%02d', y, m, d) END AS date
FROM (SELECT *, CASE k WHEN 0 THEN d || ' ' || mn || ' ' || y WHEN 1 THEN 'as on ' || mn || ' ' || d || ', ' || y WHEN 2 THEN mn || ' ' || y WHEN 3 THEN printf('%d-%02d-%02d', y, m, d) WHEN 4 THEN d || ' ' || mn || ' 9999' ELSE 'no date at all' END AS text
FROM (SELECT o_orderkey, o_orderkey % 6 AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, monthname(o_orderdate) AS mn FROM orders))""")
def parse_dates(spark, sf_dir):
    """Dates in words and figures. Of figures the day comes first even behind a year."""
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    d, mn, y = F.dayofmonth(at).cast("string"), F.date_format(at, "MMMM"), F.year(at).cast("string")
    text = (
        F.when(k == 0, F.concat_ws(" ", d, mn, y)).when(k == 1, F.concat(F.lit("as on "), mn, F.lit(" "), d, F.lit(", "), y)).when(k == 2, F.concat_ws(" ", mn, y))
        .when(k == 3, F.date_format(at, "yyyy-MM-dd")).when(k == 4, F.concat_ws(" ", d, mn, F.lit("9999"))).otherwise("no date at all")
    )
    df = read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return df.select("o_orderkey", "text", dates.point_in_time(F.col("text"), REFERENCE).alias("date"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, year(o_orderdate) AS y, CASE WHEN o_orderkey % 5 = 0 THEN 'span' ELSE 'point_in_time' END AS period_type, strftime(o_orderdate, '%d ') || monthname(o_orderdate) || strftime(o_orderdate, ' %Y') AS day, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders)
SELECT o_orderkey, period_type, CASE WHEN k = 0 THEN '2001-01-01' WHEN k IN (1, 2) THEN (y - 1) || '-04-01' WHEN period_type = 'span' THEN CASE WHEN k = 3 THEN '' END WHEN k IN (3, 4) THEN iso END AS start,
  CASE WHEN k IN (0, 1) THEN y || '-03-31' WHEN k = 2 THEN '2001-12-31' END AS stop FROM o""")
def fill_time_scope(spark, sf_dir):
    k, at = F.col("o_orderkey") % 6, F.col("o_orderdate")
    fiscal, day = F.concat(F.lit("FY"), F.year(at).cast("string")), F.date_format(at, "dd MMMM yyyy")
    scope = F.struct(
        F.when(F.col("o_orderkey") % 5 == 0, "span").otherwise("point_in_time").alias("period_type"),
        F.when(k == 0, "2001-01-01").when(k == 3, "").alias("start"),
        F.when(k == 2, "2001-12-31").alias("end"),
        F.when(k <= 2, fiscal).when(k == 3, day).when(k == 5, "unclear").alias("label"),
        F.lit(None).cast("string").alias("vintage"),
    )
    df = read(spark, sf_dir, "orders").select("o_orderkey", scope.alias("scope"), F.when(k == 4, day).otherwise("12.5").alias("raw_value"))
    df = dates.with_filled(df, "scope", "raw_value", REFERENCE)
    return df.select("o_orderkey", "scope.period_type", "scope.start", F.col("scope.end").alias("stop"))


_K = "o_orderkey % 9"


@query(f"""SELECT o_orderkey AS reply_id, 0 AS item_no, 'Acme' AS entity_name, 'v' || o_orderkey AS raw_value, 0.5::DOUBLE AS confidence, NULL::VARCHAR AS reject_reason FROM orders
UNION ALL SELECT o_orderkey, 2, 'Acme', CASE WHEN {_K} <> 1 THEN 'v' || o_orderkey END, CASE WHEN {_K} = 7 THEN NULL ELSE 0.75 END,
  CASE {_K} WHEN 1 THEN 'raw_value is no text' WHEN 2 THEN 'missing attribute' WHEN 3 THEN 'time_scope is no object' WHEN 4 THEN 'unknown period_type' WHEN 5 THEN 'entity_id is no text' WHEN 6 THEN 'label is no text' WHEN 7 THEN 'confidence is no number' END FROM orders""")
def parse_fact_json(spark, sf_dir):
    """Replies of a good item, of one that is no object, and of one with a fault of some kind;
    confidence comes as a number's text. One bad item costs no other."""
    k, key = F.col("o_orderkey") % 9, F.col("o_orderkey").cast("string")
    good = F.concat(F.lit('{"entity_name": "Acme", "attribute": "a", "raw_value": "v'), key, F.lit('", "time_scope": {"period_type": "span"}, "verbatim_quote": "q", "confidence": 0.5, "extra": [1]}'))
    other = F.concat(
        F.lit('{"entity_name": "Acme", "entity_id": '), F.when(k == 5, "12").otherwise("null"), F.when(k == 2, "").otherwise(', "attribute": "a"'),
        F.lit(', "raw_value": '), F.when(k == 1, key).otherwise(F.concat(F.lit('"v'), key, F.lit('"'))),
        F.lit(', "time_scope": '), F.when(k == 3, '"FY24"').when(k == 4, '{"period_type": "year"}').when(k == 6, '{"period_type": "span", "label": 24}').otherwise('{"period_type": "span", "label": "FY24", "start": null}'),
        F.lit(', "verbatim_quote": "q", "confidence": '), F.when(k == 7, '"high"').otherwise('"0.75"'), F.lit("}"),
    )
    made = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reply_id"), F.concat(F.lit("```json\n["), good, F.lit(", 5, "), other, F.lit("]\n```")).alias("reply"))
    return replies.facts(replies.items(made)).select("reply_id", "item_no", "entity_name", "raw_value", "confidence", "reject_reason")


@query("""SELECT l_orderkey AS reply_id, l_linenumber AS item, CASE WHEN l_partkey % 3 = 0 THEN 'not in the digest' WHEN l_partkey % 3 = 1 AND l_linenumber % 2 = 0 THEN 'unknown dimension' END AS reject_reason
FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)""")
def hallucinated_ids(spark, sf_dir):
    """An order's reply relates its lines' parts to a fact that was shown; every third names
    one that was not."""
    # dealt by reply once, numbers alone; texts are made behind that
    dealt = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("l_partkey")).repartition("l_orderkey")
    lines = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    shown = lines.groupBy(F.col("l_orderkey").alias("reply_id")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("l"))
    part = lambda x: F.when(x["l_partkey"] % 3 == 0, x["l_partkey"] + 10**9).otherwise(x["l_partkey"])
    dimension = lambda x: F.when((x["l_partkey"] % 3 == 1) & (x["l_linenumber"] % 2 == 0), '"weather"').otherwise('"time"')
    item = lambda x: F.concat(F.lit('{"fact_id_a": '), part(x).cast("string"), F.lit(', "fact_id_b": -1, "relation_type": "reconciled_context", "reconciled_dimension": '), dimension(x), F.lit(', "reasoning_text": "'), x["l_linenumber"].cast("string"), F.lit('", "confidence": 1}'))
    made = shown.select("reply_id", F.concat(F.lit("["), F.array_join(F.transform("l", item), ", "), F.lit("]")).alias("reply"), F.array_append(F.transform("l", lambda x: x["l_partkey"]), F.lit(-1).cast("long")).alias("fact_ids"))
    found = replies.relationships(replies.items(made, ["fact_ids"]))
    return found.select("reply_id", F.try_variant_get("item", "$.reasoning_text", "string").cast("int").alias("item"), "reject_reason")


_CONV = """s AS (SELECT conv_id AS doc, turn AS section_no, 'Turn ' || CASE WHEN turn % 4 = 3 THEN 1 ELSE turn END AS section_path, turn // 4 AS batch, text FROM conversations),
f AS (SELECT doc * 10000 + section_no AS fact_id, doc, batch, section_no, CASE section_no % 3 WHEN 0 THEN section_path WHEN 1 THEN 'Turn 1' END AS section_path,
  CASE WHEN section_no % 5 = 4 THEN 'words that stand nowhere' WHEN section_no % 2 = 0 THEN substr(text, 11, 40) ELSE replace(substr(text, 1, 60), ' ', '  ') END AS quote FROM s)"""


@query(f"""WITH {_CONV}, own AS (SELECT doc, section_path, max(section_no) AS own_no FROM s GROUP BY 1, 2),
n AS (SELECT f.*, CASE WHEN own_no // 4 = f.batch THEN own_no END AS own_no FROM f LEFT JOIN own USING (doc, section_path)),
e AS (SELECT fact_id, s.section_no, s.section_path, instr(text, quote) - 1 AS exact,
    CASE WHEN length(quote) > 0 AND instr(text, quote) = 0 THEN instr(regexp_replace(text, '\\s+', ' ', 'g'), trim(regexp_replace(quote, '\\s+', ' ', 'g'))) - 1 ELSE -1 END AS loose, text, quote
  FROM n JOIN s ON s.doc = n.doc AND s.batch = n.batch AND (own_no IS NULL OR own_no = s.section_no)),
b AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY CASE WHEN exact >= 0 AND length(quote) > 0 THEN 0 WHEN loose >= 0 THEN 0 ELSE 1 END, section_no) AS r FROM e)
SELECT fact_id, section_path, section_no AS page_number, exact >= 0 AND length(quote) > 0 OR loose >= 0 AS found FROM b WHERE r = 1""")
def locate_facts(spark, sf_dir):
    """Turns are sections of one page. Some paths stand twice, some name another batch's
    section; some quotes have other white space, some stand nowhere."""
    turns = read(spark, sf_dir, "conversations")
    path = F.concat(F.lit("Turn "), F.when(F.col("turn") % 4 == 3, 1).otherwise(F.col("turn")).cast("string"))
    s = turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("section_no"), path.alias("section_path"), F.floor(F.col("turn") / 4).cast("long").alias("batch"), "text")
    no = F.col("section_no")
    quote = F.when(no % 5 == 4, "words that stand nowhere").when(no % 2 == 0, F.substring("text", 11, 40)).otherwise(F.replace(F.substring("text", 1, 60), F.lit(" "), F.lit("  ")))
    f = s.select((F.col("doc") * 10000 + no).alias("fact_id"), "doc", "batch", F.when(no % 3 == 0, F.col("section_path")).when(no % 3 == 1, "Turn 1").alias("section_path"), quote.alias("quote"))
    found = evidence.locate_facts(f, s.drop("text"), s.select("doc", "section_no", F.lit(0).alias("page_no"), no.alias("page_number"), "text"))
    return found.select("fact_id", "section_path", "page_number", (F.col("char_offset") >= 0).alias("found"))


@query("""SELECT conv_id, turn, q.quote_no, (instr(text, quote) - 1)::BIGINT AS char_offset FROM (SELECT conv_id, turn, text, unnest(range(0, len(l))) AS quote_no, unnest(l) AS quote FROM (SELECT *, string_split(text, chr(10)) AS l FROM conversations)) q WHERE length(quote) > 0""")
def locate_every_line(spark, sf_dir):
    """Each line of each turn, sought in its turn."""
    turns = read(spark, sf_dir, "conversations")
    lines = turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("quote_no", "quote")).filter("quote <> ''")
    ids = F.struct("conv_id", "turn", "quote_no").alias("quote_id")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key")
    found = evidence.locate(lines.select(ids, key, "quote"), turns.select(key, F.col("turn").alias("page_number"), "text"))
    return found.select("quote_id.conv_id", "quote_id.turn", F.col("quote_id.quote_no").cast("long").alias("quote_no"), F.col("char_offset").cast("long").alias("char_offset"))


@query("""WITH i AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n_chars FROM conversations)
SELECT conv_id, turn, 0 AS batch FROM i QUALIFY sum(n_chars) OVER (PARTITION BY conv_id) <= 12000""")
def batch_sections_default(spark, sf_dir):
    """At the default budget; conversations that fit it as a whole, which SQL can tell."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    whole = turns.groupBy("conv_id").agg(F.sum("n_chars").alias("n")).filter(F.col("n") <= packing.BATCH_CHARS).select("conv_id")
    return packing.next_fit(turns, "conv_id", "turn", "n_chars").join(whole, "conv_id").select("conv_id", "turn", "batch")


@query("""SELECT conv_id, string_agg('=== SECTION: ' || role || ' ' || turn || ' ===' || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS block FROM conversations GROUP BY conv_id""")
def prompt_blocks(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("section_path", F.concat_ws(" ", "role", F.col("turn").cast("string")))
    return prompts.section_blocks(turns, ["conv_id"], "turn")


@query(f"""WITH {_FACTS}, t AS (SELECT id, label || ': revenue from operations was ' || raw_value || CASE WHEN unit = 'Lakh' THEN ' Lakh' ELSE '' END || '. Customers of 3 or more are ' || entity_scope AS text FROM facts)
SELECT id, item_no, lower(regexp_replace(trim(regexp_extract(q, '{extract.RULE}', 1)), '[ -]+', '_', 'g')) AS attribute, regexp_extract(q, '{extract.RULE}', 2) AS raw_value, nullif(regexp_extract(q, '{extract.RULE}', 3), '') AS unit, q AS verbatim_quote
FROM (SELECT id, unnest(range(0, len(m)))::INTEGER AS item_no, unnest(m) AS q FROM (SELECT id, regexp_extract_all(text, '{extract.RULE}') AS m FROM t))""")
def extract_facts(spark, sf_dir):
    """The stand-in for a model reads sections that state a ledger's figures in words."""
    f = ledgers.ledger_facts(spark, sf_dir)
    text = F.concat("label", F.lit(": revenue from operations was "), "raw_value", F.when(F.col("unit") == "Lakh", " Lakh").otherwise(""), F.lit(". Customers of 3 or more are "), "entity_scope")
    found = extract.facts(f.select(F.col("id").alias("doc"), F.col("label").alias("section_path"), text.alias("text"), "entity_name"))
    return found.select(F.col("doc").alias("id"), "item_no", "attribute", "raw_value", "unit", "verbatim_quote")


_SCOPED = f"""sc AS (SELECT id, entity_name, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE entity_id END AS entity_id, 'revenue' AS attribute, raw_value, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE unit END AS unit,
  struct_pack(period_type := 'span', "start" := NULL::VARCHAR, "end" := NULL::VARCHAR, label := CASE WHEN o_custkey % 3 = 0 THEN '' ELSE label END, vintage := NULL::VARCHAR) AS time_scope,
  CASE WHEN o_custkey % 2 = 0 THEN entity_scope END AS entity_scope, 'q' AS verbatim_quote, (o_custkey % 100)::DOUBLE / 100 AS confidence FROM facts)"""


def _scoped(spark, sf_dir):
    f = ledgers.ledger_facts(spark, sf_dir)
    c = F.floor(F.col("id") / 10000).cast("long")
    null = F.lit(None).cast("string")
    scope = F.struct(F.lit("span").alias("period_type"), null.alias("start"), null.alias("end"), F.when(c % 3 == 0, "").otherwise(F.col("label")).alias("label"), null.alias("vintage"))
    return f.select(
        "id", "entity_name", F.when(c % 7 == 0, "").otherwise(F.col("entity_id")).alias("entity_id"), F.lit("revenue").alias("attribute"), "raw_value", F.when(c % 5 != 0, F.col("unit")).alias("unit"),
        scope.alias("time_scope"), F.when(c % 2 == 0, F.col("entity_scope")).alias("entity_scope"), F.lit("q").alias("verbatim_quote"), ((c % 100).cast("double") / 100).alias("confidence"),
    )


@query(f"""WITH {_FACTS}, {_SCOPED} SELECT id, entity_name, attribute, raw_value || CASE WHEN unit IS NULL THEN '' ELSE ' ' || unit END AS "value", CASE WHEN time_scope.label = '' THEN 'span' ELSE time_scope.label END AS period,
  coalesce(entity_scope, '—') AS entity_scope, CASE WHEN entity_id = '' THEN '—' ELSE entity_id END AS entity_id, printf('%.2f', confidence) AS confidence, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'moderate' ELSE 'low' END AS band FROM sc""")
def fact_listing(spark, sf_dir):
    """An empty name filters nothing."""
    return views.listed(_scoped(spark, sf_dir), "")


@query(f"WITH {_FACTS}, {_SCOPED} SELECT id, to_json(sc)::VARCHAR AS digest FROM (SELECT id, entity_name, entity_id, attribute, raw_value, unit, time_scope, entity_scope, verbatim_quote, confidence FROM sc) sc")
def fact_digests(spark, sf_dir):
    return views.digest(_scoped(spark, sf_dir))


@query(f"WITH {_FACTS}, {_SCOPED} SELECT id, time_scope.label AS label, time_scope.period_type AS period_type, to_json(time_scope)::VARCHAR AS scope FROM sc")
def time_scope_json(spark, sf_dir):
    """A scope as text, and read from it again."""
    text = store.scope_text(F.col("time_scope"))
    df = _scoped(spark, sf_dir).select("id", text.alias("scope")).withColumn("s", store.scope_of(F.col("scope")))
    return df.select("id", "s.label", "s.period_type", "scope")


@query(f"WITH {_FACTS} SELECT fact_id_a, fact_id_b FROM edges WHERE relation_type = 'contradicts' AND (fact_id_a IN (SELECT id FROM facts WHERE o_custkey % 10 = 0) OR fact_id_b IN (SELECT id FROM facts WHERE o_custkey % 10 = 0))")
def relationships_of_facts(spark, sf_dir):
    """Contradictions with an end among the facts of some customers."""
    f = ledgers.ledger_facts(spark, sf_dir)
    edges = ledgers.reconcile(f).select("fact_id_a", "fact_id_b", "relation_type")
    chosen = f.filter(F.floor(F.col("id") / 10000) % 10 == 0).select("id")
    return views.relationships(edges, chosen, "contradicts").select("fact_id_a", "fact_id_b")


@query(f"""WITH {_FACTS} SELECT e.fact_id_a, e.fact_id_b, a.raw_value AS raw_value_a, b.raw_value AS raw_value_b
FROM edges e LEFT JOIN (SELECT * FROM facts WHERE o_custkey % 3 <> 0) a ON a.id = fact_id_a LEFT JOIN (SELECT * FROM facts WHERE o_custkey % 3 <> 0) b ON b.id = fact_id_b""")
def relationship_detail_left(spark, sf_dir):
    """Facts that are gone leave nulls."""
    f = ledgers.ledger_facts(spark, sf_dir)
    there = f.filter(F.floor(F.col("id") / 10000) % 3 != 0)
    return views.relationship_detail(ledgers.reconcile(f), there).select("fact_id_a", "fact_id_b", "raw_value_a", "raw_value_b")


@query(f"WITH {_FACTS} SELECT id, raw_value FROM facts WHERE id = (SELECT min(id) FROM facts)")
def fact_by_id(spark, sf_dir):
    f = ledgers.ledger_facts(spark, sf_dir)
    return store.by_id(f, f.agg(F.min("id")).first()[0]).select("id", "raw_value")


@query(f"WITH {_FACTS} SELECT row_number() OVER (ORDER BY id) AS place, id, raw_value FROM facts")
def facts_in_order(spark, sf_dir):
    """Lists come in the order of their ids; here with the place of each."""
    f = ledgers.ledger_facts(spark, sf_dir).select("id", "raw_value")
    return order.row_numbers(f, "id", "place").select(F.col("place").cast("long").alias("place"), "id", "raw_value").orderBy("id")


@query("SELECT o_orderkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders")
def append_ids(spark, sf_dir):
    """Orders as new facts behind the customers' ids."""
    last = read(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    return store.with_ids(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", last or 0).select("o_orderkey", "id")


@query(f"""WITH p AS (SELECT p_partkey, {_TOKENS.format('p_name')} AS tokens FROM part), t AS (SELECT p_partkey, unnest(tokens) AS token FROM p)
SELECT b.p_partkey AS old_id, min(a.p_partkey) AS first_new_id FROM t a JOIN t b USING (token) WHERE a.p_partkey % 50 = 7 AND b.p_partkey % 50 <> 7 GROUP BY 1""")
def candidate_union(spark, sf_dir):
    """Some parts are new facts; the others that share a word with any of them."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("").alias("entity_name"), F.lit(None).cast("string").alias("entity_id"), F.col("p_name").alias("attribute"))
    new = p.filter("id % 50 = 7")
    found = comparison.candidates(new.withColumn("doc_id", F.lit(1)), p)
    return found.select(F.col("id").alias("old_id"), "first_new_id")


@query(f"WITH {_FACTS} SELECT a.id AS new_id, b.id AS old_id FROM facts a JOIN facts b ON a.entity_id = b.entity_id AND a.id <> b.id WHERE b.document_id <= a.document_id")
def incremental_candidates(spark, sf_dir):
    """Documents in order: each is compared with itself and with those before it."""
    f = ledgers.ledger_facts(spark, sf_dir)
    # the documents' order stands with the key, so that no pair is shuffled
    side = lambda s: f.select(N.identifier(F.col("entity_id")).alias("key"), F.col("id").alias(f"{s}_id"), F.col("document_id").alias(f"{s}_order"))
    pairs = side("new").join(side("old").hint("merge"), "key").filter("new_id <> old_id")
    return compare.visible(pairs).select("new_id", "old_id")


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' , ,' || p_type, ','), lambda k: trim(k)), lambda k: k <> ''), '|') AS keys, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE p_size END AS n FROM part")
def option_lists(spark, sf_dir):
    csv = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" , ,"), "p_type"))
    single = F.concat(F.lit(" "), "p_name", F.lit(" "))
    number = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_size").cast("string"))
    kept = options.keys(csv, single)
    whole = F.when(F.size(kept) == 1, F.concat(kept, F.array(F.col("p_type")))).otherwise(kept)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(whole, "|").alias("keys"), options.whole_number(number, 4).alias("n"))


_JOBS = """b AS (SELECT user_id AS job_id, min(event_id) AS began FROM events GROUP BY 1),
ev AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_id % 30 = 29 THEN CASE WHEN event_id % 60 = 29 THEN 'completed' ELSE 'failed' END ELSE (['stage', 'stage', 'result', 'error', 'current', 'noise'])[(event_id % 6 + 1)::INT] END AS kind,
  (event_id % 5 - 1)::INT AS file_no, (['parsing', 'sectioning', 'extracting'])[(event_id % 3 + 1)::INT] AS stage, event_type AS value, CASE WHEN event_id % 4 = 0 THEN 'batch ' || event_id % 7 || '/7' END AS detail
  FROM events JOIN b ON user_id = job_id AND event_id > began),
fl AS (SELECT job_id, unnest([0, 1, 2]) AS file_no FROM b),
st AS (SELECT fl.job_id, fl.file_no, arg_max(CASE kind WHEN 'result' THEN 'done' WHEN 'error' THEN 'failed' ELSE stage END, seq) AS stage, arg_max(CASE WHEN kind = 'stage' THEN coalesce(detail, '') ELSE '' END, seq) AS detail,
  arg_max(value, seq) FILTER (kind = 'error') AS error, arg_max(value, seq) FILTER (kind = 'result') AS result
  FROM fl LEFT JOIN (SELECT * FROM ev WHERE kind IN ('stage', 'result', 'error')) e ON e.job_id = fl.job_id AND e.file_no = fl.file_no GROUP BY 1, 2),
files AS (SELECT job_id, file_no, 'f' || file_no || '.pdf' AS filename, coalesce(stage, 'queued') AS stage, CASE WHEN detail <> '' THEN detail END AS stage_detail, error, result FROM st)"""


def _log(spark, sf_dir):
    """A user's first event creates a job of three files, the others happen to it."""
    e = read(spark, sf_dir, "events")
    n = F.col("event_id")
    names = e.groupBy(F.col("user_id").alias("job_id")).agg(F.min("event_id").alias("seq"))
    created = names.select("job_id", "seq", F.lit("created").alias("kind"), F.lit(None).cast("int").alias("file_no"), F.lit("f0.pdf,f1.pdf,f2.pdf").alias("value"), F.lit(None).cast("string").alias("detail"))
    kind = F.when(n % 30 == 29, F.when(n % 60 == 29, "completed").otherwise("failed")).otherwise(F.element_at(F.array(*[F.lit(k) for k in ("stage", "stage", "result", "error", "current", "noise")]), (n % 6 + 1).cast("int")))
    stage = F.element_at(F.array(*[F.lit(s) for s in ("parsing", "sectioning", "extracting")]), (n % 3 + 1).cast("int"))
    told = e.withColumn("kind", kind).select(F.col("user_id").alias("job_id"), n.alias("seq"), "kind", (n % 5 - 1).cast("int").alias("file_no"), F.when(F.col("kind") == "stage", stage).otherwise(F.col("event_type")).alias("value"), F.when(n % 4 == 0, F.concat(F.lit("batch "), (n % 7).cast("string"), F.lit("/7"))).alias("detail"))
    return created.unionByName(told.join(names.select("job_id", "seq"), ["job_id", "seq"], "left_anti"))


@query(f"WITH {_JOBS} SELECT * FROM files")
def job_files(spark, sf_dir):
    return jobs.files(_log(spark, sf_dir))


@query(f"""WITH {_JOBS}, j AS (SELECT b.job_id, coalesce(arg_max(kind, seq) FILTER (kind IN ('completed', 'failed')), 'running') AS status, coalesce(arg_max(file_no, seq) FILTER (kind = 'current'), 0) AS current_file_index, arg_max(value, seq) FILTER (kind = 'failed') AS error FROM b LEFT JOIN ev USING (job_id) GROUP BY 1),
l AS (SELECT job_id, list(struct_pack(filename, stage, stage_detail, error, result) ORDER BY file_no) AS files FROM files GROUP BY 1)
SELECT job_id, to_json(struct_pack(job_id, status, current_file_index, total_files := 3, error, files))::VARCHAR AS payload FROM (SELECT j.*, files FROM j JOIN l USING (job_id))""")
def job_payloads(spark, sf_dir):
    return jobs.payloads(_log(spark, sf_dir))


@query("SELECT count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS failed, coalesce(sum(event_id % 11) FILTER (event_type <> 'error'), 0)::BIGINT AS n_facts, coalesce(sum(event_id % 3) FILTER (event_type <> 'error'), 0)::BIGINT AS n_relationships FROM events")
def batch_totals(spark, sf_dir):
    """Events as files that a batch went through."""
    n = F.col("event_id")
    return jobs.totals(read(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "failed").alias("error"), (n % 11).alias("n_facts"), (n % 3).alias("n_relationships")))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type AS stage, count(*) AS n FROM events GROUP BY 1, 2")
def stage_counts(spark, sf_dir):
    """By hour (an extra: event time is no part of the engine's own work)."""
    return jobs.stage_counts(read(spark, sf_dir, "events").select("ts", F.col("event_type").alias("stage"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, max(l_partkey) AS size, l_linenumber % 2 = 1 AS is_new FROM lineitem GROUP BY 1, 2),
t AS (SELECT doc_id, coalesce(sum(size) FILTER (is_new), 0) + 2 * greatest(count(*) FILTER (is_new), 1) AS new_size FROM s GROUP BY 1),
m AS (SELECT s.*, new_size < 3000 AS fits, CASE WHEN new_size < 3000 THEN new_size ELSE 0 END AS base, row_number() OVER (PARTITION BY doc_id, is_new ORDER BY ord) AS turn FROM s JOIN t USING (doc_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, NOT is_new) AS r FROM m WHERE NOT is_new OR NOT fits),
w AS (SELECT doc_id, ord, is_new, r, 0 AS chunk, base + size AS used, base FROM i WHERE r = 1
  UNION ALL SELECT i.doc_id, i.ord, i.is_new, i.r, CASE WHEN w.used + i.size > 3000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.used + i.size > 3000 THEN i.base + i.size ELSE w.used + i.size END, i.base FROM w JOIN i ON i.doc_id = w.doc_id AND i.r = w.r + 1),
la AS (SELECT doc_id, max(chunk) AS last FROM w GROUP BY 1),
a AS (SELECT doc_id, chunk, is_new, ord FROM w UNION ALL SELECT doc_id, unnest(range(0, coalesce(last, 0) + 1)), is_new, ord FROM m LEFT JOIN la USING (doc_id) WHERE is_new AND fits)
SELECT doc_id, chunk::INTEGER AS chunk, is_new, ord::BIGINT AS ord FROM a QUALIFY count(*) OVER (PARTITION BY doc_id, chunk) >= 2""")
def digest_chunks(spark, sf_dir):
    """An order's lines: the odd ones are new facts, the even ones candidates."""
    # dealt by order once: what follows groups by it
    dealt = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey")
    lines = dealt.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).agg(F.max("l_partkey").alias("size"))
    return digests.chunks(lines.withColumn("is_new", F.col("ord") % 2 == 1), budget=3000).drop("place")


@query(f"""WITH c AS (SELECT array_to_string(list_sort({_TOKENS.format('p_name')}), ' ') AS attribute, count(*) AS n FROM part GROUP BY 1),
t AS (SELECT attribute, n, unnest(string_split(attribute, ' ')) AS token FROM c),
i AS (SELECT 'ID ' || p_partkey % 50 AS k, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT 1 AS criterion, k AS new_class, k AS old_class, n AS new_facts, n AS old_facts FROM i
UNION ALL SELECT DISTINCT 2, a.attribute, b.attribute, a.n, b.n FROM t a JOIN t b USING (token) WHERE token <> ''""")
def candidate_links_two(spark, sf_dir):
    """The links of the first two criteria; the third has no SQL, and a test of its own."""
    p = read(spark, sf_dir, "part")
    f = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("entity_name"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("id "), (F.col("p_partkey") % 50).cast("string"))).alias("entity_id"), F.col("p_name").alias("attribute"))
    return matching.candidate_links(f, f).filter("criterion < 3")


@query("SELECT l_orderkey, l_linenumber, l_partkey, (regexp_matches(l_returnflag, '^[AR]$') AND l_linenumber % 4 < 2) AS looks FROM lineitem")
def looks_like_date(spark, sf_dir):
    """Figures in three parts, and words that begin as a month does, look like dates."""
    k, n = F.col("l_linenumber") % 4, F.col("l_partkey").cast("string")
    text = F.when(F.col("l_returnflag") == "N", n).when(k == 0, F.concat(F.lit("3/4/"), F.lit("2020"))).when(k == 1, F.concat(F.lit("in a declining market "), n)).otherwise(F.concat(F.lit("demand "), n))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.looks_like_date(text).alias("looks"))


@query(f"WITH {_FACTS} SELECT id, entity_name FROM facts WHERE contains(lower(entity_name), 'customer 2')")
def facts_by_attribute(spark, sf_dir):
    """Both names given: they hold together."""
    f = ledgers.ledger_facts(spark, sf_dir)
    return views.facts(f, entity_name="Customer 2", attribute="Revenue_FROM").select("id", "entity_name")


@query("""WITH e AS (SELECT o_orderkey, o_custkey % 50 AS a, o_orderkey % 50 AS b FROM orders), k AS (SELECT DISTINCT l_partkey % 50 AS a, l_suppkey % 50 AS b FROM lineitem WHERE l_linenumber = 1)
SELECT o_orderkey, EXISTS (SELECT 1 FROM k WHERE (k.a = e.a AND k.b = e.b) OR (k.a = e.b AND k.b = e.a)) AS known FROM e""")
def pairs_known(spark, sf_dir):
    """Whether a pair is there in either orientation."""
    pair = lambda a, b: (F.col(a) % 50, F.col(b) % 50)
    a, b = pair("o_custkey", "o_orderkey")
    edges = read(spark, sf_dir, "orders").select("o_orderkey", a.alias("fact_id_a"), b.alias("fact_id_b"))
    a, b = pair("l_partkey", "l_suppkey")
    known = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(a.alias("fact_id_a"), b.alias("fact_id_b"))
    return replies.with_known(edges, known).select("o_orderkey", "known")


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderkey % 9000 + 200 AS size, o_orderkey % 4 = 0 AS is_new FROM orders),
t AS (SELECT doc_id, coalesce(sum(size) FILTER (is_new), 0) + 2 * greatest(count(*) FILTER (is_new), 1) AS new_size FROM s GROUP BY 1),
m AS (SELECT s.*, new_size < 25000 AS fits, CASE WHEN new_size < 25000 THEN new_size ELSE 0 END AS base, row_number() OVER (PARTITION BY doc_id, is_new ORDER BY ord) AS turn FROM s JOIN t USING (doc_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, NOT is_new) AS r FROM m WHERE NOT is_new OR NOT fits),
w AS (SELECT doc_id, ord, is_new, r, 0 AS chunk, base + size AS used, base FROM i WHERE r = 1
  UNION ALL SELECT i.doc_id, i.ord, i.is_new, i.r, CASE WHEN w.used + i.size > 25000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.used + i.size > 25000 THEN i.base + i.size ELSE w.used + i.size END, i.base FROM w JOIN i ON i.doc_id = w.doc_id AND i.r = w.r + 1),
la AS (SELECT doc_id, max(chunk) AS last FROM w GROUP BY 1),
a AS (SELECT doc_id, chunk, is_new, ord FROM w UNION ALL SELECT doc_id, unnest(range(0, coalesce(last, 0) + 1)), is_new, ord FROM m LEFT JOIN la USING (doc_id) WHERE is_new AND fits)
SELECT doc_id, chunk::INTEGER AS chunk, is_new, ord FROM a QUALIFY count(*) OVER (PARTITION BY doc_id, chunk) >= 2""")
def digest_chunks_default(spark, sf_dir):
    """At the default budget: a customer's orders as facts, every fourth a new one."""
    k = F.col("o_orderkey")
    facts = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (k % 4 == 0).alias("is_new"), k.alias("ord"), (k % 9000 + 200).alias("size"))
    return digests.chunks(facts).drop("place")


@query("SELECT page_id, CASE WHEN length(html) * 20000 > 52428800 THEN 'too large' WHEN page_id % 3 = 0 THEN 'must be a PDF' END AS error FROM pages")
def upload_gate_default(spark, sf_dir):
    """At the default limit; here the path tells the type."""
    path = F.when(F.col("page_id") % 3 == 0, "page.html").otherwise("Page.PDF")
    return read(spark, sf_dir, "pages").select("page_id", uploads.gate(path, F.lit(None).cast("string"), F.length("html").cast("long") * 20000).alias("error"))
