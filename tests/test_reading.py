"""Pages, sections, replies, the store and the stream."""

import json

from claimgraph.operators import replies, sections
from claimgraph.sources import pages, store
from claimgraph.streaming import compare, jobs
from pyspark.sql import functions as F

SPAN = "doc string, page_number int, pos int, line_key double, text string, char_offset long, font_size double, bold boolean"


def paged(layout):
    """{page_number: [(text, font_size, bold)]} of one document -> spans and pages; every
    span has a line."""
    spans, texts = [], []
    for number, parts in layout.items():
        at = 0
        for k, (text, size, bold) in enumerate(parts):
            spans.append(("d", number, k, 20.0 * k, text, at, size, bold))
            at += len(text) + 1
        texts.append(("d", number, "".join(t + "\n" for t, _, _ in parts)))
    return spans, texts


def detected(spark, layout):
    spans, texts = paged(layout)
    found = sections.detect_sections(spark.createDataFrame(spans, SPAN), spark.createDataFrame(texts, "doc string, page_number int, text string"))
    return sorted((tuple(r)[1:] for r in found.collect()), key=lambda r: (r[1], r[2], r[0]))


HEAD, BODY = lambda t: (t, 18.0, True), lambda t: (t, 11.0, False)


def test_sections_by_headings(spark):
    """Numbers jump; two headings share a page; what stands above a first heading is lost."""
    layout = {1: [BODY("lost"), HEAD("Aims"), BODY("a")], 2: [BODY("b")], 40: [BODY("above"), HEAD("Means"), BODY("c"), HEAD("Ends"), BODY("d")], 41: [BODY("e")]}
    assert detected(spark, layout) == [("Aims", 1, 2, "Aims\na\n\n\nb\n"), ("Means", 40, 40, "Means\nc\n"), ("Ends", 40, 41, "Ends\nd\n\n\ne\n")]


def test_bold_words_in_lines_are_no_headings(spark):
    spans, texts = paged({k: [BODY("text of a page")] for k in range(1, 4)})
    inline = [("d", k, 9, 0.0, "bold word", 0, 11.0, True) for k in range(1, 4)]
    found = sections.detect_sections(spark.createDataFrame(spans + inline, SPAN), spark.createDataFrame(texts, "doc string, page_number int, text string")).collect()
    assert [(r.section_path, r.text) for r in found] == [("Pages 1-3", "\n\n".join(["text of a page\n"] * 3))]
    alone = [("d", k, 9, 99.0, "bold words", 0, 11.0, True) for k in range(1, 4)]
    found = sections.detect_sections(spark.createDataFrame(spans + alone, SPAN), spark.createDataFrame(texts, "doc string, page_number int, text string")).collect()
    assert {r.section_path for r in found} == {"bold words"} and len(found) == 3


def test_sections_by_pages(spark):
    numbers = [1, 2, 3, *range(47, 56)]
    assert [r[:3] for r in detected(spark, {n: [BODY("x")] for n in numbers})] == [("Pages 1-53", 1, 53), ("Pages 54-55", 54, 55)]
    empty = spark.createDataFrame([], SPAN)
    blank = sections.detect_sections(empty, spark.createDataFrame([("d", 1, ""), ("d", 2, "")], "doc string, page_number int, text string")).collect()
    assert [tuple(r) for r in blank] == [("d", "Pages 1-2", 1, 2, "\n\n")]
    assert sections.detect_sections(empty, spark.createDataFrame([], "doc string, page_number int, text string")).count() == 0


def test_spans_stand_where_they_say(spark):
    html = "<html><title>t</title><body><h2 class=x>Head <em>line</em></h2><p>one<br>two <b>bold</b></p><!-- no --><script>no()</script><ul><li>item</ul></body>"
    d = spark.createDataFrame([(1, "http://h.example/a", html), (2, "http://h.example/b", "")], "page_id int, url string, html string")
    spans = pages.with_offsets(pages.html_tokens(d))
    text = {r.page_number: r.text for r in pages.page_texts(spans).collect()}
    rows = spans.orderBy("pos").collect()
    assert all(text[r.page_number][r.char_offset :].startswith(r.text) for r in rows)
    assert text == {1: "t\n\nHead line\n\none\ntwo bold\n\nitem\n\n"}
    assert [(r.text, r.font_size, r.bold) for r in rows if r.bold] == [("Head ", 20.0, True), ("line", 20.0, True), ("bold", 11.0, True)]


def test_tables_stand_in_the_place_of_their_first_block(spark):
    box = "page int, {} int, kind int, x0 double, y0 double, x1 double, y1 double"
    blocks = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 9.0, 1.0), (1, 1, 0, 0.0, 2.0, 9.0, 3.0), (1, 2, 0, 0.0, 3.0, 9.0, 4.0), (1, 3, 1, 0.0, 2.0, 9.0, 3.0), (1, 4, 0, 0.0, 9.0, 0.0, 9.0)], box.format("block_no"))
    tables = spark.createDataFrame([(1, 0, 0, 0.0, 2.5, 9.0, 4.0), (1, 1, 0, 0.0, 2.0, 9.0, 4.0)], box.format("table_no")).drop("kind")
    assigned = pages.tables_of_blocks(blocks, tables, ["page"])
    assert {(r.block_no, r.table_no, r.emits) for r in assigned.collect()} == {(0, None, False), (1, 0, True), (2, 0, False), (3, None, False), (4, None, False)}
    spans = spark.createDataFrame([(1, k, k, k, f"block {k}", 11.0, False) for k in range(5)], "page int, block_no int, line_no int, pos int, text string, font_size double, bold boolean")
    shown = pages.with_tables(spans, assigned, spark.createDataFrame([(1, 0, "| a |")], "page int, table_no int, text string"), ["page"])
    assert [(r.pos, r.text, r.font_size) for r in shown.orderBy("pos").collect()] == [(0, "block 0", 11.0), (1, "| a |", 0.0), (3, "block 3", 11.0), (4, "block 4", 11.0)]


def test_items_of_replies(spark):
    fact = {"entity_name": "A", "attribute": "b", "raw_value": "1", "time_scope": {"period_type": "span", "end": None}, "verbatim_quote": "q", "confidence": True}
    rows = [(1, json.dumps([fact, 3, {**fact, "unit": 4}])), (2, "no json"), (3, json.dumps(fact)), (4, "```\n[]\n```"), (5, None), (6, json.dumps([{**fact, "time_scope": {"period_type": "span", "end": 5}}, {**fact, "confidence": "x"}]))]
    d = spark.createDataFrame(rows, "reply_id long, reply string")
    got = {(r.reply_id, r.item_no): (r.reject_reason, r.confidence, r.time_scope.period_type) for r in replies.facts(replies.items(d)).collect()}
    assert got == {(1, 0): (None, 1.0, "span"), (1, 2): ("unit is no text", 1.0, "span"), (6, 0): ("end is no text", 1.0, "span"), (6, 1): ("confidence is no number", None, "span")}
    good = {"fact_id_a": 1, "fact_id_b": 2, "relation_type": "contradicts", "reasoning_text": "r", "confidence": 1}
    rows = [(1, json.dumps([good, {**good, "fact_id_b": 9}, "text", {**good, "fact_id_a": 1.5}, {**good, "reconciled_dimension": "time"}, {**good, "reconciled_dimension": "x"}, {**good, "relation_type": 7}]))]
    found = replies.relationships(replies.items(spark.createDataFrame(rows, "reply_id long, reply string")), spark.createDataFrame([(1, [1, 2])], "reply_id long, fact_ids array<long>"))
    assert {r.item_no: r.reject_reason for r in found.collect()} == {0: None, 1: "not in the digest", 2: "not an object", 3: "ids are not integers", 4: None, 5: "unknown dimension", 6: "unknown relation"}


def test_store_goes_on_from_its_last_id(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS kept LOCATION '{tmp_path}/kept'")
    try:
        for _ in range(2):
            store.create(spark, "kept")
        rows = spark.createDataFrame([(k, f"file {k}") for k in range(5)], "n long, filename string")
        assert [r.id for r in store.append(rows, "kept.documents", "n", "2024-01-01T00:00:00+00:00").orderBy("id").collect()] == [1, 2, 3, 4, 5]
        again = store.append(rows.limit(2), "kept.documents", "n", "2024-01-02T00:00:00+00:00").collect()
        assert {(r.id, r.uploaded_at[:10], r.section_count) for r in again} == {(6, "2024-01-02", None), (7, "2024-01-02", None)}
        assert store.by_id(spark.table("kept.documents"), 3).first().filename == "file 2" and store.by_id(spark.table("kept.documents"), 99).count() == 0
    finally:
        spark.sql("DROP DATABASE kept CASCADE")
    edges = spark.createDataFrame([("contradicts", "time"), ("contradicts", "odd"), ("odd", None), ("corroborates", None)], "relation_type string, reconciled_dimension string")
    assert {tuple(r) for r in store.decodable(edges).collect()} == {("contradicts", "time"), ("corroborates", None)}


def test_stream_compares_with_what_came_before(spark, tmp_path):
    fact = "id long, document_id long, entity_name string, entity_id string, attribute string"
    rows = [[(1, 1, "Pier", "A1", "x"), (2, 1, "Mole", None, "length")], [(3, 2, "Quay", " a1", "y"), (4, 2, "Jetty", None, "total length"), (5, 2, "Groyne", None, "length")]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, fact).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(fact).parquet(f"{tmp_path}/in")
        compare.compare_stream(stream, f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/check", lambda pairs: pairs, 16).awaitTermination()
    got = {(r.new_id, r.old_id, r.criterion, r.batch) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(3, 1, 1, 1), (4, 2, 2, 1), (5, 2, 2, 1), (5, 4, 2, 1)}


def test_windows_of_a_stream_are_those_of_its_table(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02}:{m:02}:00", s) for h in range(3) for m in (5, 50) for s in ("done", "failed")]
    events = spark.createDataFrame(rows, "ts string, stage string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = jobs.stage_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in jobs.stage_counts(events).collect()} and spark.table("counts").count() == 6


def test_job_state(spark):
    log = [("j", 1, "created", None, "a,b", None), ("j", 2, "stage", 0, "parsing", "batch 1/2"), ("j", 3, "stage", 0, "storing", None), ("j", 4, "stage", 5, "parsing", None), ("j", 5, "stage", -1, "parsing", None), ("j", 6, "error", 1, "bad", None), ("x", 1, "stage", 0, "parsing", None), ("j", 7, "completed", None, None, None)]
    d = spark.createDataFrame(log, "job_id string, seq int, kind string, file_no int, value string, detail string")
    (row,) = jobs.payloads(d).collect()
    made = json.loads(row.payload)
    assert made["status"] == "completed" and made["total_files"] == 2 and made["error"] is None
    assert made["files"] == [{"filename": "a", "stage": "storing", "stage_detail": None, "error": None, "result": None}, {"filename": "b", "stage": "failed", "stage_detail": None, "error": "bad", "result": None}]


def test_white_space_of_any_kind_is_no_text(spark):
    """Spans of line breaks and tabs have no part in a median, and are no headings."""
    spans, _ = paged({1: [("big", 22.0, False), ("body", 22.0, False), ("more", 22.0, False), ("\n", 11.0, False), ("\t\n", 11.0, True), (" ", 11.0, False), ("\r\n", 11.0, False)]})
    df = spark.createDataFrame(spans, SPAN)
    assert [r.median_font for r in sections.median_font(df).collect()] == [22.0] and sections.heading_spans(df).count() == 0


def test_references_and_quoted_attributes(spark):
    texts = ["a &amp; b", "&lt;p&gt; &#8377;5 &#x1F389; &#0; &#xD800;", "&nope; & &ampx &copy2 &hellip &hellip;", "&amp;lt;", None, "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("d", pages.decoded(F.col("t")))
    assert [r.d for r in df.orderBy("i").collect()] == ["a & b", "<p> ₹5 \U0001f389 � �", "&nope; & &x ©2 &hellip …", "&lt;", None, "plain"]
    html = "<p title=\"a > b\" data-x='</p>'>one<p>two &lt;b&gt; 3 < 4<br/>x</div><h3 class='y'>H &amp; K" + "<a b='c'>" * 3000 + "end"
    spans = pages.with_offsets(pages.html_tokens(spark.createDataFrame([(1, "http://h/a", html)], "page_id int, url string, html string")))
    assert pages.page_texts(spans).first().text == "one\n\ntwo <b> 3 < 4\nx\n\nH & Kend\n\n"
    assert {r.text for r in spans.filter("bold").collect()} == {"H & K", "end"}


def test_layout_sections_are_those_with_texts(spark):
    layout = {1: [BODY("x"), HEAD("Aims"), BODY("a")], 2: [BODY("b")], 40: [HEAD(" Means\n"), BODY("c"), HEAD("Ends")], 41: [BODY("e")]}
    spans, texts = paged(layout)
    df, whole = spark.createDataFrame(spans, SPAN), spark.createDataFrame(texts, "doc string, page_number int, text string")
    names = ["doc", "section_path", "start_page", "end_page"]
    found = sorted(tuple(r) for r in sections.layout_sections(df, whole).select(*names).collect())
    assert found == sorted(tuple(r) for r in sections.detect_sections(df, whole).select(*names).collect()) == [("d", "Aims", 1, 2), ("d", "Ends", 40, 41), ("d", "Means", 40, 40)]


def test_texts_are_made_behind_the_grouping(spark):
    """Orders' lines are dealt and collected as numbers and flags; replies meet no join."""
    import re

    from claimgraph.queries import queries

    for name in ("hallucinated_ids", "order_tables"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        # plain columns alone within the collected struct
        assert re.search(r"collect_list\(struct\([^()]*\)", plan), name
        assert "Join Inner" not in plan and "Join LeftOuter, (reply_id" not in plan, name
