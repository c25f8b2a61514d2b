"""Queries over whole tables by an index, over blocks, with keyed state and without pairs,
with their SQL: passages, packing, progress, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgraph import reading
from claimgraph.operators import packing, passages
from claimgraph.plans import comparison, ledgers
from claimgraph.queries import _FACTS, query, read
from claimgraph.sources import scratch
from claimgraph.streaming import tracker

_QUOTES = """q AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', chr(10) || '  ') WHEN 2 THEN substr(text, 9, 60) ELSE text || ' as was never said' END AS quote FROM benchmark),
p AS (SELECT *, array_to_string(list_transform(string_split_regex(trim(quote, chr(10) || ' '), '\\s+'), lambda w: regexp_escape(w)), '\\s+') AS pattern FROM q),
h AS (SELECT item_id, doc_id, instr(text, quote) - 1 AS e, CASE WHEN regexp_extract(text, pattern) <> '' THEN instr(text, regexp_extract(text, pattern)) - 1 ELSE -1 END AS l FROM p, documents)"""


def _quotes(spark, sf_dir):
    """Benchmark items: whole, with other white space, in part, and with words that stand nowhere."""
    k = F.col("item_id") % 4
    wide = F.replace("text", F.lit(" "), F.lit("\n  "))
    quote = F.when(k == 0, F.col("text")).when(k == 1, wide).when(k == 2, F.substring("text", 9, 60)).otherwise(F.concat("text", F.lit(" as was never said")))
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.lit(1).alias("key"), quote.alias("quote"))
    return quotes, read(spark, sf_dir, "documents").select(F.lit(1).alias("key"), F.col("doc_id").alias("page_number"), "text")


@query(f"""WITH {_QUOTES} SELECT item_id, coalesce(min(doc_id) FILTER (e >= 0), min(doc_id) FILTER (l >= 0), (SELECT min(doc_id) FROM documents)) AS doc_id,
coalesce(arg_min(e, doc_id) FILTER (e >= 0), arg_min(l, doc_id) FILTER (l >= 0), -1)::BIGINT AS char_offset, CASE WHEN bool_or(e >= 0) THEN 'exact' WHEN bool_or(l >= 0) THEN 'loose' ELSE 'degraded' END AS way FROM h GROUP BY item_id""")
def locate_passages(spark, sf_dir):
    """Benchmark passages in all documents: the first that holds each, by the positional index."""
    return passages.locate(*_quotes(spark, sf_dir)).select(F.col("quote_id").alias("item_id"), F.col("page_number").alias("doc_id"), "char_offset", "way")


@query(f"WITH {_QUOTES} SELECT item_id, doc_id, CASE WHEN e >= 0 THEN e ELSE l END::BIGINT AS char_offset, e >= 0 AS exact FROM h WHERE e >= 0 OR l >= 0")
def passages_in_documents(spark, sf_dir):
    """Every document that holds a passage, with the first place of its best kind."""
    place = F.struct((~F.col("exact")).alias("loose"), "char_offset")
    found = passages.hits(*_quotes(spark, sf_dir)).groupBy("quote_id", "page_number").agg(F.min(place).alias("p"))
    return found.select(F.col("quote_id").alias("item_id"), F.col("page_number").alias("doc_id"), "p.char_offset", (~F.col("p.loose")).alias("exact"))


@query(f"""WITH RECURSIVE i AS (SELECT source, doc_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
w AS (SELECT source, doc_id, r, 0 AS batch, n AS used FROM i WHERE r = 1
  UNION ALL SELECT i.source, i.doc_id, i.r, CASE WHEN w.used > 0 AND w.used + i.n > {packing.BATCH_CHARS} THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.used > 0 AND w.used + i.n > {packing.BATCH_CHARS} THEN i.n ELSE w.used + i.n END
  FROM w JOIN i ON i.source IS NOT DISTINCT FROM w.source AND i.r = w.r + 1)
SELECT source, doc_id, batch FROM w""")
def batch_documents(spark, sf_dir):
    """The documents of a source, packed at the default budget; one source holds most of them."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("n_chars"))
    return packing.next_fit(docs, "source", "doc_id", "n_chars")


@query(f"WITH {reading._JOBS} SELECT * FROM files")
def job_files_stream(spark, sf_dir):
    """The files of job_files as a stream leaves them that reads the log in three parts."""
    told = scratch.folder(spark, "job-log")
    log = reading._log(spark, sf_dir)
    log.repartition(3, F.col("seq") % 3).write.parquet(told)
    out = scratch.folder(spark, "job-files")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(told)
    tracker.track(stream, out, scratch.folder(spark, "job-state")).awaitTermination()
    return tracker.current(spark.read.option("basePath", out).parquet(out))


@query(f"WITH {_FACTS} SELECT relation_type, coalesce(reconciled_dimension, '') AS dimension, count(*) AS n FROM edges GROUP BY 1, 2")
def reconcile_by_dimension(spark, sf_dir):
    """The pairs of two ledgers by kind and by what explains them, counted without the pairs."""
    counts = ledgers.relation_counts(ledgers.ledger_facts(spark, sf_dir))
    return counts.select("relation_type", F.coalesce("reconciled_dimension", F.lit("")).alias("dimension"), F.col("n").cast("long").alias("n"))


_COMPARED = """f AS MATERIALIZED (SELECT id, c_nationkey AS doc, md5(n_name) AS n_name, entity_id, label, raw_value, unit, entity_scope, o_custkey, document_id = 2 AND fy >= 1998 AS is_new,
  '{"id": ' || id || ', "entity_name": "' || md5(n_name) || '", "entity_id": "' || entity_id || '", "attribute": "' || label || '", "raw_value": "' || raw_value || '", "unit": "' || unit
  || '", "time_scope": {"period_type": "span", "start": null, "end": null, "label": "' || label || '", "vintage": null}, "entity_scope": "' || entity_scope
  || '", "verbatim_quote": "\\"' || raw_value || '\\"\\t\\u2013 \\u20b9", "confidence": ' || (o_custkey % 100)::DOUBLE / 100 || '}' AS json
  FROM facts JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT a.doc, b.id, min(a.id) AS first FROM f a JOIN f b ON a.label = b.label WHERE a.is_new GROUP BY 1, 2 UNION ALL SELECT a.doc, b.id, min(a.id) FROM (SELECT doc, n_name, min(id) AS id FROM f WHERE is_new GROUP BY 1, 2) a JOIN f b ON a.n_name = b.n_name GROUP BY 1, 2),
c AS (SELECT doc, id, min(first) AS first FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = m.id AND f.doc = m.doc AND f.is_new) GROUP BY 1, 2),
ss AS (SELECT doc, id, json, length(json) AS size, true AS is_new, row_number() OVER (PARTITION BY doc ORDER BY id) AS turn FROM f WHERE is_new UNION ALL SELECT c.doc, c.id, json, length(json), false, row_number() OVER (PARTITION BY c.doc ORDER BY first, c.id) FROM c JOIN f USING (id)),
t AS (SELECT doc, sum(size) FILTER (is_new) + 2 * count(*) FILTER (is_new) AS new_size FROM ss GROUP BY 1),
x AS MATERIALIZED (SELECT ss.*, new_size < 25000 AS fits, CASE WHEN new_size < 25000 THEN new_size ELSE 0 END AS base FROM ss JOIN t USING (doc)),
i AS MATERIALIZED (SELECT doc, id, size, base, row_number() OVER (PARTITION BY doc ORDER BY turn, NOT is_new) AS r FROM x WHERE NOT is_new OR NOT fits),
w AS (SELECT doc, id, r, 0 AS chunk, base + size AS used FROM i WHERE r = 1
  UNION ALL SELECT i.doc, i.id, i.r, CASE WHEN w.used + i.size > 25000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.used + i.size > 25000 THEN i.base + i.size ELSE w.used + i.size END FROM w JOIN i ON i.doc = w.doc AND i.r = w.r + 1),
la AS (SELECT doc, max(chunk) AS last FROM w GROUP BY 1),
a AS (SELECT w.doc, chunk, w.r AS place, json FROM w JOIN f USING (id) UNION ALL SELECT doc, unnest(range(0, coalesce(last, 0) + 1)), turn - 1000000000, json FROM x LEFT JOIN la USING (doc) WHERE is_new AND fits)"""


def _compared(spark, sf_dir):
    """The later years of ledger B are new, a document a nation; all facts of both are stored.
    A digest of the nation's name stands for the entity's, so that unlike names are not alike."""
    facts, c = ledgers.ledger_facts(spark, sf_dir), F.floor(F.col("id") / 10000).cast("long")
    home = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("doc_id"), F.md5(F.col("n_name").cast("binary")).alias("n_name"))
    null = F.lit(None).cast("string")
    scope = F.struct(F.lit("span").alias("period_type"), null.alias("start"), null.alias("end"), F.col("label").alias("label"), null.alias("vintage"))
    # merged: a broadcast of the customers would pass through the driver
    stored = facts.withColumn("customer", c).join(home.hint("merge"), "customer").select(
        "doc_id", "id", F.col("n_name").alias("entity_name"), "entity_id", F.col("label").alias("attribute"), "raw_value", "unit", scope.alias("time_scope"), "entity_scope",
        F.concat(F.lit('"'), "raw_value", F.lit('"\t\u2013 \u20b9')).alias("verbatim_quote"), ((c % 100).cast("double") / 100).alias("confidence"), "document_id",
    )
    stored = scratch.kept(stored, "stored-facts", small=True)
    new = stored.filter((F.col("document_id") == 2) & (F.regexp_extract("attribute", r"(\d+)", 1).cast("int") >= 1998))
    return new, stored.drop("doc_id")


_BEFORE, _AFTER = comparison.TEMPLATE.replace("\n", "' || chr(10) || '").split("{digest}")


@query(f"""WITH RECURSIVE {_FACTS}, {_COMPARED}
SELECT doc::BIGINT AS doc_id, chunk::INTEGER AS chunk, count(*) AS n_facts, md5('{_BEFORE}' || '[' || string_agg(json, ', ' ORDER BY place) || ']' || '{_AFTER}') AS prompt_md5 FROM a GROUP BY 1, 2 HAVING count(*) >= 2""")
def comparison_prompts(spark, sf_dir):
    """From stored facts to the prompts of a comparison: candidates, digests, chunks, texts."""
    made = comparison.prompts_of(comparison.chunks(*_compared(spark, sf_dir)))
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), "chunk", F.size("ids").cast("long").alias("n_facts"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))
