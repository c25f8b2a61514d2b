"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base spans are the matches of three patterns. The method adds candidates of a wider
pattern, long runs that mix letters and digits, and asks of each value in how many
repositories (documents) and by how many owners (sources) it is held: an example that many
owners copied is not a secret, one that an owner keeps to itself looks live and is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm.common import cut, no_clash, table

# The patterns of the contract; one match at a time from the left, then the length test.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Wider candidates: the long runs of a text that hold a lower-case letter, a capital and a digit.
WIDE = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "owned")
MAX_OWNERS, MAX_REPOSITORIES = 1, 10

_SPANS = "array<struct<start:bigint,kind_no:int,end:bigint,value:string>>"


def _searches() -> dict[str, tuple[str, Column]]:
    """Pattern, and a cheap test that every text with a match passes, by kind."""
    text, low = F.col("text"), F.lower("text")
    keyword = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("api")
    # a match of 24 or more of [0-9a-f]+ is a match of [0-9a-f]{24,}: runs do not overlap
    long_hex = "[0-9a-f]{24,}"
    return {"assign": (ASSIGN, keyword), "access": (ACCESS, text.contains("AKIA")), "hex": (long_hex, text.rlike(long_hex)), "owned": (WIDE, text.rlike(WIDE))}


def _before(values: Column, start: Column) -> Column:
    """start, and start with the sums of the first one, two, ... values added."""
    none = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(values, none, step, lambda s: s["out"])


def _with_spans(found: DataFrame, kinds: dict[str, int]) -> DataFrame:
    """Of each kind the matches m_ and what stands around them g_ become spans, under the
    kind's name. What was passed before a match is a running sum. As an array that grows is
    copied each time, sums run in blocks of about the root of a text's matches."""
    others = [c for c in found.columns if c not in [f"{x}_{k}" for k in kinds for x in "mg"]]
    zero = F.lit(0).cast("long")

    def add(df: DataFrame, name: str, make) -> DataFrame:
        return df.select("*", *[make(k).alias(f"{name}_{k}") for k in kinds])

    def blocks(k: str) -> Column:
        n = F.size(f"s_{k}")
        width = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / width).cast("int") - 1, F.lit(0))), lambda b: F.slice(f"s_{k}", b * width + 1, width))

    gaps = lambda k: F.slice(f"g_{k}", 1, F.greatest(F.size(f"m_{k}"), F.lit(0)))
    found = add(found, "l", lambda k: F.transform(gaps(k), lambda g: F.length(g).cast("long")))
    found = add(found, "s", lambda k: F.zip_with(f"l_{k}", f"m_{k}", lambda g, m: g + F.length(m)))
    found = add(found, "c", blocks)
    found = add(found, "b", lambda k: _before(F.transform(f"c_{k}", lambda c: F.aggregate(c, zero, lambda t, x: t + x)), zero))
    found = add(found, "a", lambda k: F.flatten(F.zip_with(f"c_{k}", f"b_{k}", _before)))

    def spans(k: str) -> Column:
        start = F.zip_with(f"a_{k}", f"l_{k}", lambda at, g: at + g)
        span = lambda at, m: F.struct(at.alias("start"), F.lit(kinds[k]).alias("kind_no"), (at + F.length(m)).alias("end"), m.alias("value"))
        return F.zip_with(start, f"m_{k}", span).cast(_SPANS)

    return found.select(*others, *[spans(k).alias(k) for k in kinds])


def candidates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, source, base, wide): spans with their values.
    Only candidates that overlap no base span of their document are wide.

    Matches of access and hex lie within one wide match. Those of assign need not: where a
    text has some they are blanked, and the wide matches that stay as they were are apart."""
    raw = docs.select("doc_id", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    nothing = F.array().cast("array<string>")
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6

    def matches(kind: str, text: str, pattern: str, needs: Column) -> list[Column]:
        found, around = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        return [F.when(needs, found).otherwise(nothing).alias(f"m_{kind}"), F.when(needs, around).otherwise(nothing).alias(f"g_{kind}")]

    parts = [x for kind, (pattern, needs) in _searches().items() for x in matches(kind, "text", pattern, needs)]
    both = (F.size("m_assign") > 0) & (F.size("m_owned") > 0)
    blank = F.zip_with("g_assign", "m_assign", lambda g, m: F.concat(g, F.when(m.isNull(), "").when(long_value(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m)))
    found = raw.select("doc_id", "source", *parts).select("*", both.alias("blanked"), F.when(both, F.array_join(blank, "")).otherwise("").alias("masked"))
    found = found.select("*", *matches("clear", "masked", WIDE, F.col("blanked"))).drop("masked")
    spans = _with_spans(found, {kind: no for no, kind in enumerate(KINDS)} | {"clear": KINDS.index("owned")})
    assign = F.transform("assign", lambda x: x.withField("value", F.regexp_extract(x["value"], ASSIGN, 2)))
    base = F.concat(
        F.filter(assign, lambda x: F.length(x["value"]) >= 6),
        F.filter("access", lambda x: F.length(x["value"]) >= 20),
        F.filter("hex", lambda x: F.length(x["value"]) >= 24),
    )
    as_text = lambda spans: F.transform(spans, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["value"]))
    same = F.transform(F.array_intersect(as_text("owned"), as_text("clear")), lambda x: F.split(x, ":"))
    as_span = lambda p: F.struct(p[0].cast("long").alias("start"), F.lit(KINDS.index("owned")).alias("kind_no"), p[1].cast("long").alias("end"), p[2].alias("value"))
    spans = spans.select("doc_id", "source", F.array_sort(base).alias("base"), F.when(F.col("blanked"), F.transform(same, as_span).cast(_SPANS)).otherwise(F.col("owned")).alias("apart"))
    mixed = lambda x: x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]")
    alone = lambda x: ~x["value"].rlike("AKIA[A-Z0-9]{16,}") & ~x["value"].rlike("[0-9a-f]{24,}")
    return spans.select("doc_id", "source", "base", F.filter("apart", lambda x: mixed(x) & alone(x)).alias("wide"))


def ownership(found: DataFrame) -> DataFrame:
    """(document, source, value_hash) -> (value_hash, owners, repositories): distinct
    sources and documents that hold a value, counted partially before each shuffle."""
    by_owner = found.groupBy("value_hash", "source").agg(F.count_distinct("document").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """docs(doc_id, text, source, ...) -> (doc_id, base, spans, n_live, n_copied), one row
    for each row; spans are structs (start, kind_no, end, value) in order.

    base are the spans of the contract's patterns, spans those and the wide candidates held
    by at most max_owners owners in at most max_repositories documents. n_live and n_copied
    count a row's candidates, base ones too, at or beyond those bounds. Null and empty
    texts have none; repeated rows and null ids stay rows of their own, though rows that
    repeat an id are one document; a null source is one owner. No rows: no rows."""
    docs = no_clash(docs, "base", "spans", "n_live", "n_copied", "row")
    docs = docs if "source" in docs.columns else docs.withColumn("source", F.lit(None).cast("string"))
    # written with its rows' numbers, which a second reading gives again
    holds = cut(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = holds.select("row", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("document"), "source", F.size("base").alias("n_base"), F.posexplode(F.concat("base", "wide")).alias("place", "span"))
    each = each.withColumn("value_hash", F.sha2(F.col("span.value").cast("binary"), 256))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    # written first: joined from its table, both sides are dealt anew and Spark splits a hot value
    values = cut(ownership(each).filter(live).select("value_hash"), "live-values")
    added = F.collect_list(F.when(F.col("place") >= F.col("n_base"), F.col("span"))).alias("added")
    marked = each.join(values, "value_hash").groupBy("row").agg(F.count(F.lit(1)).alias("n_live"), added)
    joined = holds.join(marked, "row", "left")
    n_live = F.coalesce("n_live", F.lit(0)).cast("long")
    every = F.concat("base", F.coalesce("added", F.array().cast(_SPANS)))
    return joined.select("doc_id", "base", F.array_sort(every).alias("spans"), n_live.alias("n_live"), (F.size("base") + F.size("wide") - n_live).cast("long").alias("n_copied"))


def _joined(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind_no"] + 1), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(each, ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda no: F.size(F.filter("base", lambda x: x["kind_no"] == no)).cast("long")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        "n_live",
        "n_copied",
    )


QUERIES = {"op8_secrets": op8_secrets}


def _sql_found(kind_no: int, pattern: str) -> str:
    q = pattern.replace("'", "''")
    return f"""SELECT row, doc_id, source, {kind_no} AS kind_no, pos + gap AS start, pos + gap + length(m) AS "end", m FROM (
      SELECT *, coalesce(sum(gap + length(m)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM (
        SELECT row, doc_id, source, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(list_transform(gs[1:len(ms)], lambda g: length(g))) AS gap FROM (
          SELECT row, doc_id, source, regexp_extract_all(text, '{q}') AS ms, string_split_regex(text, '{q}') AS gs FROM d)))"""


_OPEN = ASSIGN.split("[A-Za-z0-9+/_.=-]+")[0][:-1].replace("'", "''")
ORACLE_SQL = {
    "op8_secrets": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
a AS (SELECT *, regexp_extract(m, '{ASSIGN.replace("'", "''")}', 2) AS value FROM ({_sql_found(0, ASSIGN)})),
base AS (
  SELECT * FROM a WHERE length(value) >= 6
  UNION ALL SELECT *, m FROM ({_sql_found(1, ACCESS)}) WHERE length(m) >= 20
  UNION ALL SELECT *, m FROM ({_sql_found(2, HEX)}) WHERE length(m) >= 24
), wide AS (
  SELECT *, m AS value FROM ({_sql_found(3, WIDE)}) w
  WHERE regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = w.row AND b.start < w."end" AND w.start < b."end")
), cand AS (SELECT * FROM base UNION ALL SELECT * FROM wide),
live AS (
  SELECT value FROM cand GROUP BY value
  HAVING count(DISTINCT coalesce(source, '?')) <= {MAX_OWNERS} AND count(DISTINCT doc_id) <= {MAX_REPOSITORIES}
), s AS (SELECT *, value IN (SELECT value FROM live) AS is_live, (['assign', 'access', 'hex', 'owned'])[kind_no + 1] || ':' || start || ':' || "end" AS t FROM cand)
SELECT d.doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
  sha256(coalesce(string_agg(t, ',' ORDER BY start, kind_no) FILTER (kind_no < 3), '')) AS base_sha256,
  coalesce(string_agg(t, ',' ORDER BY start, kind_no) FILTER (kind_no < 3 OR is_live), '') AS spans,
  count(*) FILTER (is_live) AS n_live, count(*) FILTER (NOT is_live) AS n_copied
FROM d LEFT JOIN s ON s.row = d.row GROUP BY d.row, d.doc_id
"""
}
