"""Model replies: code fences off, JSON to validated facts and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of relation and of period, what may reconcile, and the fields that items must have.
RELATIONS = ["corroborates", "contradicts", "reconciled_context"]
DIMENSIONS = ["time", "scope", "units", "estimate_vintage", "other"]
PERIODS = ["point_in_time", "span", "unknown"]
REQUIRED = ["fact_id_a", "fact_id_b", "relation_type", "reasoning_text", "confidence"]
FACT_TEXTS = ["entity_name", "attribute", "raw_value", "verbatim_quote"]
FACT_OPTIONS = ["entity_id", "unit", "entity_scope"]
SCOPE_TEXTS = ["start", "end", "label", "vintage"]


def without_fences(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")


def items(replies: DataFrame, take: list[str] = []) -> DataFrame:  # noqa: B006
    """replies(reply_id, reply) -> (reply_id, item_no, item): the items of a JSON list as
    variants; anything but a list has none. The columns take pass with each item."""
    parsed = replies.select("reply_id", *take, F.try_parse_json(without_fences(F.col("reply"))).alias("v"))
    # null in place of what is no list: parsed once, and exploded to nothing
    lists = parsed.select("reply_id", *take, F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).alias("v"))
    each = replies.sparkSession.tvf.variant_explode(F.col("v").outer())
    return lists.lateralJoin(each).select("reply_id", *take, F.col("pos").alias("item_no"), F.col("value").alias("item"))


def _fields(found: DataFrame, names: list[str], prefix: str = "", source: str = "item") -> DataFrame:
    """Adds each field as a variant, v_, and its kind, k_ (null where it is missing)."""
    got = found.select("*", *[F.try_variant_get(source, f"$.{n}", "variant").alias(f"v_{prefix}{n}") for n in names])
    return got.select("*", *[F.schema_of_variant(f"v_{prefix}{n}").alias(f"k_{prefix}{n}") for n in names])


def _text(name: str) -> Column:
    return F.try_variant_get(f"v_{name}", "$", "string").alias(name)


def relationships(found: DataFrame, digest: DataFrame | None = None) -> DataFrame:
    """Adds the fields and reject_reason, of which the first that holds counts; null: valid.

    With digest(reply_id, fact_ids), the ids that the model was shown, or with a column
    fact_ids of found itself, an item that names another id is rejected too. A dimension is checked here, before it could be stored."""
    f = _fields(found.withColumn("k", F.schema_of_variant("item")), [*REQUIRED, "reconciled_dimension"])
    f = f.withColumn("relation_type", F.when(F.col("k_relation_type") == "STRING", _text("relation_type")))
    whole = F.coalesce(F.col("k_fact_id_a").isin("BIGINT", "BOOLEAN") & F.col("k_fact_id_b").isin("BIGINT", "BOOLEAN"), F.lit(False))
    f = f.select("*", *[F.try_variant_get(f"v_{n}", "$", "long").alias(n) for n in ("fact_id_a", "fact_id_b")])
    lacking = F.lit(False)
    for name in REQUIRED:
        lacking = lacking | F.col(f"v_{name}").isNull()
    reason = (
        F.when(~F.col("k").startswith("OBJECT"), "not an object")
        .when(lacking, "missing key")
        .when(~F.coalesce(F.col("relation_type").isin(*RELATIONS), F.lit(False)), "unknown relation")
        .when(~whole, "ids are not integers")
        .when(F.col("fact_id_a") == F.col("fact_id_b"), "same fact")
    )
    if digest is not None:
        f = f.join(digest.select("reply_id", "fact_ids"), "reply_id", "left")
    if "fact_ids" in f.columns:
        shown = F.coalesce(F.array_contains("fact_ids", F.col("fact_id_a")) & F.array_contains("fact_ids", F.col("fact_id_b")), F.lit(False))
        reason = reason.when(~shown, "not in the digest")
    dimension = F.coalesce(F.col("k_reconciled_dimension") == "VOID", F.lit(True)) | F.coalesce(_text("reconciled_dimension").isin(*DIMENSIONS), F.lit(False))
    reason = reason.when(~dimension, "unknown dimension")
    return f.select(*found.columns, "fact_id_a", "fact_id_b", "relation_type", reason.alias("reject_reason"))


def facts(found: DataFrame) -> DataFrame:
    """Items of replies as facts: adds their fields, section_path, time_scope as a struct,
    confidence and reject_reason (null: valid), and leaves out what is no object. Texts must
    be JSON texts, numbers of texts are none; a confidence may be a number's text. Fields
    that are not known are passed over."""
    f = found.withColumn("k", F.schema_of_variant("item")).filter(F.col("k").startswith("OBJECT"))
    f = _fields(f, [*FACT_TEXTS, *FACT_OPTIONS, "time_scope", "confidence", "section_path"])
    f = _fields(f, ["period_type", *SCOPE_TEXTS], "ts_", "v_time_scope")
    absent = lambda name: F.col(f"v_{name}").isNull()
    is_text = lambda name: F.coalesce(F.col(f"k_{name}") == "STRING", F.lit(False))
    none = lambda name: F.coalesce(F.col(f"k_{name}") == "VOID", F.lit(True))
    reason = F
    for name in FACT_TEXTS:
        reason = reason.when(absent(name), f"missing {name}").when(~is_text(name), f"{name} is no text")
    for name in FACT_OPTIONS:
        reason = reason.when(~none(name) & ~is_text(name), f"{name} is no text")
    reason = reason.when(absent("time_scope"), "missing time_scope").when(~F.coalesce(F.col("k_time_scope").startswith("OBJECT"), F.lit(False)), "time_scope is no object")
    reason = reason.when(~(is_text("ts_period_type") & F.coalesce(_text("ts_period_type").isin(*PERIODS), F.lit(False))), "unknown period_type")
    for name in SCOPE_TEXTS:
        reason = reason.when(~none(f"ts_{name}") & ~is_text(f"ts_{name}"), f"{name} is no text")
    kind = F.col("k_confidence")
    number = F.when(kind == "BOOLEAN", F.try_variant_get("v_confidence", "$", "boolean").cast("double")).when(
        (kind == "STRING") | kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.trim(F.try_variant_get("v_confidence", "$", "string")).try_cast("double")
    )
    reason = reason.when(absent("confidence"), "missing confidence").when(number.isNull(), "confidence is no number")
    texts = [F.when(is_text(n), _text(n)).alias(n) for n in [*FACT_TEXTS, *FACT_OPTIONS, "section_path"]]
    scope = F.struct(*[_text(f"ts_{n}").alias(n) for n in ("period_type", *SCOPE_TEXTS)]).alias("time_scope")
    return f.select(*found.columns, *texts, scope, number.alias("confidence"), reason.alias("reject_reason"))


def with_known(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Adds known: whether an edge's unordered pair is among the known ones."""
    lo, hi = F.least("fact_id_a", "fact_id_b"), F.greatest("fact_id_a", "fact_id_b")
    there = known.select(lo.alias("_lo"), hi.alias("_hi")).distinct().withColumn("known", F.lit(True))
    joined = edges.withColumn("_lo", lo).withColumn("_hi", hi).join(there, ["_lo", "_hi"], "left")
    return joined.withColumn("known", F.coalesce("known", F.lit(False))).drop("_lo", "_hi")


def new_pairs(edges: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """The first edge of each unordered pair that is not known in either orientation."""
    lo, hi = F.least("fact_id_a", "fact_id_b"), F.greatest("fact_id_a", "fact_id_b")
    first = edges.withColumn("lo", lo).withColumn("hi", hi).groupBy("lo", "hi").agg(F.min_by(F.struct(*edges.columns), F.struct(*order)).alias("e"))
    return first.join(known.select(lo.alias("lo"), hi.alias("hi")).distinct(), ["lo", "hi"], "left_anti").select("e.*")
