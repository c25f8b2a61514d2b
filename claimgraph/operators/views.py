"""Reads over facts and relationships: filters, details, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions import normalize as N


def facts(df: DataFrame, document_id: int | None = None, entity_name: str | None = None, attribute: str | None = None) -> DataFrame:
    """Filters that are given hold together; names match as lower-case substrings."""
    if document_id is not None:
        df = df.filter(F.col("document_id") == document_id)
    for name, part in (("entity_name", entity_name), ("attribute", attribute)):
        if part is not None:
            df = df.filter(F.contains(F.lower(name), F.lit(part.lower())))
    return df


def listed(df: DataFrame, entity_name: str | None = None) -> DataFrame:
    """Facts as a list shows them; an empty name filters nothing. Fields that are null or
    empty show what stands in for them."""
    df = facts(df, entity_name=entity_name or None)
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    shown = lambda c, other: F.when(blank(c), other).otherwise(c)
    value = F.concat(F.col("raw_value"), F.when(blank(F.col("unit")), "").otherwise(F.concat(F.lit(" "), "unit")))
    period = shown(F.col("time_scope.label"), F.col("time_scope.period_type"))
    dash = F.lit("\u2014")
    return df.select(
        "id", "entity_name", "attribute", value.alias("value"), period.alias("period"), shown(F.col("entity_scope"), dash).alias("entity_scope"), shown(F.col("entity_id"), dash).alias("entity_id"),
        F.format_string("%.2f", "confidence").alias("confidence"), N.confidence_band(F.col("confidence")).alias("band"),
    )


def digest(df: DataFrame) -> DataFrame:
    """(id, digest): the ten fields of a fact that the judge sees, as JSON with its nulls.
    Normalised values and where the fact was found are not among them."""
    fields = ["id", "entity_name", "entity_id", "attribute", "raw_value", "unit", "time_scope", "entity_scope", "verbatim_quote", "confidence"]
    return df.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("digest"))


def relationships(edges: DataFrame, fact_ids: DataFrame | None = None, relation_type: str | None = None) -> DataFrame:
    """Edges with an end among fact_ids(id), of one type, or both; an unknown type has none."""
    if relation_type is not None:
        edges = edges.filter(F.col("relation_type") == relation_type)
    if fact_ids is not None:
        ends = edges.select("*", F.explode(F.array_distinct(F.array("fact_id_a", "fact_id_b"))).alias("_end"))
        edges = ends.join(fact_ids.select(F.col("id").alias("_end")).distinct(), "_end", "left_semi").drop("_end").distinct()
    return edges


def relationship_detail(edges: DataFrame, facts_df: DataFrame, how: str = "left") -> DataFrame:
    """Each relationship with its two facts' entity, attribute and value; how is left or inner."""
    side = lambda s: facts_df.select(F.col("id").alias(f"fact_id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("entity_name", "attribute", "raw_value")])
    return edges.join(side("a"), "fact_id_a", how).join(side("b"), "fact_id_b", how)


def fact_with_relationships(facts_df: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_relationships, relationship_ids): an edge counts at both its ends, once if they agree."""
    ends = edges.select(F.col("id").alias("edge_id"), F.explode(F.array_distinct(F.array("fact_id_a", "fact_id_b"))).alias("id"))
    held = ends.groupBy("id").agg(F.array_sort(F.collect_list("edge_id")).alias("edge_ids"))
    return facts_df.select("id").join(held, "id", "left").select("id", F.coalesce(F.size("edge_ids"), F.lit(0)).cast("long").alias("n_relationships"), F.coalesce(F.array_join("edge_ids", ","), F.lit("")).alias("relationship_ids"))


def by_relation(edges: DataFrame, domain: list[str], counted: str | None = None) -> DataFrame:
    """One row for each type of a fixed domain, zero where there is none; counted names a
    column with the number of edges that a row stands for."""
    kinds = F.explode(F.array(*[F.lit(k) for k in domain])).alias("relation_type")
    counted = edges.groupBy("relation_type").agg((F.sum(counted) if counted else F.count(F.lit(1))).alias("n"))
    return edges.sparkSession.range(1).select(kinds).join(counted, "relation_type", "left").select("relation_type", F.coalesce("n", F.lit(0)).alias("n"))


def modal(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key, ties to the one met first; blanks do not count."""
    counted = df.filter(F.col(value) != "").groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.groupBy(key).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(value))
