"""The store: tables of documents, facts and relationships that only grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.operators.order import row_numbers
from claimgraph.operators.replies import DIMENSIONS, RELATIONS

SCOPE = "struct<period_type: string, start: string, end: string, label: string, vintage: string>"
TABLES = {
    "documents": "id bigint, filename string, uploaded_at string, entity_name string, section_count int",
    "facts": f"id bigint, document_id bigint, entity_name string, entity_id string, attribute string, raw_value string, unit string, normalized_value double, normalized_unit string, time_scope {SCOPE}, entity_scope string, verbatim_quote string, section_path string, char_offset int, page_number int, confidence double, created_at string",
    "relationships": "id bigint, fact_id_a bigint, fact_id_b bigint, relation_type string, reconciled_dimension string, reasoning_text string, confidence double, created_at string",
}


def create(spark: SparkSession, database: str) -> None:
    """The database and its tables, if they are not there."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def with_ids(rows: DataFrame, order: str, last_id: Column | int) -> DataFrame:
    """Adds id: the last one given so far plus the row's place by a whole-number order."""
    last = last_id if isinstance(last_id, Column) else F.lit(last_id)
    return row_numbers(rows, order, "_place").withColumn("id", (F.col("_place") + last).cast("long")).drop("_place")


def append(rows: DataFrame, table: str, order: str, now: str) -> DataFrame:
    """Writes rows behind those of a table, in one commit, with ids that go on from its last
    and one time of creation, which the caller gives. Gives the rows as written. Missing
    columns are null, unknown ones are left out."""
    spark = rows.sparkSession
    last = spark.table(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    stamp = "uploaded_at" if table.endswith("documents") else "created_at"
    new = with_ids(rows.drop("id"), order, last).withColumn(stamp, F.lit(now))
    fields = spark.table(table).schema.fields
    new = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    new.write.mode("append").insertInto(table)
    return spark.table(table).filter(F.col("id") > last)


def by_id(df: DataFrame, row_id: int) -> DataFrame:
    """The row of an id, or none."""
    return df.filter(F.col("id") == row_id)


def scope_text(scope: Column) -> Column:
    return F.to_json(scope, {"ignoreNullFields": "false"})


def scope_of(text: Column) -> Column:
    """A time scope from its JSON text; null for what is none."""
    return F.from_json(text, SCOPE)


def decodable(edges: DataFrame) -> DataFrame:
    """Relationships whose type and dimension are known; others must not be stored."""
    return edges.filter(F.col("relation_type").isin(*RELATIONS) & (F.col("reconciled_dimension").isNull() | F.col("reconciled_dimension").isin(*DIMENSIONS)))
