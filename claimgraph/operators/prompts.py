"""Texts for models, from sections in batches and from digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def section_blocks(sections: DataFrame, key: list[str], order: str) -> DataFrame:
    """sections(key, order, section_path, text) -> (key, block): a batch's sections, each
    under a line that names it, in order."""
    one = F.concat(F.lit("=== SECTION: "), F.coalesce("section_path", F.lit("")), F.lit(" ===\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    listed = sections.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("b")))).alias("l"))
    return listed.select(*key, F.array_join(F.transform("l", lambda x: x["b"]), "\n").alias("block"))


def rendered(df: DataFrame, template: str, name: str, column: str) -> DataFrame:
    """Adds prompt: the template with the column in the place of {name}."""
    before, _, after = template.partition("{" + name + "}")
    return df.withColumn("prompt", F.concat(F.lit(before), F.coalesce(column, F.lit("")), F.lit(after)))
