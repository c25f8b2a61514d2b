"""The offline stand-in for a model that reads facts out of sections, by one rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions import normalize as N

#: "<name> is|was|of|: <number> <unit>", our own rule; the number may have a currency before it.
RULE = r"([A-Za-z][A-Za-z_ -]{1,40}[A-Za-z])(?: is | was | of |: ?)((?:Rs\.? ?)?[0-9][0-9,]*(?:\.[0-9]+)?)(?: ?(%|per cent|[Cc]rore|[Ll]akh|[Mm]illion|[Bb]illion))?"
CONFIDENCE = 0.5


def facts(sections: DataFrame) -> DataFrame:
    """sections(doc, section_path, text, entity_name) -> (doc, section_path, item_no, and the
    fields of a fact): every match of the rule, quoted whole."""
    found = sections.select("doc", "section_path", "entity_name", F.posexplode(F.regexp_extract_all("text", F.lit(RULE), F.lit(0))).alias("item_no", "verbatim_quote"))
    part = lambda k: F.regexp_extract("verbatim_quote", RULE, k)
    attribute = F.regexp_replace(F.lower(N.strip(part(1))), "[ -]+", "_")
    unit = F.when(part(3) != "", part(3))
    return found.select("doc", "section_path", "item_no", "entity_name", attribute.alias("attribute"), part(2).alias("raw_value"), unit.alias("unit"), "verbatim_quote", F.lit(CONFIDENCE).alias("confidence"))
