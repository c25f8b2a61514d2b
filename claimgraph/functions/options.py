"""Settings given as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgraph.functions import normalize as N


def keys(csv: Column, single: Column) -> Column:
    """The entries of a comma-separated list, stripped, without empty ones; else the single
    one, if it is not blank."""
    several = F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), N.strip), lambda k: k != "")
    one = F.filter(F.array(N.strip(F.coalesce(single, F.lit("")))), lambda k: k != "")
    return F.when(F.size(several) > 0, several).otherwise(one)


def whole_number(text: Column, default: int) -> Column:
    """The number in a text; the default for null and empty; null for what is no number."""
    return F.when(F.coalesce(text == "", F.lit(True)), F.lit(default)).otherwise(text.try_cast("int"))
