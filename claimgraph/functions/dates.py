"""Points in time from free text, and the time scope of a fact."""

from __future__ import annotations

import datetime

import pyarrow as pa
from dateutil import parser
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph.functions import normalize as N

# Years that a document can plausibly speak of.
FIRST_YEAR, LAST_YEAR = 1900, 2100
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _read(text: str | None, reference: datetime.datetime) -> str | None:
    if text is None or not text.strip():
        return None
    try:
        found = parser.parse(text.strip(), dayfirst=True, fuzzy=True, default=reference)
    except (ValueError, OverflowError, TypeError):
        return None
    return found.date().isoformat() if FIRST_YEAR <= found.year <= LAST_YEAR else None


def point_in_time(text: Column, reference: datetime.date) -> Column:
    """The date in a text as ISO text, day before month where both could be; null where
    there is none or its year is not plausible. Parts that the text leaves out are those of
    the reference date, so that results do not hang on the day of the run.

    A day, a month's name and a year are read in generated code; other texts in batches by
    a fuzzy reader."""
    default = datetime.datetime.combine(reference, datetime.time())

    @F.arrow_udf(T.StringType())
    def fuzzy(texts: pa.Array) -> pa.Array:
        return pa.array([_read(t, default) for t in texts.to_pylist()], pa.string())

    plain = r"(?i)^\s*(\d{1,2})\s+(" + "|".join(_MONTHS) + r")\s+(\d{4})\s*$"
    part = lambda k: F.regexp_extract(text, plain, k)
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(part(2)))
    day = F.format_string("%04d-%02d-%02d", part(3).try_cast("int"), month.cast("int"), part(1).try_cast("int"))
    plausible = part(3).try_cast("int").between(FIRST_YEAR, LAST_YEAR)
    return F.when(text.rlike(plain), F.when(plausible & day.try_cast("date").isNotNull(), day)).when(text.rlike(r"\d|(?i)[a-z]"), fuzzy(text))


def with_filled(df: DataFrame, scope: str, raw_value: str, reference: datetime.date) -> DataFrame:
    """scope names a struct(period_type, start, end, label, vintage) of text. A fiscal year
    in the label fills a start or end that is null or empty, whatever the period; a point in
    time without a start then takes the date in the label, else in a raw value that looks
    like one. Step by step, as one expression of all would be too long to compile."""
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    s = F.col(scope)
    df = df.withColumn("_year", N.fiscal_year_end(s["label"]))
    bound = lambda part, text: F.when(blank(s[part]) & F.col("_year").isNotNull(), text).otherwise(s[part])
    df = df.withColumn("_start", bound("start", F.format_string("%04d-04-01", F.col("_year") - 1))).withColumn("_end", bound("end", F.format_string("%04d-03-31", "_year")))
    open_ = (s["period_type"] == "point_in_time") & blank(F.col("_start"))
    for text in (F.when(open_ & ~blank(s["label"]), s["label"]), F.when(open_ & N.looks_like_date(F.col(raw_value)), F.col(raw_value))):
        df = df.withColumn("_text", text).withColumn("_start", F.coalesce(F.when(open_, point_in_time(F.col("_text"), reference)), F.col("_start")))
    whole = F.struct(s["period_type"].alias("period_type"), F.col("_start").alias("start"), F.col("_end").alias("end"), s["label"].alias("label"), s["vintage"].alias("vintage"))
    return df.withColumn(scope, whole).drop("_year", "_start", "_end", "_text")
