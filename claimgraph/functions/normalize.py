"""Normalisation of quantities, fiscal years, identifiers, attributes and names as Columns.

Everything stays in generated JVM code; malformed input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnitude words with their factors, in the order in which they are tried.
MAGNITUDES = [
    ("crores?", 1e7),
    ("cr", 1e7),
    ("lakhs?", 1e5),
    ("lacs?", 1e5),
    ("billions?", 1e9),
    ("bn", 1e9),
    ("millions?", 1e6),
    ("mn", 1e6),
]
# Fixed pattern: what makes a value a percentage.
PERCENT = r"(?i)per\s*cent|%"
# Words that tell no attributes apart; suffixes that tell no companies apart.
STOPWORDS = ["from", "of", "the", "a", "an", "in", "on", "for", "to", "and", "or"]
SUFFIXES = ["limited", "ltd", "incorporated", "inc", "corporation", "corp", "company", "co", "plc", "llp", "pvt", "private"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


# White space of any kind, as (?U)\s has it.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def is_percent(*texts: Column) -> Column:
    found = F.lit(False)
    for t in texts:
        found = found | F.coalesce(t.rlike(PERCENT), F.lit(False))
    return found


def multiplier(raw: Column, unit: Column) -> Column:
    """The first magnitude word of the raw text, else of the unit, else one."""
    whole = lambda words: f"(?i)(?<![a-z])(?:{words})(?![a-z])"
    text = F.when(raw.rlike(whole("|".join(w for w, _ in MAGNITUDES))), raw).otherwise(unit)
    chain = F
    for word, factor in MAGNITUDES:
        chain = chain.when(text.rlike(whole(word)), F.lit(factor))
    return chain.otherwise(F.lit(1.0))


def quantity(raw: Column, unit: Column, factor: Column | None = None) -> Column:
    """A number in base units: a value wholly in parentheses or with a leading minus is
    negative, percentages keep their figure, one footnote digit behind two or more decimals
    is dropped; null where no plain number is left. factor is multiplier(raw, unit), if the
    caller has it."""
    text = strip(raw)
    inner = F.when(text.rlike(r"^\(.*\)$"), strip(F.regexp_replace(text, r"^\(|\)$", ""))).otherwise(text)
    negative = text.rlike(r"^\(.*\)$") | inner.startswith("-")
    body = F.when(inner.rlike(r"^[-+]"), strip(F.substring(inner, F.lit(2), F.length(inner)))).otherwise(inner)
    digits = F.regexp_replace(body, r"[^\d.]", "")
    # Fixed pattern: more than two decimals end in a footnote's digit
    plain = F.when(digits.rlike(r"^\d+(\.\d+)?$"), F.regexp_replace(digits, r"^(\d+\.\d{2,})\d$", "$1"))
    times = F.when(is_percent(body, unit), F.lit(1.0)).otherwise(multiplier(raw, unit) if factor is None else factor)
    return plain.try_cast("double") * F.when(negative, -1.0).otherwise(1.0) * times


def fiscal_year_end(label: Column) -> Column:
    """The year that names a fiscal year's label, or null: a range of two consecutive years,
    two digits (00-49 are 2000-2049), or four."""
    text = strip(label)
    century = lambda yy: F.when(yy < 50, yy + 2000).otherwise(yy + 1900)
    group = lambda pattern, k: F.regexp_extract(text, pattern, k).try_cast("int")
    # Fixed patterns of labels: a range of years, two digits, four digits.
    span = r"(?i)^(?:FY\s*)?(\d{4})\s*[-/–—]\s*(\d{2,4})$"
    two, four = r"(?i)^FY\s*['’]?\s*(\d{2})$", r"(?i)^FY\s*(\d{4})$"
    stop = F.when(F.length(F.regexp_extract(text, span, 2)) == 2, century(group(span, 2))).otherwise(group(span, 2))
    return F.when(text.rlike(span), F.when(stop == group(span, 1) + 1, stop)).when(text.rlike(two), century(group(two, 1))).when(text.rlike(four), group(four, 1))


def fiscal_year(label: Column) -> Column:
    """struct(label, start, end): 1 April to 31 March, as text; null where there is none."""
    end = fiscal_year_end(label)
    return F.when(end.isNotNull(), F.struct(strip(label).alias("label"), F.format_string("%04d-04-01", end - 1).alias("start"), F.format_string("%04d-03-31", end).alias("end")))


def identifier(c: Column) -> Column:
    """Stripped and in capitals; a company number (a fixed pattern) loses its listing letter."""
    return F.regexp_replace(F.upper(strip(c)), r"^[UL](\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6})$", "$1")


def attribute_tokens(c: Column) -> Column:
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS)))


def entity_name(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    low = F.regexp_replace(low, rf"(?U)\b(?:{'|'.join(SUFFIXES)})\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?U)[^a-z0-9\s]", " "), r"(?U)\s+", " "))


def looks_like_date(c: Column) -> Column:
    pattern = rf"(?i)\d{{1,4}}\s*[-/]\s*\d{{1,2}}\s*[-/]\s*\d{{1,4}}|\b(?:{'|'.join(MONTHS)})[a-z]*\b"
    return F.coalesce(c.rlike(pattern), F.lit(False))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.85, "high").when(c >= 0.6, "moderate").otherwise("low")
