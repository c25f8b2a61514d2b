"""JSON text as Columns: ASCII alone, with a space behind commas and colons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Short escapes; other characters outside of space to tilde are written by their UTF-16 units.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
PLAIN = r"[ !#-\[\]-~]"


def _escaped(c: Column) -> Column:
    """One character, or a stretch of plain ones."""
    units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
    long = F.concat(F.lit("\\u"), F.substring(units, 1, 4), F.when(F.length(units) > 4, F.concat(F.lit("\\u"), F.substring(units, 5, 4))).otherwise(""))
    short = F
    for character, text in SHORT.items():
        short = short.when(c == character, F.lit(text))
    return F.when(c.rlike(f"^{PLAIN}"), c).otherwise(short.otherwise(long))


def string(c: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(c, F.lit(f"(?s){PLAIN}+|."), F.lit(0)), _escaped)
    body = F.when(c.rlike(f"(?s)^{PLAIN}*$") & ~F.contains(c, F.lit("\n")), c).otherwise(F.array_join(parts, ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def double(c: Column) -> Column:
    """The shortest digits that give the number back; in full from 0.0001 up to 10 to the power 16."""
    text = c.cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^-?([\d.]+)E", 1), r"\.", ""), r"0+$", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    n = F.length(digits)
    whole = F.concat(F.rpad(digits, F.greatest(power + 1, n), "0"))
    above = F.when(n <= power + 1, F.concat(whole, F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    sign = F.when(power < 0, "-").otherwise("+")
    scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    changed = F.when(power.between(0, 15), above).when(power.between(-4, -1), below).otherwise(scientific)
    return F.when(power.isNull(), text).otherwise(F.concat(F.when(text.startswith("-"), "-").otherwise(""), changed))


def value(c: Column, kind: T.DataType) -> Column:
    """Of texts, numbers, truth values, and structs and arrays of these; null is written out."""
    if isinstance(kind, T.StructType):
        text = record([(f.name, c[f.name], f.dataType) for f in kind.fields])
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: value(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.DoubleType):
        text = double(c)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = c.cast("string")
    elif isinstance(kind, T.StringType):
        text = string(c)
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no JSON for {kind.simpleString()}")
    return F.when(c.isNull(), "null").otherwise(text)


def record(fields: list[tuple[str, Column, T.DataType]]) -> Column:
    parts = [F.concat(string(F.lit(name)), F.lit(": "), value(c, kind)) for name, c, kind in fields]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
