"""Upload checks and tables as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgraph.functions import normalize as N

MAX_BYTES = 52_428_800


def gate(path: Column, content_type: Column, size: Column, most: int = MAX_BYTES) -> Column:
    """Null for a file that passes; its size is checked before its type."""
    is_pdf = F.coalesce(F.lower(path).endswith(".pdf"), F.lit(False)) | F.coalesce(F.lower(content_type).contains("pdf"), F.lit(False))
    return F.when(size > most, "too large").when(~is_pdf, "must be a PDF")


def markdown_row(cells: Column, width: Column) -> Column:
    """A row of a table: cells trimmed, pipes escaped, filled or cut to the header's width."""
    clean = F.transform(cells, lambda c: F.replace(N.strip(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.array_join(F.slice(F.concat(clean, F.array_repeat(F.lit(""), F.greatest(width, F.lit(0)))), F.lit(1), width), " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """A table (array of rows of cells) as text: the header, a rule, and the other rows at
    the header's width; empty for a table without rows or without a header's cells."""
    width = F.size(F.get(rows, 0))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.greatest(width, F.lit(0))), " | "), F.lit(" |"))
    lines = F.transform(rows, lambda r: markdown_row(r, width))
    whole = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n")
    return F.when(F.coalesce(F.size(rows) > 0, F.lit(False)) & F.coalesce(width > 0, F.lit(False)), whole).otherwise("")


def overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """The share of rectangle a that b covers; 0 for an a without area."""
    area = (ax1 - ax0) * (ay1 - ay0)
    common = F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0.0)) * F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0.0))
    return F.when(area > 0, common / area).otherwise(0.0)
