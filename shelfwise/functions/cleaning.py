"""Column expressions that repair and coerce dirty values.

Every function maps a Column to a Column, so a whole cleaning pass is one
projection inside whole-stage codegen: no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the cleaned semantics exactly.
# A value wrapped in brackets or parentheses (after trimming).
BRACKET_PATTERN = r"^\s*[\[\(].*[\]\)]\s*$"
# The first number inside a bracketed value.
NUMBER_PATTERN = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
# Currency symbols removed before coercion.
CURRENCY_PATTERN = "[$€£]"
# A value with two separators (e.g. 1,234.56 or 1.234,56): commas are deleted.
TWO_SEPARATORS_PATTERN = r"\d+[,.]\d+[,.]\d+"
# What a plain decimal number looks like; anything else coerces to NULL.
# (Spark would also accept 5f / 5d suffixes, so the cast is guarded.)
NUMERIC_PATTERN = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
# Leading or trailing whitespace of any kind, no-break spaces too (Spark's trim strips blanks only).
EDGE_SPACE_PATTERN = r"(?U)^\s+|\s+$"
# How a date may be written: ISO, with a time part, or with slashes.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss",
                "yyyy/MM/dd", "MM/dd/yyyy"]


def strip_all(c: Column) -> Column:
    """Remove leading and trailing whitespace, tabs and newlines included."""
    return F.regexp_replace(c, EDGE_SPACE_PATTERN, "")


def is_bracketed(c: Column) -> Column:
    """value looks like ``[...]`` or ``(...)``."""
    return F.coalesce(c.rlike(BRACKET_PATTERN), F.lit(False))


def bracket_number(c: Column) -> Column:
    """The first number inside a bracketed value, '' when there is none (then the value stays)."""
    return F.regexp_extract(c, NUMBER_PATTERN, 0)


def drop_currency(c: Column) -> Column:
    """C4: remove currency symbols."""
    return F.regexp_replace(c, CURRENCY_PATTERN, "")


def fix_separators(c: Column) -> Column:
    """With two separators present, delete every comma."""
    return F.when(c.rlike(TWO_SEPARATORS_PATTERN), F.regexp_replace(c, ",", "")).otherwise(c)


def to_number(c: Column) -> Column:
    """Guarded numeric coercion; anything not a plain decimal number is NULL."""
    t = strip_all(c)
    return F.when(t.rlike(NUMERIC_PATTERN), t.try_cast("double"))


def to_date_or_null(raw: Column, formats: list[str] = DATE_FORMATS) -> Column:
    """Date coercion by the first format that fits, unparseable -> NULL; a time part is cut off."""
    text = strip_all(raw.cast("string"))
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def clip_at_zero(c: Column) -> Column:
    """Negatives -> 0; NULL stays NULL (``greatest`` alone would skip NULL)."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def numeric_or_default(raw: Column, default: float) -> Column:
    """Coerce and fill with a default."""
    return F.coalesce(to_number(raw.cast("string")), F.lit(float(default)))


def category_or_unknown(c: Column) -> Column:
    """Categorical value as trimmed string, NULL -> 'Unknown'."""
    return strip_all(F.coalesce(c.cast("string"), F.lit("Unknown")))
