"""Column expressions that clean labels, event parts and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that mean "no value" once trimmed and lower-cased.
EMPTY_LABELS = ["", "nan", "nat"]
EMPTY_SIGNALS = ["", "nan", "nat", "none"]
# Fixed value: the characters that count as white space.
WHITE_SPACE = " \t\n\x0b\f\r"


def clean_text(column: Column | str, empty: list[str] = EMPTY_LABELS) -> Column:
    """Trim white space; labels that stand for a missing value become null."""
    text = F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(WHITE_SPACE))
    return F.when(~F.lower(text).isin(empty), text)


def clean_signal(column: Column | str) -> Column:
    """As :func:`clean_text`, with ``none`` also treated as missing."""
    return clean_text(column, EMPTY_SIGNALS)


def sanitize_event(column: Column | str) -> Column:
    """Upper-case label made of letters, digits, dot, dash and underscore; null if nothing is left."""
    text = F.regexp_replace(clean_text(column), r"\s+", "_")
    text = F.regexp_replace(text, r"[^0-9A-Za-zÀ-ÿ._-]+", "_")
    text = F.upper(F.regexp_replace(text, r"^_+|_+$", ""))
    return F.when(text != "", text)


def clean_number(column: Column | str, default: float = 0.0) -> Column:
    """The value as DOUBLE; text that is no number, and NaN, become ``default``."""
    source = F.col(column) if isinstance(column, str) else column
    number = F.trim(source.cast("string")).try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), number).otherwise(F.lit(float(default)))


def clean_integer(column: Column | str, default: int = 0) -> Column:
    """The value cut towards zero to LONG; ``default`` where it is no number."""
    source = F.col(column) if isinstance(column, str) else column
    number = F.trim(source.cast("string")).try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), number.cast("long")).otherwise(F.lit(default))
