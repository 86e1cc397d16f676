"""Labels and identifiers in their returned form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blanks trimmed around a label, and the two markers that refer to nothing.
BLANKS = " \t"
MARKERS = (".", "?")


def trimmed(text: Column) -> Column:
    """Text without surrounding blanks and tabs; null stays null."""
    return F.btrim(text, F.lit(BLANKS))


def label(text: Column) -> Column:
    """Trimmed, lower-case label; null stays null."""
    return F.lower(trimmed(text))


def identifier(text: Column) -> Column:
    """A gene or transcript id as a label without its version suffix (a final dot and digits)."""
    return F.regexp_replace(label(text), r"\.[0-9]+\z", "")


def refers(text: Column) -> Column:
    """True if the trimmed text names something: it is not null, empty or one of the two markers."""
    return F.coalesce(~trimmed(text).isin("", *MARKERS), F.lit(False))


def valid_span(start: Column, end: Column) -> Column:
    """True for a 1-based closed span: neither end is null and 1 <= start <= end."""
    return F.coalesce((start >= 1) & (start <= end), F.lit(False))


DECIMAL = r"\A[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
