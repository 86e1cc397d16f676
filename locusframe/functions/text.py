"""Small text, number and list helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chomp(text: Column) -> Column:
    """Text without line ends at its end."""
    return F.regexp_replace(text, r"[\r\n]+\z", "")


def left_aligned(text: Column) -> Column:
    """Text whose lines have no blanks at their start."""
    return F.regexp_replace(text, r"(?m)^[ \t]+", "")


def alphanumeric(text: Column, instead: str = "_") -> Column:
    """Text in which every run of other characters than letters and digits is one stand-in."""
    return F.regexp_replace(text, "[^A-Za-z0-9]+", instead)


def neighbours(values: Column) -> Column:
    """Pairs of neighbouring elements of an array, as structs (first, second)."""
    return F.transform(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), lambda x, i: F.struct(F.get(values, i).alias("first"), x.alias("second")))


def evenly(low: Column, high: Column, n: int) -> Column:
    """n numbers from low to high at equal distances."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / F.lit(max(n - 1, 1)))


def spoken(names: Column, last: str = " and ") -> Column:
    """Elements of an array as a list in words: `a, b and c`."""
    many = F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))), ", "), F.lit(last), F.element_at(names, -1))
    return F.when(F.size(names) > 1, many).otherwise(F.array_join(names, ""))
