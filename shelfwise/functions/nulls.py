"""Warehouse NULL rules where Spark's own functions differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _all_present(columns) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def greatest(*columns: Column) -> Column:
    """GREATEST that is NULL as soon as one argument is (Spark's skips NULLs)."""
    return F.when(_all_present(columns), F.greatest(*columns))


def least(*columns: Column) -> Column:
    """LEAST that is NULL as soon as one argument is (Spark's skips NULLs)."""
    return F.when(_all_present(columns), F.least(*columns))


def number_or_zero(column: Column) -> Column:
    """Text to number; what is not a number counts as 0."""
    return F.coalesce(column.try_cast("double"), F.lit(0.0))


def is_blank(column: Column) -> Column:
    """NULL or the empty string."""
    return column.isNull() | (column == "")


def flag(condition: Column) -> Column:
    """TRUE/FALSE where an undecided (NULL) condition counts as FALSE."""
    return F.coalesce(condition, F.lit(False))


def count_if(condition: Column) -> Column:
    """How many rows meet the condition, 0 (not NULL) over no rows."""
    return F.count(F.when(condition, True))
