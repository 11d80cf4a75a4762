"""Date arithmetic against an explicit as-of date, so that results repeat."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_before(as_of: dt.date, days: int) -> Column:
    """Literal ``as_of - days``, folded here so that filters on it prune partitions."""
    return F.lit(as_of - dt.timedelta(days=days))


def within(date: Column, as_of: dt.date, days: int) -> Column:
    """Trailing window ``date >= as_of - days``; open at the top, future rows count."""
    return date >= days_before(as_of, days)


def plus_days(as_of: dt.date, days: Column) -> Column:
    """``as_of + days``, NULL where the sum would leave the calendar."""
    first, last = (dt.date.min - as_of).days, (dt.date.max - as_of).days
    return F.when(
        days.between(first, last),
        F.date_add(F.lit(as_of), days.cast("int")),
    )


def utc_instant(wall_clock: Column) -> Column:
    """A time without zone taken as UTC, whatever the session's zone.

    Event-time windows are aligned to UTC days, and watermarks need an instant.
    """
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall_clock).cast("timestamp")


def utc_date(instant: Column) -> Column:
    """The UTC day of an instant."""
    return F.to_date(
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
    )
