"""Stock ledger from movements, calendar filling and date gaps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.positions import PAIR


def daily_movements(movements: DataFrame, *keys: str) -> DataFrame:
    """Receipts and issues summed per key and day.

    This is what bounds every later per-pair window: after it a pair holds at most one
    row per calendar day, however many movement lines it had.
    """
    return movements.groupBy(*(keys or PAIR), "record_date").agg(
        F.sum("receipts").alias("receipts"), F.sum("issues").alias("issues")
    )


def stock_ledger(movements: DataFrame, *keys: str) -> DataFrame:
    """Opening and closing balances of daily movements carrying ``initial_stock``.

    closing = initial + running sum of (receipts - issues); opening = the same up to the
    day before, which is the closing stock before or, on the first day, the initial
    stock. One sort and one window pass. Expects one row per key and day (see
    ``daily_movements``).
    """
    by_day = Window.partitionBy(*(keys or PAIR)).orderBy("record_date")
    change = F.sum(F.col("receipts") - F.col("issues"))
    until_today = change.over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    until_before = change.over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    return movements.select(
        "*",
        F.row_number().over(by_day).alias("day_num"),
        (F.col("initial_stock") + until_today).alias("closing_stock"),
        (F.col("initial_stock") + F.coalesce(until_before, F.lit(0.0))).alias("opening_stock"),
    )


def dense_calendar(daily: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One row per pair and day of the calendar; days without a record move nothing.

    The calendar is generated per pair with ``sequence``, so the result grows with
    pairs x days and no join spreads the days.
    """
    pairs = daily.select(*PAIR).distinct()
    calendar = pairs.withColumn(
        "record_date", F.explode(F.sequence(F.lit(start), F.lit(end)))
    )
    moved = daily_movements(daily.filter(F.col("record_date").between(F.lit(start), F.lit(end))))
    by_day = Window.partitionBy(*PAIR).orderBy("record_date")
    # A pair may have a NULL code; its movements are its own all the same.
    keys = [*PAIR, "record_date"]
    renamed = moved.withColumnsRenamed({name: f"_{name}" for name in keys})
    same = F.lit(True)
    for name in keys:
        same &= F.col(name).eqNullSafe(F.col(f"_{name}"))
    return (
        calendar.join(renamed, same, "left")
        .drop(*[f"_{name}" for name in keys])
        .withColumns(
            {
                "has_record": F.col("issues").isNotNull() | F.col("receipts").isNotNull(),
                "receipts": F.coalesce(F.col("receipts"), F.lit(0.0)),
                "issues": F.coalesce(F.col("issues"), F.lit(0.0)),
            }
        )
        .withColumn("day_num", F.row_number().over(by_day))
    )


def date_gaps(daily: DataFrame) -> DataFrame:
    """Pairs whose consecutive record dates lie more than a day apart, with the gaps."""
    return gaps_per_pair(daily.select(*PAIR, "record_date").distinct())


def gaps_per_pair(days: DataFrame) -> DataFrame:
    """Gaps per pair over rows that are already unique per pair and day."""
    by_day = Window.partitionBy(*PAIR).orderBy("record_date")
    step = F.datediff(F.col("record_date"), F.lag("record_date").over(by_day))
    return (
        days.filter(F.col("location_code").isNotNull() & F.col("item_code").isNotNull())
        .filter(F.col("record_date").isNotNull())
        .withColumn("_step", step)
        .filter(F.col("_step") > 1)
        .groupBy(*PAIR)
        .agg(
            F.count("*").alias("gaps"),
            F.max("_step").cast("bigint").alias("longest_gap_days"),
        )
    )
