"""Consumption over the last 90 days, in one pass with fixed-width buffers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.dates import days_before, within
from shelfwise.operators.positions import (
    DESCRIPTION,
    PAIR,
    POSITION_COLUMNS,
    position_measures,
)

HISTORY_DAYS = 90
WINDOWS = (7, 14, 30)
_MASK_BITS = 63  # days as_of-30 .. as_of+32 fit one BIGINT


def _issue_measures(as_of: dt.date, recent: Column | None = None) -> list[Column]:
    """The aggregates behind ``_metrics``, over the rows of the last 90 days.

    ``recent`` marks these rows where others take part in the aggregation.
    """
    issues, date = F.col("issues").cast("double"), F.col("record_date")
    counted = (lambda value: value) if recent is None else (lambda value: F.when(recent, value))
    mask_start = as_of - dt.timedelta(days=30)
    mask_end = mask_start + dt.timedelta(days=_MASK_BITS - 1)
    moved = issues > 0
    in_mask = moved & date.between(F.lit(mask_start), F.lit(mask_end))
    day_bit = F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.datediff(date, F.lit(mask_start))
    )
    measures = []
    for days in WINDOWS:
        in_window = F.when(within(date, as_of, days), issues)
        measures += [
            F.avg(in_window).alias(f"avg_daily_issue_{days}d"),
            F.sum(counted(F.when(within(date, as_of, days), issues).otherwise(0.0))).alias(
                f"total_issues_{days}d"
            ),
            F.stddev_samp(in_window).alias(f"stddev_issues_{days}d"),
        ]
    return [
        *measures,
        F.bit_or(F.when(in_mask, day_bit)).alias("_day_mask"),
        F.count_distinct(F.when(moved & (date > F.lit(mask_end)), date)).alias("_days_beyond"),
        F.max(counted(F.when(moved, date))).alias("last_movement_date"),
    ]


def _metrics(as_of: dt.date) -> list[Column]:
    """The metrics of a pair from its ``_issue_measures``."""
    names = [
        f"{kind}_{days}d"
        for days in WINDOWS
        for kind in ("avg_daily_issue", "total_issues", "stddev_issues")
    ]
    return [
        *[F.col(name) for name in names],
        (F.coalesce(F.bit_count("_day_mask"), F.lit(0)) + F.col("_days_beyond"))
        .cast("bigint")
        .alias("days_with_movement_30d"),
        F.col("last_movement_date"),
        F.datediff(F.lit(as_of), F.col("last_movement_date")).alias("days_since_last_movement"),
    ]


def consumption_metrics(
    daily: DataFrame, as_of: dt.date, group_by_codes_only: bool = False
) -> DataFrame:
    """Averages, totals and deviations of daily issues over 7, 14 and 30 days.

    Averages and deviations run over record days (a missing day is not a zero day). By
    default the names take part in the grouping, so a renamed item yields two rows;
    ``group_by_codes_only`` keeps one row per pair and the greatest of each name.

    Movement days up to 32 days past the as-of date are counted by OR-ing one bit per
    day, which combines map-side like any sum. COUNT(DISTINCT date) over all of them would
    make the date a shuffle key of every row; here it only sees the dates past the mask,
    which can only be future-dated records, and is NULL for all others.
    """
    keys = PAIR if group_by_codes_only else PAIR + DESCRIPTION
    recent = daily.filter(within(F.col("record_date"), as_of, HISTORY_DAYS))
    measures = _issue_measures(as_of)
    if group_by_codes_only:
        measures += [F.max(name).alias(name) for name in DESCRIPTION]
    return recent.groupBy(*keys).agg(*measures).select(
        "location_code",
        "location_name",
        "item_code",
        "item_name",
        "item_category",
        "unit_of_measure",
        *_metrics(as_of),
    )


def position_with_consumption(daily: DataFrame, as_of: dt.date) -> DataFrame:
    """The latest position of every pair with its consumption, from one pass over the records.

    Equals ``latest_stock_position`` left-joined to ``consumption_metrics``: a pair whose names
    changed within 90 days has a row for each of them. Both aggregations share their keys, so
    one takes all rows for the position and those of the last 90 days for the consumption.
    What is left, a row for each name a pair ever had, goes by pair once.
    """
    recent = within(F.col("record_date"), as_of, HISTORY_DAYS)
    named = daily.filter(F.col("record_date").isNotNull()).groupBy(*PAIR, *DESCRIPTION).agg(
        *position_measures(daily),
        F.max(recent).alias("_recent"),
        *_issue_measures(as_of, recent),
    )
    details = [name for name in POSITION_COLUMNS if name not in PAIR]
    newest_first = Window.partitionBy(*PAIR).orderBy(
        F.desc("recency"), *[F.desc(name) for name in details]
    )
    whole = newest_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chosen = F.first(F.struct(*details)).over(whole)
    placed = named.select(
        "*",
        chosen.alias("_position"),
        F.max("_recent").over(whole).alias("_any_recent"),
        F.row_number().over(newest_first).alias("_rank"),
    )
    kept = F.col("_recent") | (~F.col("_any_recent") & (F.col("_rank") == 1))
    moved = F.when(F.col("_recent"), F.col("days_with_movement_30d"))
    return (
        placed.filter(kept)
        .select(
            *[F.col(name if name in PAIR else f"_position.{name}") for name in POSITION_COLUMNS],
            *_metrics(as_of),
            "_recent",
        )
        .withColumn("days_with_movement_30d", moved)
        .drop("_recent")
    )


def day_partials(daily: DataFrame, since: dt.date) -> DataFrame:
    """Mergeable sums of issues per pair, names and day from a date on.

    Records, sum, sum of squares and whether anything moved: what ``metrics_of_partials``
    needs, in one row a day however many records it has.
    """
    issues = F.col("issues").cast("double")
    return daily.filter(F.col("record_date") >= F.lit(since)).groupBy(
        *PAIR, *DESCRIPTION, "record_date"
    ).agg(
        F.count(issues).alias("records"),
        F.sum(issues).alias("total"),
        F.sum(issues * issues).alias("squares"),
        F.coalesce(F.max(issues > 0), F.lit(False)).alias("moved"),
    )


def merge_partials(partials: DataFrame, since: dt.date) -> DataFrame:
    """Partials of several sets of records as one; days before a date leave."""
    return partials.filter(F.col("record_date") >= F.lit(since)).groupBy(
        *PAIR, *DESCRIPTION, "record_date"
    ).agg(
        F.sum("records").alias("records"),
        F.sum("total").alias("total"),
        F.sum("squares").alias("squares"),
        F.max("moved").alias("moved"),
    )


def metrics_of_partials(partials: DataFrame, as_of: dt.date) -> DataFrame:
    """``consumption_metrics`` from day partials, one row a day and name of a pair."""
    date = F.col("record_date")
    measures, ready = [], []
    for days in WINDOWS:
        inside = within(date, as_of, days)
        n, total, squares = (F.col(f"_{name}_{days}") for name in ("n", "total", "squares"))
        measures += [
            F.sum(F.when(inside, F.col("records")).otherwise(0)).alias(f"_n_{days}"),
            F.sum(F.when(inside, F.col("total")).otherwise(0.0)).alias(f"_total_{days}"),
            F.sum(F.when(inside, F.col("squares")).otherwise(0.0)).alias(f"_squares_{days}"),
        ]
        apart = F.greatest(squares - total * total / n, F.lit(0.0))
        ready += [
            F.when(n > 0, total / n).alias(f"avg_daily_issue_{days}d"),
            total.alias(f"total_issues_{days}d"),
            F.when(n > 1, F.sqrt(apart / (n - 1))).alias(f"stddev_issues_{days}d"),
        ]
    moved = F.when(F.col("moved"), date)
    sums = (
        partials.filter(within(date, as_of, HISTORY_DAYS))
        .groupBy(*PAIR, *DESCRIPTION)
        .agg(
            *measures,
            F.count(F.when(within(date, as_of, 30), moved)).alias("days_with_movement_30d"),
            F.max(moved).alias("last_movement_date"),
        )
    )
    return sums.select(
        "location_code",
        "location_name",
        "item_code",
        "item_name",
        "item_category",
        "unit_of_measure",
        *ready,
        "days_with_movement_30d",
        "last_movement_date",
        F.datediff(F.lit(as_of), F.col("last_movement_date")).alias("days_since_last_movement"),
    )


def demand_forecast(
    daily: DataFrame,
    as_of: dt.date,
    window: int = 14,
    horizon: int = 7,
    history_days: int | None = None,
) -> DataFrame:
    """Moving average of the last ``window`` record days, carried over the next days.

    The record days may lie any time before ``as_of``; ``history_days`` limits how far back
    records are read, at the price of pairs with fewer record days in that time. A day among
    the newest of all is among the newest of every task that has it, so each task keeps only the
    records of its own newest days of a pair, whatever the length of the history; what is left is
    shuffled once, by pair, and summed by day there.
    """
    known = F.col("record_date") <= F.lit(as_of)
    if history_days is not None:
        known &= F.col("record_date") >= days_before(as_of, history_days)
    newest_first = Window.partitionBy(*PAIR).orderBy(F.col("record_date").desc())
    average = (
        daily.filter(known)
        .select(*PAIR, "record_date", F.col("issues").cast("double").alias("issues"))
        .withColumn("_day", F.dense_rank().over(newest_first))
        .filter(F.col("_day") <= window)
        .groupBy(*PAIR, "record_date")
        .agg(F.sum("issues").alias("issues"))
        .groupBy(*PAIR)
        .agg(F.avg("issues").alias("forecast_daily_issue"))
    )
    return average.select(
        *PAIR,
        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("day_ahead"),
        "forecast_daily_issue",
    ).select(
        *PAIR,
        F.date_add(F.lit(as_of), F.col("day_ahead")).alias("forecast_date"),
        "forecast_daily_issue",
        (F.col("forecast_daily_issue") * F.col("day_ahead")).alias("forecast_cumulative_issue"),
    )
