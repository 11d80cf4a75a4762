"""Running consumption per pair on a stream of movements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_consumption(
    movements: DataFrame,
    window: str = "7 days",
    slide: str = "1 day",
    lateness: str = "1 day",
) -> DataFrame:
    """Issues per pair in sliding windows; rows later than ``lateness`` are dropped.

    Movements (ts, location_code, item_code, issues) are first summed per day, then the
    day totals per sliding window, so each movement is counted into one day and only the
    day totals are copied into the windows that contain them.
    """
    pair = ("location_code", "item_code")
    by_day = (
        movements.withWatermark("ts", lateness)
        .groupBy(F.window("ts", slide).alias("day"), *pair)
        .agg(F.sum("issues").alias("issues"), F.count("*").alias("movements"))
    )
    return (
        by_day.withColumn("day_time", F.window_time("day"))
        .groupBy(F.window("day_time", window, slide).alias("span"), *pair)
        .agg(F.sum("issues").alias("issues"), F.sum("movements").alias("movements"))
        .select(
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            *pair,
            "issues",
            "movements",
        )
    )


def open_windows(
    movements: DataFrame, emitted: DataFrame, window: str = "7 days", slide: str = "1 day"
) -> DataFrame:
    """The windows that a stream over a finished input has left open.

    A watermark closes windows in the order of their ends, so the open ones end after
    every window in ``emitted``; they are computed anew from the movements that reach them.
    """
    closed = emitted.agg(F.max("window_end").alias("closed_to")).first()["closed_to"]
    if closed is not None:
        movements = movements.filter(F.col("ts") >= F.lit(closed) - F.expr(f"INTERVAL '{window}'"))
    windows = running_consumption(movements, window, slide)
    return windows if closed is None else windows.filter(F.col("window_end") > F.lit(closed))
