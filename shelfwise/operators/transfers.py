"""Transfers from overstocked locations to critical ones holding the same item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
SHARE_OF_SOURCE = 0.3
DAYS_FOR_TARGET = 14
MAX_SUGGESTIONS = 10
LARGEST_LIMIT = 1_000  # up to here Spark cuts ranks before it shuffles


def transfer_suggestions(health: DataFrame, limit: int = MAX_SUGGESTIONS) -> DataFrame:
    """The first ``limit`` transfers by item, then source, then target.

    Sources and targets of an item rank by health score, then location. The quantity is
    positive exactly when the source has stock and the target uses some, so both sides
    can be filtered before they meet. The first ``limit`` pairs of an item then involve
    only its first ``limit`` sources and targets: ranking both sides ahead of the join
    is exact, keeps an item's pairs below ``limit`` squared, and the rank filter is
    applied map-side, so a hot item never gathers in one task.
    """
    if not 0 < limit <= LARGEST_LIMIT:
        raise ValueError(f"limit must be between 1 and {LARGEST_LIMIT}")
    by_item = Window.partitionBy("item_name").orderBy(
        F.col("stock_health_score").asc_nulls_last(),
        F.col("location_name").asc_nulls_last(),
        "location_code",
        "item_code",
    )
    risk = F.col("risk_classification")
    named = health.filter(F.col("item_name").isNotNull())
    sources = (
        named.filter((risk == "OVERSTOCK") & (F.col("closing_stock") > 0))
        .withColumn("from_rank", F.row_number().over(by_item))
        .filter(F.col("from_rank") <= limit)
        .select(
            "item_name",
            F.col("location_name").alias("from_location"),
            F.col("closing_stock").alias("_source_stock"),
            "from_rank",
        )
    )
    targets = (
        named.filter(risk.isin("CRITICAL", "OUT_OF_STOCK") & (F.col("avg_daily_issue") > 0))
        .withColumn("to_rank", F.row_number().over(by_item))
        .filter(F.col("to_rank") <= limit)
        .select(
            "item_name",
            F.col("location_name").alias("to_location"),
            F.col("avg_daily_issue").alias("_target_use"),
            F.when(risk == "OUT_OF_STOCK", "High").otherwise("Medium").alias("priority"),
            "to_rank",
        )
    )
    return (
        sources.join(targets, "item_name")
        .orderBy("item_name", "from_rank", "to_rank")
        .limit(limit)
        .select(
            "item_name",
            "from_location",
            "to_location",
            F.bround(
                F.least(
                    F.col("_source_stock") * SHARE_OF_SOURCE,
                    F.col("_target_use") * DAYS_FOR_TARGET,
                ),
                0,
            ).alias("quantity"),
            "priority",
        )
    )
