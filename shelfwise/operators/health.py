"""Stock health per (location, item): metrics, score, risk class and flags."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import labels, stock
from shelfwise.functions.nulls import number_or_zero
from shelfwise.operators.consumption import (
    WINDOWS,
    consumption_metrics,
    position_with_consumption,
)
from shelfwise.operators.positions import PAIR, latest_stock_position


#: What the classification takes from the consumption metrics.
_USAGE = (
    *[f"avg_daily_issue_{days}d" for days in WINDOWS],
    *[f"total_issues_{days}d" for days in WINDOWS],
    "days_with_movement_30d",
    "last_movement_date",
    "days_since_last_movement",
)


def join_metrics(
    position: DataFrame,
    consumption: DataFrame,
    items: DataFrame,
    locations: DataFrame,
    params: DataFrame,
    as_of: dt.date,
) -> DataFrame:
    """Latest position with its consumption, master data and per-pair overrides.

    For positions and consumption that lie in tables of their own.
    """
    usage = consumption.select(*PAIR, *_USAGE)
    return with_masters(
        position.join(usage, list(PAIR), "left"), items, locations, params, as_of
    )


def with_masters(
    pairs: DataFrame,
    items: DataFrame,
    locations: DataFrame,
    params: DataFrame,
    as_of: dt.date,
) -> DataFrame:
    """Positions with consumption, joined to master data and per-pair overrides.

    No join is hinted: masters below the broadcast threshold are broadcast by their
    measured size, larger ones take a sort-merge join that adaptive execution splits where
    one item or location is hot. The joins per pair come first and share one shuffle.
    """
    item_facts = items.select(
        "item_code",
        "default_lead_time_days",
        F.col("safety_stock").cast("double").alias("_item_safety_stock"),
        F.col("reorder_point").cast("double").alias("_item_reorder_point"),
        F.col("is_critical").alias("is_critical_item"),
    )
    location_facts = locations.select(
        "location_code", F.col("priority_level").alias("location_priority")
    )
    overrides = params.select(
        *PAIR,
        "custom_lead_time_days",
        F.col("custom_safety_stock").cast("double").alias("custom_safety_stock"),
        F.col("custom_reorder_point").cast("double").alias("custom_reorder_point"),
        F.col("max_stock_level").cast("double").alias("_max_stock_level"),
    )
    closing, use = F.col("closing_stock"), F.col("avg_daily_issue")
    daily_issue = stock.effective_daily_issue(
        F.col("avg_daily_issue_14d"), F.col("avg_daily_issue_7d"), F.col("avg_daily_issue_30d")
    )
    return (
        pairs.join(overrides, list(PAIR), "left")
        .join(item_facts, "item_code", "left")
        .join(location_facts, "location_code", "left")
        .withColumn("avg_daily_issue", F.coalesce(daily_issue, F.lit(0.0)))
        .select(
            "location_code",
            "location_name",
            "item_code",
            "item_name",
            "item_category",
            "latest_date",
            "closing_stock",
            "unit_of_measure",
            F.coalesce(
                F.col("custom_lead_time_days"),
                F.col("default_lead_time_days"),
                F.col("lead_time_days"),
                F.lit(stock.DEFAULT_LEAD_TIME),
            )
            .cast("int")
            .alias("lead_time_days"),
            F.coalesce(
                F.col("custom_safety_stock"), F.col("_item_safety_stock"), F.lit(0.0)
            ).alias("safety_stock"),
            F.coalesce(F.col("custom_reorder_point"), F.col("_item_reorder_point")).alias(
                "reorder_point"
            ),
            F.coalesce(F.col("_max_stock_level"), F.lit(float(stock.UNLIMITED_STOCK))).alias(
                "max_stock_level"
            ),
            "avg_daily_issue",
            "total_issues_7d",
            "total_issues_14d",
            "total_issues_30d",
            "days_with_movement_30d",
            "last_movement_date",
            "days_since_last_movement",
            stock.days_of_cover(closing, use).alias("days_of_cover"),
            stock.projected_stockout_date(as_of, closing, use).alias("projected_stockout_date"),
            stock.days_until_stockout(closing, use).alias("days_until_stockout"),
            "is_critical_item",
            "location_priority",
        )
    )


def stock_health_metrics(
    daily: DataFrame,
    items: DataFrame,
    locations: DataFrame,
    params: DataFrame,
    as_of: dt.date,
    group_by_codes_only: bool = False,
) -> DataFrame:
    """Position, consumption, cover and stock-out forecast of every pair.

    One pass over the records; grouping by codes only needs a second one.
    """
    if not group_by_codes_only:
        pairs = position_with_consumption(daily, as_of)
        return with_masters(pairs, items, locations, params, as_of)
    return join_metrics(
        latest_stock_position(daily),
        consumption_metrics(daily, as_of, group_by_codes_only),
        items,
        locations,
        params,
        as_of,
    )


def classify(metrics: DataFrame) -> DataFrame:
    """Adds score, risk class, colour and flags; narrow, no shuffle."""
    closing, days = F.col("closing_stock"), F.col("days_until_stockout")
    lead, idle = F.col("lead_time_days"), F.col("days_since_last_movement")
    return metrics.withColumns(
        {
            "stock_health_score": stock.health_score(F.col("days_of_cover"), lead, idle),
            "risk_classification": stock.risk_class(closing, days, lead, idle),
            "risk_color": stock.risk_color(closing, days, lead, idle),
            "requires_attention": stock.requires_attention(closing, days, lead),
            "is_overstock": stock.is_overstock(closing, F.col("avg_daily_issue"), idle),
            "calculated_timestamp": F.current_timestamp(),
        }
    )


def stock_health_classification(
    daily: DataFrame,
    items: DataFrame,
    locations: DataFrame,
    params: DataFrame,
    as_of: dt.date,
    group_by_codes_only: bool = False,
) -> DataFrame:
    return classify(
        stock_health_metrics(daily, items, locations, params, as_of, group_by_codes_only)
    )


def movement_velocity(health: DataFrame) -> DataFrame:
    """Items per movement class, with their share of the whole list."""
    counts = (
        health.withColumn(
            "velocity", stock.movement_class(number_or_zero(F.col("avg_daily_issue")))
        )
        .groupBy("velocity")
        .agg(F.count("*").alias("items"))
    )
    total = F.sum("items").over(Window.partitionBy())  # three rows at most
    return counts.withColumn("pct_of_total", F.round(F.col("items") * 100.0 / total, 1))


def health_bands(health: DataFrame, buffer: float = 0.5) -> DataFrame:
    """Band, badge, traffic light and display labels of every pair."""
    score, risk = F.col("stock_health_score"), F.col("risk_classification")
    return health.select(
        *PAIR,
        "stock_health_score",
        "risk_classification",
        labels.band(score).alias("score_band"),
        labels.band(score, labels.SUMMARY_BADGES, labels.LOWEST_BADGE).alias("summary_badge"),
        labels.band(score, labels.MONITORING_BANDS, labels.LOWEST_MONITORING).alias(
            "monitoring_band"
        ),
        stock.traffic_light(F.col("days_of_cover"), F.col("lead_time_days"), buffer).alias(
            "traffic_light"
        ),
        labels.hex_color(risk).alias("hex_color"),
        F.concat(labels.icon(risk), F.lit(" "), risk).alias("risk_label"),
        labels.tidy(risk).alias("risk_title"),
        labels.tidy(F.col("item_category")).alias("category_title"),
    )


def capacity_overstock(health: DataFrame) -> DataFrame:
    """Pairs holding more than their maximum stock level."""
    return health.filter(F.col("closing_stock") > F.col("max_stock_level")).select(
        *PAIR,
        "closing_stock",
        "max_stock_level",
        (F.col("closing_stock") - F.col("max_stock_level")).alias("excess_stock"),
    )
