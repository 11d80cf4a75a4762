"""Reorder recommendations and the reorder queue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import stock

URGENT_CLASSES = ("CRITICAL", "HIGH_RISK", "OUT_OF_STOCK")
QUEUE_LENGTH = 50


def needs_reorder() -> Column:
    """Soon out of stock, at or below the reorder point, or in an urgent class."""
    return (
        (F.col("days_until_stockout") <= F.col("lead_time_days") * stock.BUFFER)
        | (F.col("closing_stock") <= F.coalesce(F.col("reorder_point"), F.lit(0.0)))
        | F.col("risk_classification").isin(*URGENT_CLASSES)
    )


def estimated_order_value(unit_cost: Column) -> Column:
    return stock.order_value(
        F.col("avg_daily_issue"),
        F.col("lead_time_days"),
        F.col("safety_stock"),
        F.col("closing_stock"),
        unit_cost,
    )


def reorder_recommendations(health: DataFrame, items: DataFrame, as_of: dt.date) -> DataFrame:
    """Eligible pairs with order size, value, urgency, priority and action date."""
    closing, days = F.col("closing_stock"), F.col("days_until_stockout")
    lead, use = F.col("lead_time_days"), F.col("avg_daily_issue")
    costs = items.select(
        "item_code",
        F.col("unit_cost").cast("double").alias("unit_cost"),
        "supplier_name",
        "supplier_code",
    )
    return (
        health.filter(needs_reorder())
        .join(costs, "item_code", "left")
        .select(
            "location_code",
            "location_name",
            "item_code",
            "item_name",
            "item_category",
            closing.alias("current_stock"),
            "avg_daily_issue",
            "lead_time_days",
            "safety_stock",
            "days_of_cover",
            "days_until_stockout",
            "projected_stockout_date",
            "risk_classification",
            "stock_health_score",
            stock.reorder_quantity(use, lead, F.col("safety_stock"), closing).alias(
                "suggested_reorder_quantity"
            ),
            estimated_order_value(F.col("unit_cost")).alias("estimated_order_value"),
            stock.urgency_score(closing, days, lead).alias("urgency_score"),
            stock.procurement_priority(
                closing, days, lead, F.col("is_critical_item"), F.col("location_priority")
            ).alias("procurement_priority_score"),
            F.when(days <= lead, F.lit(as_of))
            .otherwise(F.date_sub(F.col("projected_stockout_date"), lead))
            .alias("recommended_action_date"),
            "supplier_name",
            "supplier_code",
            "is_critical_item",
            "location_priority",
            "unit_of_measure",
            F.col("latest_date").alias("data_as_of_date"),
        )
    )


def reorder_queue(recommendations: DataFrame, top_n: int = QUEUE_LENGTH) -> DataFrame:
    """The ``top_n`` recommendations by priority; ties in code order."""
    return (
        recommendations.orderBy(
            F.col("procurement_priority_score").desc_nulls_first(), "location_code", "item_code"
        )
        .limit(top_n)
        .select(
            "location_code",
            "location_name",
            "item_code",
            "item_name",
            "item_category",
            "current_stock",
            "avg_daily_issue",
            "suggested_reorder_quantity",
            "estimated_order_value",
            "procurement_priority_score",
            "urgency_score",
            "recommended_action_date",
            "is_critical_item",
            "days_until_stockout",
            "risk_classification",
        )
    )


def queue_totals(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.sum("estimated_order_value").alias("total_reorder_value"),
        F.count("*").alias("items_to_reorder"),
        F.avg("procurement_priority_score").alias("avg_priority_score"),
    )
