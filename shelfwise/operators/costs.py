"""Cost, savings and investment figures of a reorder queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.nulls import count_if
from shelfwise.functions.text import fill
from shelfwise.operators.frames import emit_rules, one_row

# Fixed values.
SAVINGS_RATE = 0.15
STOCKOUT_COST = 500
DAYS_PER_MONTH = 30
EXCELLENT_ROI = (
    "✅ **Excellent ROI**: Expected returns exceed 20%, indicating highly efficient "
    "inventory management."
)
GOOD_ROI = "⚠️ **Good ROI**: Returns are positive but there's room for optimization."
POOR_ROI = "🔴 **Action Required**: Consider reviewing procurement strategies to improve ROI."
HIGH_CRITICAL_SPEND = (
    "🔴 **High Critical Spend**: Over 30% of reorder budget is for critical items. "
    "Consider increasing safety stock."
)
TOP_CATEGORY = "📦 **Top Category**: {category} requires the highest reorder investment."


def _value_total(condition: Column | None = None) -> Column:
    value = F.col("estimated_order_value")
    if condition is not None:
        value = F.when(condition, value)
    return F.coalesce(F.sum(value), F.lit(0.0))


def cost_savings(queue: DataFrame) -> DataFrame:
    """Total value, assumed savings, prevented stock-out cost and net benefit."""
    return _with_savings(
        queue.agg(
            _value_total().alias("total_reorder_value"),
            count_if(F.col("is_critical_item")).alias("critical_orders"),
            _value_total(F.col("is_critical_item")).alias("critical_value"),
            F.count("*").alias("orders"),
        )
    )


def _with_savings(totals: DataFrame) -> DataFrame:
    return totals.withColumns(
        {
            "potential_savings": F.col("total_reorder_value") * SAVINGS_RATE,
            "stockout_prevention": F.col("critical_orders").cast("double") * STOCKOUT_COST,
        }
    ).withColumn("net_benefit", F.col("potential_savings") + F.col("stockout_prevention"))


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def cost_metrics(queue: DataFrame, health: DataFrame) -> DataFrame:
    """Savings with return on investment, mean order, turnover and efficiency.

    Turnover relates the queue to the number of distinct items in ``health``.
    """
    items = health.agg(F.count_distinct("item_code").alias("total_items"))
    total = F.col("total_reorder_value")
    return (
        one_row(cost_savings(queue), items)
        .withColumns(
            {
                "roi_pct": _ratio(F.col("net_benefit"), total) * 100,
                "avg_order_value": _ratio(total, F.col("orders")),
                "avg_daily_investment": F.when(total > 0, total / DAYS_PER_MONTH).otherwise(0.0),
                "turnover_rate_pct": _ratio(F.col("orders"), F.col("total_items")) * 100,
            }
        )
        .withColumn(
            "efficiency_score",
            F.when(F.col("turnover_rate_pct") < 100, 100 - F.col("turnover_rate_pct")).otherwise(
                0.0
            ),
        )
    )


def _cost_by(queue: DataFrame, key: str) -> DataFrame:
    """Order value per key; rows without the key are left out."""
    return (
        queue.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum("estimated_order_value").alias("estimated_order_value"))
    )


def cost_by_category(queue: DataFrame) -> DataFrame:
    return _cost_by(queue, "item_category")


def cost_by_location(queue: DataFrame) -> DataFrame:
    """Order value per location, cheapest first."""
    return _cost_by(queue, "location_name").orderBy("estimated_order_value", "location_name")


def cost_insights(queue: DataFrame) -> DataFrame:
    """Insight texts that apply to the queue, numbered in the order of their rules."""
    by_category = (
        queue.groupBy("item_category")
        .agg(
            _value_total().alias("value"),
            _value_total(F.col("is_critical_item")).alias("critical_value"),
            count_if(F.col("is_critical_item")).alias("critical_orders"),
        )
        .withColumn("_order", F.struct(-F.col("value"), F.col("item_category")))
    )
    facts = by_category.agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("total_reorder_value"),
        F.coalesce(F.sum("critical_value"), F.lit(0.0)).alias("critical_value"),
        F.coalesce(F.sum("critical_orders"), F.lit(0)).alias("critical_orders"),
        F.min_by("item_category", F.when(F.col("item_category").isNotNull(), F.col("_order")))
        .alias("top_category"),
        F.count("*").alias("categories"),
    ).filter(F.col("categories") > 0)
    total = F.col("total_reorder_value")
    roi = F.col("roi_pct")
    facts = _with_savings(facts).withColumn("roi_pct", _ratio(F.col("net_benefit"), total) * 100)
    top = fill(TOP_CATEGORY, category=F.col("top_category"))
    return emit_rules(
        facts,
        [
            (roi > 20, {"insight": F.lit(EXCELLENT_ROI)}),
            ((roi > 10) & (roi <= 20), {"insight": F.lit(GOOD_ROI)}),
            (roi <= 10, {"insight": F.lit(POOR_ROI)}),
            (_ratio(F.col("critical_value"), total) > 0.3,
             {"insight": F.lit(HIGH_CRITICAL_SPEND)}),
            (F.col("top_category").isNotNull(), {"insight": top}),
        ],
    )
