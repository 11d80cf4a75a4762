"""Stock projections, what-if scenarios and per-location parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.nulls import count_if, number_or_zero
from shelfwise.functions.stock import NEVER
from shelfwise.operators.frames import one_row
from shelfwise.operators.positions import PAIR

PARAMETER_ROWS = 50


def stock_projection(health: DataFrame, days: int = 30) -> DataFrame:
    """Stock of every pair on each of the next days at its present use."""
    stock, use = F.col("_stock"), F.col("_use")
    return (
        health.select(
            *PAIR,
            number_or_zero(F.col("closing_stock")).alias("_stock"),
            number_or_zero(F.col("avg_daily_issue")).alias("_use"),
        )
        .withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days))))
        .select(
            *PAIR,
            "day",
            F.greatest(F.lit(0.0), stock - use * F.col("day")).alias("projected_stock"),
            F.when(use > 0, (stock / use).cast("bigint")).otherwise(NEVER).alias("stockout_day"),
        )
    )


def scenario_summary(
    health: DataFrame, queue: DataFrame, scenarios: Sequence[tuple[int, int, int]]
) -> DataFrame:
    """Effect of (demand %, lead time %, budget %) changes on critical items and budget."""
    facts = one_row(
        health.agg(
            count_if(F.col("risk_classification").isin("CRITICAL", "OUT_OF_STOCK")).alias(
                "base_critical"
            )
        ),
        queue.agg(F.coalesce(F.sum("estimated_order_value"), F.lit(0.0)).alias("_queue_value")),
    )
    cases = F.array(
        *[
            F.struct(
                F.lit(demand).alias("demand_change_pct"),
                F.lit(lead_time).alias("lead_time_change_pct"),
                F.lit(budget).alias("budget_pct"),
            )
            for demand, lead_time, budget in scenarios
        ]
    )
    base, critical = F.col("base_critical"), F.col("projected_critical")
    return (
        facts.select("*", F.inline(cases))
        .withColumn(
            "projected_critical",
            (base * (1 + F.col("demand_change_pct") / 100)).cast("bigint"),
        )
        .withColumn(
            "potential_stockouts",
            (critical * (1 + F.col("lead_time_change_pct") / 100)).cast("bigint"),
        )
        .select(
            "demand_change_pct",
            "lead_time_change_pct",
            "budget_pct",
            "base_critical",
            "projected_critical",
            (critical - base).alias("critical_change"),
            "potential_stockouts",
            (F.col("potential_stockouts") - base).alias("stockout_change"),
            (F.col("budget_pct") / 100 * F.col("_queue_value")).alias("budget_required"),
        )
    )


def location_parameters(
    locations: DataFrame, items: DataFrame, limit: int = PARAMETER_ROWS
) -> DataFrame:
    """The first ``limit`` permitted (location, item) pairs with their parameters.

    Hospitals stock medicines and medical supplies, warehouses and centres of aid
    organisations everything. The first ``limit`` pairs in code order involve at most
    ``limit`` locations per group and ``limit`` items per group, so both sides are cut
    to those before the equi-join; the result is the same and the join stays small.
    """
    by_hospital = F.col("location_type") == "HOSPITAL"
    open_to_all = F.col("location_type").isin("WAREHOUSE", "NGO_CENTER")
    places = (
        locations.filter(F.col("is_active"))
        .withColumn("_group", F.when(by_hospital, "medical").when(open_to_all, "all"))
        .filter(F.col("_group").isNotNull())
        .select("location_code", "region", "_group")
    )
    category = F.col("item_category")
    medical = category.startswith("MEDICINE") | category.startswith("MEDICAL")
    goods = items.filter(F.col("is_active")).select(
        "item_code",
        "default_lead_time_days",
        F.col("safety_stock").cast("double").alias("safety_stock"),
        medical.alias("_medical"),
    )
    first_medical = goods.filter("_medical").orderBy("item_code").limit(limit)
    first_any = goods.orderBy("item_code").limit(limit)
    allowed = first_medical.withColumn("_group", F.lit("medical")).unionByName(
        first_any.withColumn("_group", F.lit("all"))
    )
    first_places = (
        places.filter(F.col("_group") == "medical")
        .orderBy("location_code")
        .limit(limit)
        .unionByName(places.filter(F.col("_group") == "all").orderBy("location_code").limit(limit))
    )
    lead = F.col("default_lead_time_days")
    return (
        first_places.join(allowed, "_group")
        .orderBy("location_code", "item_code")
        .limit(limit)
        .select(
            *PAIR,
            F.when(F.col("region").isin("North", "Central"), lead + 2)
            .otherwise(lead)
            .alias("custom_lead_time_days"),
            (F.col("safety_stock") * 1.5).alias("custom_reorder_point"),
            F.col("safety_stock").alias("custom_safety_stock"),
            F.lit(True).alias("is_stocked"),
        )
    )
