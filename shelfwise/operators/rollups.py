"""Location, item, category and executive roll-ups of classified stock.

All of them are hash aggregates with map-side combine, so a hot location or item costs
one partial row per task, not a group of rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import labels, stock
from shelfwise.functions.nulls import count_if
from shelfwise.functions.text import fill
from shelfwise.operators.frames import emit_rules, one_row
from shelfwise.operators.positions import PAIR
from shelfwise.operators.reorder import estimated_order_value, needs_reorder

RISK = "risk_classification"
EXPOSED = ("CRITICAL", "OUT_OF_STOCK")

# Priority, action, reason and impact of each piece of advice.
ADVICE = {
    "critical": (
        "🔴 High",
        "Increase Safety Stock",
        "{critical_pct}% items at risk",
        "Reduce stockout risk by 40%",
    ),
    "overstock": (
        "🟡 Medium",
        "Optimize Reorder Quantities",
        "{overstock_pct}% items overstocked",
        "Free up $5K-10K in working capital",
    ),
    "slow": (
        "🟠 Low",
        "Review Slow-Moving Items",
        "{slow} slow movers identified",
        "Reduce holding costs by 15%",
    ),
    "worst": (
        "🔴 High",
        "Priority Support for {worst}",
        "Health score: {worst_score}/100",
        "Improve overall system health by 8%",
    ),
    "best": (
        "⭐ Strategic",
        "Replicate Best Practices from {best}",
        "Health score: {best_score}/100",
        "System-wide efficiency improvement",
    ),
}
CRITICAL_RATE_LIMIT = 0.15
OVERSTOCK_RATE_LIMIT = 0.20
SLOW_ITEM_LIMIT = 10
SLOW_USE = 0.5
WORST_SCORE_LIMIT = 60


def _in_class(*names: str) -> Column:
    return count_if(F.col(RISK).isin(*names))


def _class_counts() -> list[Column]:
    return [
        _in_class("OUT_OF_STOCK").alias("out_of_stock_count"),
        _in_class("CRITICAL").alias("critical_count"),
        _in_class("HIGH_RISK").alias("high_risk_count"),
        _in_class("MEDIUM_RISK").alias("medium_risk_count"),
        _in_class("HEALTHY").alias("healthy_count"),
        _in_class("OVERSTOCK", "SLOW_MOVING").alias("overstock_count"),
    ]


def _averages() -> list[Column]:
    return [
        F.round(F.avg("stock_health_score"), 2).alias("avg_stock_health_score"),
        F.round(F.avg("days_of_cover"), 2).alias("avg_days_of_cover"),
    ]


def _risk_score() -> Column:
    weights = F.sum(stock.risk_weight(F.col(RISK)))
    return F.round(weights / F.nullif(F.count("*"), F.lit(0)), 2)


def location_risk_summary(health: DataFrame) -> DataFrame:
    """Class counts, averages, weighted risk score and class per location."""
    total = F.count("*")
    location_class = stock.first_match(
        [
            (_in_class("OUT_OF_STOCK") > 0, "CRITICAL"),
            (_in_class("CRITICAL", "HIGH_RISK") > total * 0.3, "HIGH_RISK"),
            (_in_class("CRITICAL", "HIGH_RISK", "MEDIUM_RISK") > total * 0.5, "MEDIUM_RISK"),
        ],
        "HEALTHY",
    )
    return health.groupBy("location_code", "location_name", "location_priority").agg(
        total.alias("total_items"),
        *_class_counts(),
        *_averages(),
        _risk_score().alias("location_risk_score"),
        location_class.alias("location_risk_classification"),
        F.max("latest_date").alias("data_as_of_date"),
    )


def location_ranking(location_summary: DataFrame) -> DataFrame:
    """Locations by risk score, highest first, with their rank.

    RANK is taken over the distinct scores: those are few (two decimals between 0 and
    100), so the global ranking never gathers the locations themselves.
    """
    score = F.col("location_risk_score")
    per_score = location_summary.groupBy("location_risk_score").agg(F.count("*").alias("_n"))
    before = Window.orderBy(score.desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_score.select(
        score.alias("_score"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).alias("risk_rank"),
    )
    return (
        location_summary.join(ranks, score.eqNullSafe(F.col("_score")))
        .select(
            "risk_rank",
            "location_code",
            "location_name",
            "location_risk_score",
            "location_risk_classification",
        )
        .orderBy("risk_rank", "location_code")
    )


def item_risk_summary(health: DataFrame) -> DataFrame:
    """Location counts per class, total stock and use, and risk score per item."""
    return health.groupBy("item_code", "item_name", "item_category", "is_critical_item").agg(
        F.count("*").alias("total_locations"),
        _in_class("OUT_OF_STOCK").alias("out_of_stock_locations"),
        _in_class("CRITICAL", "HIGH_RISK").alias("at_risk_locations"),
        _in_class("HEALTHY").alias("healthy_locations"),
        F.sum("closing_stock").alias("total_stock_all_locations"),
        F.sum("avg_daily_issue").alias("total_daily_consumption"),
        *_averages(),
        _risk_score().alias("item_risk_score"),
        F.max("latest_date").alias("data_as_of_date"),
    )


def _percent(*names: str) -> Column:
    return F.round(_in_class(*names) * 100.0 / F.nullif(F.count("*"), F.lit(0)), 2)


def executive_summary(health: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row of totals, shares and averages.

    With the item master the reorder totals are added in the same pass: the master is
    reduced to one row per code first, so the join cannot multiply ``health``, and its
    copies are accounted for by count and cost total.
    """
    totals = [
        F.count_distinct("location_code").alias("total_locations"),
        F.count_distinct("item_code").alias("total_items"),
        F.count("*").alias("total_location_item_combinations"),
        *_class_counts(),
        _percent("OUT_OF_STOCK", "CRITICAL", "HIGH_RISK").alias("pct_requiring_attention"),
        _percent("HEALTHY").alias("pct_healthy"),
        *_averages(),
        count_if(F.col("is_critical_item") & F.col(RISK).isin(*EXPOSED)).alias(
            "critical_items_at_risk"
        ),
    ]
    if items is not None:
        costs = items.groupBy("item_code").agg(
            F.count("*").alias("_copies"),
            F.sum(F.coalesce(F.col("unit_cost").cast("double"), F.lit(0.0))).alias("_cost"),
        )
        health = health.join(costs, "item_code", "left")
        value = F.when(needs_reorder(), estimated_order_value(F.col("_cost")))
        copies = F.when(needs_reorder(), F.coalesce(F.col("_copies"), F.lit(1)))
        totals += [
            F.coalesce(F.sum(copies), F.lit(0)).alias("total_reorder_recommendations"),
            F.sum(value).alias("total_estimated_order_value"),
        ]
    return health.agg(
        *totals,
        F.max("latest_date").alias("data_as_of_date"),
        F.current_timestamp().alias("report_generated_timestamp"),
    )


def location_comparison(health: DataFrame, location_names: Sequence[str]) -> DataFrame:
    """Chosen locations side by side, healthiest first."""
    return (
        health.filter(F.col("location_name").isin(*location_names))
        .groupBy("location_name")
        .agg(
            F.count("*").alias("total_items"),
            F.avg("stock_health_score").alias("avg_health"),
            count_if(F.col("requires_attention")).alias("at_risk"),
            count_if(F.col("is_critical_item")).alias("critical_items"),
            F.avg("days_of_cover").alias("avg_days_cover"),
        )
        .orderBy(F.col("avg_health").desc_nulls_first(), "location_name")
    )


def risk_counts(health: DataFrame) -> DataFrame:
    return health.groupBy(RISK).agg(F.count("*").alias("items"))


def _named(health: DataFrame, key: str) -> DataFrame:
    """Rows with a key: the display groupings leave out those without."""
    return health.filter(F.col(key).isNotNull())


def location_risk_counts(health: DataFrame) -> DataFrame:
    return (
        _named(health, "location_name")
        .groupBy("location_name", RISK)
        .agg(F.count("*").alias("items"))
    )


def location_risk_matrix(health: DataFrame) -> DataFrame:
    """One row per location, one count column per risk class."""
    return (
        _named(health, "location_name")
        .groupBy("location_name")
        .pivot(RISK, list(stock.RISK_CLASSES))
        .agg(F.count("risk_color"))
        .select(
            "location_name",
            *[
                F.coalesce(F.col(name), F.lit(0)).alias(name.lower())
                for name in stock.RISK_CLASSES
            ],
        )
    )


def location_item_matrix(
    health: DataFrame, item_names: Sequence[str] | None = None
) -> DataFrame:
    """Heat-map matrix: risk colour per location and item.

    One row per cell, however many items there are; with ``item_names`` one row per
    location and a column for each of these items.
    """
    named = _named(health, "location_name")
    if item_names is None:
        return (
            named.filter(F.col("item_name").isNotNull())
            .groupBy("location_name", "item_name")
            .agg(F.max("risk_color").alias("risk_color"))
        )
    return (
        named.groupBy("location_name")
        .pivot("item_name", list(item_names))
        .agg(F.max("risk_color"))
    )


def _performance(health: DataFrame, key: str) -> DataFrame:
    return _named(health, key).groupBy(key).agg(
        F.avg("stock_health_score").alias("avg_health_score"),
        F.count("item_name").alias("total_items"),
        count_if(F.col("requires_attention")).alias("items_at_risk"),
    )


def category_performance(health: DataFrame) -> DataFrame:
    return _performance(health, "item_category")


def location_performance(health: DataFrame) -> DataFrame:
    return _performance(health, "location_name").withColumn(
        "avg_health_score", F.bround("avg_health_score", 2)
    )


def health_histogram(health: DataFrame, bin_width: int = 5) -> DataFrame:
    """Items per score bin; a bin is named by its lower edge."""
    return (
        health.filter(F.col("stock_health_score").isNotNull())
        .groupBy(
            (F.floor(F.col("stock_health_score") / bin_width) * bin_width).alias("score_from")
        )
        .agg(F.count("*").alias("items"))
    )


def list_summary(listed: DataFrame) -> DataFrame:
    return listed.agg(
        F.count("*").alias("items_displayed"),
        F.avg("stock_health_score").alias("avg_health"),
        count_if(F.col("requires_attention")).alias("at_risk"),
        count_if(F.col("is_critical_item")).alias("critical"),
    )


def overall_performance(health: DataFrame) -> DataFrame:
    rows = F.nullif(F.count("*"), F.lit(0))
    return health.agg(
        (_in_class("HEALTHY") / rows * 100).alias("healthy_pct"),
        (_in_class(*EXPOSED) / rows * 100).alias("critical_pct"),
        F.avg(F.coalesce(F.col("days_of_cover"), F.lit(0.0))).alias("avg_coverage_days"),
        F.count_distinct("location_name").alias("active_locations"),
    )


def filter_values(health: DataFrame) -> DataFrame:
    """Distinct locations, categories and classes in one pass, sorted."""
    columns = {"location": "location_name", "category": "item_category", "risk": RISK}
    return (
        health.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(kind).alias("filter"), F.col(name).alias("value"))
                        for kind, name in columns.items()
                    ]
                )
            )
        )
        .distinct()
        .orderBy("filter", F.col("value").asc_nulls_last())
    )


def smart_recommendations(health: DataFrame) -> DataFrame:
    """Advice rules over the whole list and its best and worst location."""
    per_location = health.groupBy("location_name").agg(
        F.count("*").alias("rows"),
        _in_class(*EXPOSED).alias("critical"),
        _in_class("OVERSTOCK").alias("overstock"),
        count_if(F.col("avg_daily_issue") < SLOW_USE).alias("slow"),
        F.avg(F.coalesce(F.col("stock_health_score"), F.lit(0.0))).alias("mean"),
    )
    named = F.col("location_name").isNotNull()
    mean, name = F.col("mean"), F.col("location_name")
    facts = (
        per_location.agg(
            F.sum("rows").alias("rows"),
            F.sum("critical").alias("critical"),
            F.sum("overstock").alias("overstock"),
            F.sum("slow").alias("slow"),
            F.min_by(name, F.when(named, F.struct(mean, name))).alias("worst"),
            F.min(F.when(named, mean)).alias("worst_score"),
            F.min_by(name, F.when(named, F.struct(-mean, name))).alias("best"),
            F.max(F.when(named, mean)).alias("best_score"),
        )
        .filter(F.col("rows") > 0)
        .withColumns(
            {
                "critical_rate": F.col("critical") / F.col("rows"),
                "overstock_rate": F.col("overstock") / F.col("rows"),
            }
        )
    )

    values = {
        "critical_pct": labels.fixed(F.col("critical_rate") * 100, 1),
        "overstock_pct": labels.fixed(F.col("overstock_rate") * 100, 1),
        "slow": F.col("slow"),
        "worst": F.col("worst"),
        "worst_score": labels.fixed(F.col("worst_score"), 1),
        "best": F.col("best"),
        "best_score": labels.fixed(F.col("best_score"), 1),
    }
    conditions = {
        "critical": F.col("critical_rate") > CRITICAL_RATE_LIMIT,
        "overstock": F.col("overstock_rate") > OVERSTOCK_RATE_LIMIT,
        "slow": F.col("slow") > SLOW_ITEM_LIMIT,
        "worst": F.col("worst_score") < WORST_SCORE_LIMIT,
        "best": F.col("best").isNotNull(),
    }
    names = ("priority", "action", "reason", "impact")
    return emit_rules(
        facts,
        [
            (
                conditions[rule],
                {name: fill(text, **values) for name, text in zip(names, ADVICE[rule])},
            )
            for rule in ADVICE
        ],
    )


def summary_kpis(executive: DataFrame, queue: DataFrame) -> DataFrame:
    """Attention count, critical share, queue value and progress values capped at 1."""
    facts = one_row(
        executive.select(
            "total_items",
            "total_locations",
            "out_of_stock_count",
            "critical_count",
            "high_risk_count",
            "pct_requiring_attention",
            "avg_stock_health_score",
            "avg_days_of_cover",
            "critical_items_at_risk",
        ),
        queue.agg(
            F.coalesce(F.sum("estimated_order_value"), F.lit(0.0)).alias("reorder_value"),
            F.count("*").alias("reorder_count"),
        ),
    )
    critical_pct = F.when(
        F.col("total_items") > 0, F.col("critical_items_at_risk") / F.col("total_items") * 100
    ).otherwise(0.0)
    return facts.select(
        "avg_stock_health_score",
        labels.band(
            F.col("avg_stock_health_score"), labels.SUMMARY_BADGES, labels.LOWEST_BADGE
        ).alias("health_badge"),
        (F.col("out_of_stock_count") + F.col("critical_count") + F.col("high_risk_count")).alias(
            "attention_count"
        ),
        F.least(F.col("pct_requiring_attention") / 100, F.lit(1.0)).alias("attention_progress"),
        "critical_items_at_risk",
        critical_pct.alias("critical_item_pct"),
        F.least(critical_pct / 100, F.lit(1.0)).alias("critical_progress"),
        "reorder_value",
        "reorder_count",
        F.least(F.col("avg_days_of_cover") / 30, F.lit(1.0)).alias("cover_progress"),
    )


def parent_category_rollup(health: DataFrame, categories: DataFrame) -> DataFrame:
    """Roll-up by parent category; a category without parent stands for itself."""
    parents = categories.select(
        F.col("category_code").alias("item_category"), F.col("parent_category").alias("_parent")
    )
    return (
        health.select(*PAIR, "item_category", RISK, "stock_health_score", "closing_stock",
                      "requires_attention")
        .join(parents, "item_category", "left")
        .groupBy(F.coalesce(F.col("_parent"), F.col("item_category")).alias("parent_category"))
        .agg(
            F.count("*").alias("total_items"),
            F.avg("stock_health_score").alias("avg_health_score"),
            F.sum("closing_stock").alias("total_stock"),
            count_if(F.col("requires_attention")).alias("items_at_risk"),
            _in_class(*EXPOSED).alias("critical_items"),
        )
    )
