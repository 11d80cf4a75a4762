"""Alerts from classified stock, their acknowledgement and history."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.nulls import count_if
from shelfwise.functions.stock import first_match
from shelfwise.functions.text import fill
from shelfwise.operators.frames import one_row
from shelfwise.operators.positions import PAIR

# Classes by urgency, limits, and the texts per risk class.
URGENT = ("OUT_OF_STOCK", "CRITICAL", "HIGH_RISK")
ACTIVE_LIMIT = 100
DEFAULT_THRESHOLD_DAYS = 7
ALERT_TYPES = {
    "OUT_OF_STOCK": "STOCK_OUT",
    "CRITICAL": "CRITICAL_LOW",
    "HIGH_RISK": "HIGH_RISK",
    "OVERSTOCK": "OVERSTOCK",
}
OTHER_ALERT_TYPE = "LOW_STOCK"
ACTION_OUT = "URGENT: Place emergency order immediately"
ACTION_SOON = "Place order today - stock-out expected in {days} days"
ACTION_OVER = "Review for redistribution or reduced ordering"
ACTION_OTHER = "Monitor stock levels and plan replenishment"
MESSAGES = {
    "OUT_OF_STOCK": "{item} is OUT OF STOCK at {place}. Immediate action required.",
    "CRITICAL": "{item} at {place} will run out in {days} days. Current stock: {stock} {unit}",
    "HIGH_RISK": "{item} at {place} requires reorder. {days} days of supply remaining.",
    "OVERSTOCK": "{item} at {place} has not moved in {idle} days. Consider redistribution.",
}
OTHER_MESSAGE = "{item} at {place} approaching reorder point."


def _rank() -> Column:
    """1, 2, 3 for the urgent classes, 4 for all others."""
    risk = F.col("risk_classification")
    return first_match([(risk == name, n) for n, name in enumerate(URGENT, 1)], len(URGENT) + 1)


ALERT_COLUMNS = (
    "alert_type",
    "severity",
    "location_code",
    "location_name",
    "item_code",
    "item_name",
    "item_category",
    "current_stock",
    "days_until_stockout",
    "recommended_action",
    "alert_message",
)


def alerts_without_id(health: DataFrame) -> DataFrame:
    """Actionable rows with type, severity, recommended action and message."""
    return _actionable(health).select(*ALERT_COLUMNS)


def _actionable(health: DataFrame) -> DataFrame:
    """The alert columns with class rank, score and cover."""
    risk, closing = F.col("risk_classification"), F.col("closing_stock")
    days = F.col("days_until_stockout")
    out, critical, high, over = (
        risk == name for name in ("OUT_OF_STOCK", "CRITICAL", "HIGH_RISK", "OVERSTOCK")
    )
    alert_type = first_match(
        [(risk == name, kind) for name, kind in ALERT_TYPES.items()], OTHER_ALERT_TYPE
    )
    severity = first_match(
        [
            (out | critical | F.col("is_critical_item"), "CRITICAL"),
            (high, "HIGH"),
            (risk == "MEDIUM_RISK", "MEDIUM"),
        ],
        "LOW",
    )
    action = first_match(
        [
            (out, F.lit(ACTION_OUT)),
            (days <= F.col("lead_time_days"), fill(ACTION_SOON, days=days)),
            (over, F.lit(ACTION_OVER)),
        ],
        F.lit(ACTION_OTHER),
    )
    values = {
        "item": F.col("item_name"),
        "place": F.col("location_name"),
        "days": days,
        "stock": closing.cast("decimal(18,2)"),
        "unit": F.col("unit_of_measure"),
        "idle": F.col("days_since_last_movement"),
    }
    message = first_match(
        [(risk == name, fill(text, **values)) for name, text in MESSAGES.items()],
        fill(OTHER_MESSAGE, **values),
    )
    return health.filter(
        risk.isin(*URGENT) | (over & (closing > F.col("avg_daily_issue") * 90))
    ).select(
        _rank().alias("_rank"),
        alert_type.alias("alert_type"),
        severity.alias("severity"),
        "location_code",
        "location_name",
        "item_code",
        "item_name",
        "item_category",
        closing.alias("current_stock"),
        "days_until_stockout",
        action.alias("recommended_action"),
        message.alias("alert_message"),
        "stock_health_score",
        "days_of_cover",
    )


def stock_alerts(health: DataFrame, slice_digits: int = 2) -> DataFrame:
    """Alerts numbered by class rank and days to stock-out; ties in hash order of the pair.

    A plain ROW_NUMBER over all alerts would sort them in one task. Instead every
    (rank, days) group is cut into slices by the first hash digits (16 slices a digit, so
    the largest group sets how many are wanted); rows are numbered inside their slice and
    shifted by the sizes of the slices and groups before it. Only the sizes of the
    groups pass through one task: one row per rank and day count, which the calendar
    bounds. ``health`` is read twice: pass a materialised frame.
    """
    order = ("_rank", "days_until_stockout", "_slice")
    pair_hash = F.md5(F.concat_ws("|", *PAIR))
    alerts = (
        _actionable(health)
        .withColumn("_hash", pair_hash)
        .withColumn("_slice", F.substring("_hash", 1, slice_digits))
    )
    sizes = alerts.groupBy(*order).agg(F.count("*").alias("_size"))
    groups = sizes.groupBy(*order[:2]).agg(F.sum("_size").alias("_size"))

    def before(window: Window) -> Column:
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_size").over(earlier), F.lit(0))

    group_offsets = groups.select(
        F.col("_rank").alias("_group_rank"),
        F.col("days_until_stockout").alias("_group_days"),
        before(Window.orderBy(*_nulls_last(order[:2]))).alias("_group_offset"),
    )
    same_group = (F.col("_rank_") == F.col("_group_rank")) & F.col(
        "days_until_stockout_"
    ).eqNullSafe(F.col("_group_days"))
    offsets = (
        sizes.select(
            *[F.col(name).alias(f"{name}_") for name in order],
            before(Window.partitionBy(*order[:2]).orderBy("_slice")).alias("_slice_offset"),
        )
        .join(group_offsets, same_group)
        .withColumn("_offset", F.col("_group_offset") + F.col("_slice_offset"))
    )
    in_slice = Window.partitionBy(*order).orderBy("_hash", "item_name", "location_name")
    same_slice = (
        (F.col("_rank") == F.col("_rank_"))
        & F.col("days_until_stockout").eqNullSafe(F.col("days_until_stockout_"))
        & (F.col("_slice") == F.col("_slice_"))
    )
    return (
        alerts.withColumn("_number", F.row_number().over(in_slice))
        .join(offsets, same_slice)
        .select(
            (F.col("_offset") + F.col("_number")).alias("alert_id"),
            F.current_timestamp().alias("alert_timestamp"),
            *ALERT_COLUMNS,
        )
    )


def stored_alerts(health: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The numbers and rows of ``stock_alerts``, from ranges of the whole order.

    The alerts are cut into ranges by their order and sorted range by range, so as many tasks share them as
    the data needs, also where one class and day count has nearly all. A row's number is its
    place in its range after the sizes of the ranges before. ``keep`` writes a frame and
    returns what it wrote: places and sizes must come from one and the same cut. The sizes
    are a row per range, at most ``spark.sql.shuffle.partitions``, hence broadcast.
    ``health`` is read twice, as ranges are sampled first: pass a materialised frame.
    """
    ties = [name for name in ALERT_COLUMNS if name not in ("days_until_stockout", "item_name", "location_name")]
    order = [
        F.col("_rank"), F.col("days_until_stockout").asc_nulls_last(), F.md5(F.concat_ws("|", *PAIR)),
        F.col("item_name"), F.col("location_name"), *map(F.col, ties),
    ]
    # Spark numbers rows by partition and, in the low 33 bits, by place in it.
    place = F.col("_place")
    ranges = keep(
        _actionable(health)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .select(
            *ALERT_COLUMNS,
            F.shiftright(place, 33).alias("_range"),
            (place.bitwiseAND(F.lit(2**33 - 1)) + 1).alias("_number"),
        )
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.groupBy("_range")
        .agg(F.count("*").alias("_size"))
        .select(
            F.col("_range").alias("_sized"),
            F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
        )
    )
    return ranges.join(F.broadcast(offsets), F.col("_range") == F.col("_sized")).select(
        (F.col("_offset") + F.col("_number")).alias("alert_id"),
        F.current_timestamp().alias("alert_timestamp"),
        *ALERT_COLUMNS,
    )


def _nulls_last(names) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in names]


def active_alerts(health: DataFrame, limit: int = ACTIVE_LIMIT) -> DataFrame:
    """The most urgent rows needing attention; the id is location name - item name."""
    return (
        health.filter(F.col("requires_attention"))
        .orderBy(
            _rank(), F.col("days_until_stockout").asc_nulls_last(), "location_code", "item_code"
        )
        .limit(limit)
        .select(
            F.concat(F.col("location_name"), F.lit("-"), F.col("item_name")).alias("alert_id"),
            "location_name",
            "item_name",
            "item_category",
            F.col("closing_stock").alias("current_stock"),
            "days_until_stockout",
            F.col("risk_classification").alias("severity"),
            "is_critical_item",
            "projected_stockout_date",
            F.current_timestamp().alias("created_at"),
        )
    )


def unacknowledged_alerts(alerts: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Alerts not yet acknowledged; taken after the limit, so the list may get shorter."""
    return alerts.join(acknowledged.select("alert_id"), "alert_id", "left_anti")


def acknowledge(alerts: DataFrame) -> DataFrame:
    """Acknowledgement records of all alerts given, ready to append."""
    return alerts.select(
        "alert_id",
        F.current_timestamp().alias("acknowledged_timestamp"),
        "location_name",
        "item_name",
        "severity",
    )


def alert_counts(open_alerts: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Open, critical and acknowledged alerts in one row."""
    return one_row(
        open_alerts.agg(
            F.count("*").alias("total_alerts"),
            count_if(F.col("severity").isin("OUT_OF_STOCK", "CRITICAL")).alias("critical_alerts"),
        ),
        acknowledged.agg(F.count_distinct("alert_id").alias("acknowledged_alerts")),
    )


def _listed(filter_text: Column, value: Column) -> Column:
    """An empty or blank filter admits everything, otherwise the value must be listed.

    Blanks around the entries of the comma list do not count.
    """
    listed = F.trim(filter_text)
    return filter_text.isNull() | (listed == "") | F.array_contains(
        F.split(listed, r"\s*,\s*"), value
    )


def configured_alerts(health: DataFrame, config: DataFrame) -> DataFrame:
    """Alerts of every active configuration row whose threshold a pair meets.

    Stock-out, critical and low-stock rows compare the days to stock-out, overstock rows
    the idle days. Expiry rows have nothing to compare with and never fire. Pair and
    configuration meet in an equi-join on the alert type.
    """
    days_left = F.when(F.col("closing_stock") <= 0, F.lit(0).cast("bigint")).otherwise(
        F.col("days_until_stockout")
    )
    idle = F.col("days_since_last_movement").cast("bigint")
    measured = F.array(
        *[
            F.struct(F.lit(kind).alias("alert_type"), value.alias("measured_days"))
            for kind, value in (
                ("STOCK_OUT", days_left),
                ("CRITICAL", days_left),
                ("LOW_STOCK", days_left),
                ("OVERSTOCK", idle),
            )
        ]
    )
    rules = config.filter(F.coalesce(F.col("is_active"), F.lit(True))).select(
        "alert_name",
        "alert_type",
        "threshold_days",
        "severity",
        "location_filter",
        "item_category_filter",
    )
    over = F.col("alert_type") == "OVERSTOCK"
    met = F.when(over, F.col("measured_days") > F.col("threshold_days")).otherwise(
        F.col("measured_days") <= F.col("threshold_days")
    )
    return (
        health.select(
            *PAIR, "location_name", "item_name", "item_category", "closing_stock",
            F.inline(measured),
        )
        .filter(F.col("measured_days").isNotNull())
        .join(rules, "alert_type")
        .filter(
            met
            & _listed(F.col("location_filter"), F.col("location_code"))
            & _listed(F.col("item_category_filter"), F.col("item_category"))
        )
        .select(
            "alert_name",
            "alert_type",
            "severity",
            *PAIR,
            "location_name",
            "item_name",
            "item_category",
            F.col("closing_stock").alias("current_stock"),
            "measured_days",
            "threshold_days",
        )
    )


def custom_item_alerts(
    health: DataFrame, thresholds: DataFrame, default_days: int = DEFAULT_THRESHOLD_DAYS
) -> DataFrame:
    """Pairs within their item's own alert threshold, or the global one."""
    own = thresholds.select("item_name", "threshold_days")
    return (
        health.join(own, "item_name", "left")
        .withColumn("threshold_days", F.coalesce(F.col("threshold_days"), F.lit(default_days)))
        .filter(F.col("days_until_stockout") <= F.col("threshold_days"))
        .select(
            *PAIR,
            "location_name",
            "item_name",
            "days_until_stockout",
            "threshold_days",
            "risk_classification",
        )
    )


def alert_history(health: DataFrame, as_of: dt.date) -> DataFrame:
    """History rows of today's alerts, ready to append."""
    return _actionable(health).select(
        F.lit(as_of).alias("alert_date"),
        *PAIR,
        "alert_type",
        "severity",
        "stock_health_score",
        "days_of_cover",
        F.current_timestamp().cast("timestamp_ntz").alias("created_timestamp"),
    )
