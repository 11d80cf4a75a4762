"""The stock formulas: cover, health score, risk class, urgency and order size."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions import nulls
from shelfwise.functions.dates import plus_days

# Fixed values of the model.
NEVER = 999  # cover and days to stock-out where nothing is being used
DEFAULT_LEAD_TIME = 7
UNLIMITED_STOCK = 999999
BUFFER = 1.5  # lead time plus 50 %
ORDER_BUFFER = 1.2  # lead-time demand plus 20 %
RISK_CLASSES = (
    "OUT_OF_STOCK",
    "CRITICAL",
    "HIGH_RISK",
    "MEDIUM_RISK",
    "OVERSTOCK",
    "SLOW_MOVING",
    "HEALTHY",
)
RISK_COLORS = ("BLACK", "DARK_RED", "RED", "ORANGE", "PURPLE", "YELLOW", "GREEN")
RISK_WEIGHTS = {"OUT_OF_STOCK": 100, "CRITICAL": 90, "HIGH_RISK": 70, "MEDIUM_RISK": 40}
LOCATION_WEIGHTS = {"HIGH": 1.3, "MEDIUM": 1.0, "LOW": 0.8}


def first_match(branches, otherwise) -> Column:
    """CASE over ``(condition, value)`` pairs, first match wins."""
    chain = F
    for condition, value in branches:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def effective_daily_issue(avg_14d: Column, avg_7d: Column, avg_30d: Column) -> Column:
    return F.coalesce(avg_14d, avg_7d, avg_30d, F.lit(0.0))


def days_of_cover(stock: Column, daily_issue: Column) -> Column:
    return F.when(daily_issue > 0, stock / daily_issue).otherwise(float(NEVER))


def days_until_stockout(stock: Column, daily_issue: Column) -> Column:
    return F.when(daily_issue > 0, F.floor(stock / daily_issue)).otherwise(
        F.lit(NEVER).cast("bigint")
    )


def projected_stockout_date(as_of: dt.date, stock: Column, daily_issue: Column) -> Column:
    return F.when(daily_issue > 0, plus_days(as_of, F.floor(stock / daily_issue)))


def health_score(cover: Column, lead_time: Column, idle_days: Column) -> Column:
    """0-100, piecewise linear in cover; 31 idle days or more always score 60."""
    half = F.nullif(lead_time * 0.5, F.lit(0.0))
    comfort = lead_time * BUFFER
    above = 80 + (cover - comfort) / F.nullif(lead_time, F.lit(0)) * 10
    return first_match(
        [
            (idle_days > 30, F.lit(60.0)),
            (cover > comfort, nulls.least(F.lit(100.0), above)),
            (cover > lead_time, 50 + (cover - lead_time) / half * 30),
            (cover > lead_time * 0.5, 25 + (cover - lead_time * 0.5) / half * 25),
            (cover > 0, cover / half * 25),
        ],
        F.lit(0.0),
    )


def _by_risk(stock, days, lead_time, idle_days, values) -> Column:
    conditions = (
        stock <= 0,
        days <= 3,
        days <= lead_time,
        days <= lead_time * BUFFER,
        idle_days > 60,
        idle_days > 30,
    )
    return first_match(zip(conditions, values), values[-1])


def risk_class(stock: Column, days: Column, lead_time: Column, idle_days: Column) -> Column:
    return _by_risk(stock, days, lead_time, idle_days, RISK_CLASSES)


def risk_color(stock: Column, days: Column, lead_time: Column, idle_days: Column) -> Column:
    return _by_risk(stock, days, lead_time, idle_days, RISK_COLORS)


def requires_attention(stock: Column, days: Column, lead_time: Column) -> Column:
    return nulls.flag((stock <= 0) | (days <= lead_time))


def is_overstock(stock: Column, daily_issue: Column, idle_days: Column) -> Column:
    return nulls.flag((idle_days > 30) & (stock > daily_issue * 60))


def traffic_light(cover: Column, lead_time: Column, buffer: float = 0.5) -> Column:
    """RED up to the lead time, YELLOW up to lead time plus buffer, else GREEN."""
    return first_match(
        [(cover <= lead_time, "RED"), (cover <= lead_time * (1 + buffer), "YELLOW")], "GREEN"
    )


def order_shortfall(
    daily_issue: Column, lead_time: Column, safety: Column, stock: Column
) -> Column:
    """Buffered lead-time demand plus safety stock, less what is in stock."""
    return daily_issue * lead_time * ORDER_BUFFER + safety - stock


def reorder_quantity(
    daily_issue: Column, lead_time: Column, safety: Column, stock: Column
) -> Column:
    need = order_shortfall(daily_issue, lead_time, safety, stock)
    return F.when(daily_issue > 0, nulls.greatest(F.lit(0.0), F.round(need, 2))).otherwise(0.0)


def order_value(
    daily_issue: Column, lead_time: Column, safety: Column, stock: Column, unit_cost: Column
) -> Column:
    need = order_shortfall(daily_issue, lead_time, safety, stock)
    return F.when(
        daily_issue > 0, nulls.greatest(F.lit(0.0), need) * F.coalesce(unit_cost, F.lit(0.0))
    ).otherwise(0.0)


def _lead_time_urgency(days: Column, lead_time: Column) -> Column:
    return 100 - days / F.nullif(lead_time, F.lit(0)) * 30


def urgency_score(stock: Column, days: Column, lead_time: Column) -> Column:
    half = F.nullif(lead_time * 0.5, F.lit(0.0))
    return first_match(
        [
            ((stock <= 0) | (days == 0), F.lit(100.0)),
            (days <= 3, F.lit(95.0)),
            (days <= lead_time, _lead_time_urgency(days, lead_time)),
            (days <= lead_time * BUFFER, 70 - (days - lead_time) / half * 20),
        ],
        F.lit(50.0),
    )


def procurement_priority(
    stock: Column, days: Column, lead_time: Column, critical: Column, location_priority: Column
) -> Column:
    """Urgency without the three-day step, raised for critical items and by location."""
    base = first_match(
        [(stock <= 0, F.lit(100.0)), (days <= lead_time, _lead_time_urgency(days, lead_time))],
        F.lit(50.0),
    )
    by_item = F.when(critical, 1.5).otherwise(1.0)
    by_location = first_match(
        [(location_priority == name, weight) for name, weight in LOCATION_WEIGHTS.items()], 1.0
    )
    return base * by_item * by_location


def risk_weight(risk: Column) -> Column:
    """Weight of a class in the location and item risk scores; other classes weigh 0."""
    return first_match([(risk == name, weight) for name, weight in RISK_WEIGHTS.items()], 0)


def movement_class(daily_issue: Column) -> Column:
    return first_match([(daily_issue > 5, "Fast Mover"), (daily_issue > 1, "Normal Mover")],
                       "Slow Mover")
