"""Display labels: bands, colours, icons and tidy names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.stock import first_match

# Fixed values.
HEX_COLORS = {
    "OUT_OF_STOCK": "#1f2937",
    "CRITICAL": "#dc2626",
    "HIGH_RISK": "#f59e0b",
    "MEDIUM_RISK": "#fbbf24",
    "HEALTHY": "#10b981",
    "OVERSTOCK": "#3b82f6",
}
DEFAULT_HEX_COLOR = "#6b7280"
ICONS = {
    "OUT_OF_STOCK": "🚫",
    "CRITICAL": "🔴",
    "HIGH_RISK": "⚠️",
    "MEDIUM_RISK": "🟡",
    "HEALTHY": "✅",
    "OVERSTOCK": "📦",
}
DEFAULT_ICON = "⚪"
SCORE_BANDS = ((80, "80+"), (60, "60-79"), (40, "40-59"))
LOWEST_BAND = "below 40"
SUMMARY_BADGES = ((80, "Excellent"), (60, "Fair"))
LOWEST_BADGE = "Critical"
MONITORING_BANDS = ((80, "Healthy"), (50, "Monitoring"))
LOWEST_MONITORING = "Critical"


def _lookup(key: Column, mapping: dict[str, str], default: str) -> Column:
    return first_match([(key == name, value) for name, value in mapping.items()], default)


def hex_color(risk: Column) -> Column:
    return _lookup(risk, HEX_COLORS, DEFAULT_HEX_COLOR)


def icon(risk: Column) -> Column:
    return _lookup(risk, ICONS, DEFAULT_ICON)


def band(score: Column, bands=SCORE_BANDS, lowest: str = LOWEST_BAND) -> Column:
    """Name of the first band whose floor the score reaches; NULL for no score."""
    return F.when(
        score.isNotNull(), first_match([(score >= floor, name) for floor, name in bands], lowest)
    )


def tidy(label: Column) -> Column:
    """``HIGH_RISK`` -> ``High Risk``."""
    return F.initcap(F.lower(F.replace(label, F.lit("_"), F.lit(" "))))


def fixed(value: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))
