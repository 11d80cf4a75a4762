"""Lists: filters, searches, sorted views and top-k reports."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.dates import within
from shelfwise.functions.nulls import number_or_zero
from shelfwise.schemas import as_double

LIST_COLUMNS = (
    "location_name",
    "item_name",
    "item_category",
    "current_stock",
    "stock_health_score",
    "risk_classification",
    "days_of_cover",
    "days_until_stockout",
    "avg_daily_issue",
    "is_critical_item",
    "requires_attention",
)
SORT_KEYS = {
    "health": "stock_health_score",
    "location": "location_name",
    "item": "item_name",
    "days": "days_until_stockout",
}
SHOW = {"all": None, "top_50": 50, "top_100": 100, "bottom_50": 50}


def health_list(
    health: DataFrame,
    location: str | None = None,
    category: str | None = None,
    risk: str | None = None,
) -> DataFrame:
    """Display columns of the pairs that pass the filters given."""
    wanted = {
        "location_name": location,
        "item_category": category,
        "risk_classification": risk,
    }
    listed = health.withColumnRenamed("closing_stock", "current_stock")
    for name, value in wanted.items():
        if value is not None:
            listed = listed.filter(F.col(name) == value)
    return listed.select(*LIST_COLUMNS, "location_code", "item_code")


def sort_and_show(listed: DataFrame, sort_by: str = "health", show: str = "all") -> DataFrame:
    """Sorted by one of four keys, then by score, location, item and codes; NULLs last.

    ``bottom_50`` is the tail of the ascending order, found as the head of the reversed
    one so that it is a top-k like the others.
    """
    keys = [SORT_KEYS[sort_by], "stock_health_score", "location_name", "item_name"]
    keys = list(dict.fromkeys([*keys, "location_code", "item_code"]))
    ascending = [F.col(key).asc_nulls_last() for key in keys]
    limit = SHOW[show]
    if show.startswith("bottom"):
        reversed_order = [F.col(key).desc_nulls_first() for key in keys]
        return listed.orderBy(*reversed_order).limit(limit).orderBy(*ascending)
    ordered = listed.orderBy(*ascending)
    return ordered if limit is None else ordered.limit(limit)


def text_search(listed: DataFrame, text: str) -> DataFrame:
    """Rows with the text in any column, ignoring case; codes are not searched."""
    shown = [F.col(name).cast("string") for name in listed.columns if not name.endswith("_code")]
    return listed.filter(F.lower(F.concat_ws(" ", *shown)).contains(text.lower()))


def _name_matches(column: Column, text: str, mode: str) -> Column:
    lowered, wanted = F.lower(column), text.lower()
    return {
        "contains": lowered.contains(wanted),
        "exact": lowered == wanted,
        "starts_with": lowered.startswith(wanted),
    }[mode]


def advanced_search(
    listed: DataFrame,
    min_stock: float = 0,
    max_stock: float = 10000,
    min_health: float = 0,
    text: str | None = None,
    mode: str = "contains",
    show_healthy: bool = True,
) -> DataFrame:
    """Stock range, least score, and text in the item or location name.

    ``mode`` is contains, exact or starts_with, all ignoring case.
    """
    conditions = [
        F.col("current_stock").between(min_stock, max_stock),
        F.col("stock_health_score") >= min_health,
    ]
    if text:
        conditions.append(
            _name_matches(F.col("item_name"), text, mode)
            | _name_matches(F.col("location_name"), text, mode)
        )
    if not show_healthy:
        conditions.append(F.col("risk_classification") != "HEALTHY")
    return listed.filter(reduce(lambda a, b: a & b, conditions))


def low_stock_today(
    daily: DataFrame, as_of: dt.date, threshold: float = 100, limit: int = 20
) -> DataFrame:
    """Lowest closing stocks of the day below the threshold."""
    return (
        daily.filter(
            (F.col("record_date") == F.lit(as_of)) & (F.col("closing_stock") < threshold)
        )
        .withColumns(as_double("closing_stock"))
        .orderBy("closing_stock", "location_code", "item_code")
        .limit(limit)
        .select("location_name", "item_name", "closing_stock", "record_date")
    )


def recent_records(
    daily: DataFrame, as_of: dt.date, days: int = 7, limit: int = 50
) -> DataFrame:
    """Records of the last days by location and item, newest first."""
    return (
        daily.filter(within(F.col("record_date"), as_of, days))
        .withColumns(as_double("closing_stock", "issues"))
        .orderBy("location_code", "item_code", F.col("record_date").desc())
        .limit(limit)
        .select("location_name", "item_name", "record_date", "closing_stock", "issues")
    )


def _top(listed: DataFrame, name: str, value: str, order: Column, k: int) -> DataFrame:
    """One report list: its k rows, numbered in order."""
    first = (
        listed.withColumn("_value", F.col(value).cast("double"))
        .orderBy(order, "location_name", "item_name")
        .limit(k)
    )
    # numbering k collected structs keeps the order without a global window
    ranked = first.agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (-F.col("_sort") if name in _DESCENDING else F.col("_sort")).alias("s"),
                    "location_name",
                    "item_name",
                    F.col("_value").alias("value"),
                )
            )
        ).alias("rows")
    )
    numbered = ranked.select(
        F.lit(name).alias("list"), F.posexplode("rows").alias("pos", "row")
    )
    return numbered.select(
        "list",
        (F.col("pos") + 1).alias("rank"),
        F.col("row.location_name").alias("location_name"),
        F.col("row.item_name").alias("item_name"),
        F.col("row.value").alias("value"),
    )


_DESCENDING = (
    "healthiest_locations",
    "best_managed_items",
    "optimal_coverage",
    "overstock_items",
    "fast_movers",
)


def top_bottom_performers(health: DataFrame, k: int = 5) -> DataFrame:
    """The report lists of best and worst locations and items, k rows each.

    Read several times: pass a materialised frame.
    """
    numbers = health.select(
        "location_name",
        "item_name",
        "risk_classification",
        *[
            number_or_zero(F.col(name)).alias(name)
            for name in ("stock_health_score", "closing_stock", "days_of_cover", "avg_daily_issue")
        ],
    )
    risk, score, cover = F.col("risk_classification"), "stock_health_score", F.col("days_of_cover")
    by_location = (
        numbers.filter(F.col("location_name").isNotNull())
        .groupBy("location_name")
        .agg(F.avg(score).alias(score))
        .withColumn("item_name", F.lit(None).cast("string"))
    )
    exposed = risk.isin("CRITICAL", "OUT_OF_STOCK")
    reports = [
        ("healthiest_locations", by_location, score, score),
        ("locations_needing_support", by_location, score, score),
        ("best_managed_items", numbers.filter(risk == "HEALTHY"), score, score),
        ("optimal_coverage", numbers.filter(cover.between(30, 90)), "days_of_cover",
         "days_of_cover"),
        ("most_critical_items", numbers.filter(exposed), score, "closing_stock"),
        ("overstock_items", numbers.filter(risk == "OVERSTOCK"), "days_of_cover",
         "days_of_cover"),
        ("fast_movers", numbers.filter(F.col("avg_daily_issue") > 5), "avg_daily_issue",
         "avg_daily_issue"),
    ]
    lists = []
    for name, source, sort, shown in reports:
        key = F.col("_sort").desc() if name in _DESCENDING else F.col("_sort").asc()
        lists.append(_top(source.withColumn("_sort", F.col(sort)), name, shown, key, k))
    return reduce(DataFrame.unionByName, lists)
