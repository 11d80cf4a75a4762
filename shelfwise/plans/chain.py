"""The chain from daily records to reports, as temp views or as written tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from shelfwise.operators import alerts, rollups
from shelfwise.operators.consumption import consumption_metrics
from shelfwise.operators.health import classify, join_metrics, stock_health_metrics
from shelfwise.operators.positions import latest_stock_position
from shelfwise.operators.reorder import reorder_recommendations
from shelfwise.sources.derive import StockTables

# Written in this order; each reads the ones before it.
WRITTEN_TABLES = (
    "latest_stock_position",
    "consumption_metrics",
    "stock_health_classification",
    "reorder_recommendations",
    "location_risk_summary",
    "executive_summary",
)


def build_views(tables: StockTables, as_of: dt.date) -> dict[str, DataFrame]:
    """All analytic views of the chain, lazily."""
    position = latest_stock_position(tables.daily)
    consumption = consumption_metrics(tables.daily, as_of)
    metrics = stock_health_metrics(
        tables.daily, tables.items, tables.locations, tables.params, as_of
    )
    return {
        "v_latest_stock_position": position,
        "v_consumption_metrics": consumption,
        "v_stock_health_metrics": metrics,
        **_after_classification(classify(metrics), tables, as_of),
    }


def _after_classification(
    health: DataFrame, tables: StockTables, as_of: dt.date
) -> dict[str, DataFrame]:
    return {
        "v_stock_health_classification": health,
        "v_reorder_recommendations": reorder_recommendations(health, tables.items, as_of),
        "v_location_risk_summary": rollups.location_risk_summary(health),
        "v_item_risk_summary": rollups.item_risk_summary(health),
        "v_executive_summary": rollups.executive_summary(health, tables.items),
        "stock_alerts": alerts.stock_alerts(health),
    }


def register_views(tables: StockTables, as_of: dt.date) -> list[str]:
    """Base tables and views as temp views, so that SQL written against them runs as is."""
    views = {
        "daily_stock_raw": tables.daily,
        "item_master": tables.items,
        "location_master": tables.locations,
        "item_location_params": tables.params,
        **build_views(tables, as_of),
    }
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return list(views)


def write_tables(tables: StockTables, as_of: dt.date, root: str) -> dict[str, str]:
    """Full refresh: writes each table once, later ones reading the earlier from disk.

    One folder per as-of date. Nothing written is read and overwritten in one job, and a
    failed run is repeated from the start.
    """
    spark = tables.daily.sparkSession
    folder = f"{root.rstrip('/')}/as_of={as_of.isoformat()}"

    def write(name: str, frame: DataFrame) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    position = write("latest_stock_position", latest_stock_position(tables.daily))
    consumption = write("consumption_metrics", consumption_metrics(tables.daily, as_of))
    health = write(
        "stock_health_classification",
        classify(
            join_metrics(
                position, consumption, tables.items, tables.locations, tables.params, as_of
            )
        ),
    )
    write("reorder_recommendations", reorder_recommendations(health, tables.items, as_of))
    write("location_risk_summary", rollups.location_risk_summary(health))
    write("executive_summary", rollups.executive_summary(health))
    return {name: f"{folder}/{name}" for name in WRITTEN_TABLES}


def register_written(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """The written tables as ``dt_`` views, plus the alert view over them."""
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(f"dt_{name}")
    alerts.stock_alerts(spark.table("dt_stock_health_classification")).createOrReplaceTempView(
        "stock_alerts"
    )
    return [*[f"dt_{name}" for name in paths], "stock_alerts"]
