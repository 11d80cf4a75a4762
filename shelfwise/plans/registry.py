"""Named queries over the order tables of a data folder.

Each takes ``(spark, sf_dir)`` and returns a DataFrame. Values that depend on the order
of summation are rounded here, not in the operators. A frame that several branches of
one query read is written to the shared folder first.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise import schemas
from shelfwise.functions.dates import utc_date, utc_instant
from shelfwise.functions.nulls import number_or_zero
from shelfwise.operators import (
    alerts,
    consumption,
    costs,
    explore,
    health,
    ledger,
    positions,
    quality,
    reorder,
    rollups,
    scenarios,
    transfers,
)
from shelfwise.plans.workspace import materialise, own_folder, work_path
from shelfwise.sources import derive, messy, readers, seed, writers
from shelfwise.streaming.changes import change_capture
from shelfwise.streaming.consumption import open_windows, running_consumption
from shelfwise.streaming.late import ConsumptionLog
from shelfwise.streaming.refresh import StockRefresh

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Parameters of the registered queries.
CALENDAR_DAYS = 60
RETENTION_DAYS = 365
COMPARED_LOCATIONS = ("NATION_1", "NATION_5", "NATION_12", "NATION_20")
SCENARIOS = ((0, 0, 100), (25, 0, 100), (-50, 50, 80), (100, 100, 200), (33, -25, 150))
SEARCH_TEXT = "Food_Gr"
EARLIER_DAYS = 10
CUSTOM_THRESHOLDS = (("Item 03", 14), ("Item 08", 30), ("Item 17", 2))


@dataclass(frozen=True)
class Stock:
    """The stock tables of a data folder and what is computed from them."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def as_of(self) -> dt.date:
        return derive.as_of_date(self.spark, self.sf_dir)

    @cached_property
    def tables(self) -> derive.StockTables:
        return derive.load_tables(self.spark, self.sf_dir)

    @property
    def daily(self) -> DataFrame:
        return self.tables.daily

    @property
    def items(self) -> DataFrame:
        return self.tables.items

    @property
    def locations(self) -> DataFrame:
        return self.tables.locations

    @cached_property
    def metrics(self) -> DataFrame:
        return health.stock_health_metrics(
            self.daily, self.items, self.locations, self.tables.params, self.as_of
        )

    @cached_property
    def health(self) -> DataFrame:
        return health.classify(self.metrics)

    @cached_property
    def written_health(self) -> DataFrame:
        return materialise(self.health, "health")

    def recommendations(self, classified: DataFrame | None = None) -> DataFrame:
        return reorder.reorder_recommendations(
            self.health if classified is None else classified, self.items, self.as_of
        )

    def queue(self, classified: DataFrame | None = None) -> DataFrame:
        return reorder.reorder_queue(self.recommendations(classified))

    def listed(self) -> DataFrame:
        return explore.health_list(self.health)


def query(build: Callable[[Stock], DataFrame]) -> Callable[[Stock], DataFrame]:
    """Registers a query under its function name."""


    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own_folder(spark)
        return build(Stock(spark, sf_dir))

    _QUERIES[build.__name__] = run
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


# --- core -----------------------------------------------------------------------------


@query
def latest_stock_position(stock: Stock) -> DataFrame:
    return positions.latest_stock_position(stock.daily)


@query
def consumption_metrics(stock: Stock) -> DataFrame:
    return _rounded(
        consumption.consumption_metrics(stock.daily, stock.as_of),
        6,
        "stddev_issues_7d",
        "stddev_issues_14d",
        "stddev_issues_30d",
    )


@query
def consumption_by_codes(stock: Stock) -> DataFrame:
    return _rounded(
        consumption.consumption_metrics(stock.daily, stock.as_of, group_by_codes_only=True),
        6,
        "stddev_issues_7d",
        "stddev_issues_14d",
        "stddev_issues_30d",
    )


@query
def stock_health_metrics(stock: Stock) -> DataFrame:
    return stock.metrics


@query
def stock_health_classification(stock: Stock) -> DataFrame:
    return stock.health.drop("calculated_timestamp")


@query
def movement_velocity(stock: Stock) -> DataFrame:
    return health.movement_velocity(stock.health)


@query
def health_bands(stock: Stock) -> DataFrame:
    return health.health_bands(stock.health)


@query
def capacity_overstock(stock: Stock) -> DataFrame:
    return health.capacity_overstock(stock.health)


# --- reorder and cost -----------------------------------------------------------------


@query
def reorder_recommendations(stock: Stock) -> DataFrame:
    return stock.recommendations()


@query
def reorder_queue(stock: Stock) -> DataFrame:
    return stock.queue()


@query
def queue_totals(stock: Stock) -> DataFrame:
    return _rounded(
        reorder.queue_totals(stock.queue()), 4, "total_reorder_value", "avg_priority_score"
    )


@query
def cost_savings(stock: Stock) -> DataFrame:
    classified = stock.written_health
    return _rounded(
        costs.cost_metrics(stock.queue(classified), classified),
        4,
        "total_reorder_value",
        "critical_value",
        "potential_savings",
        "stockout_prevention",
        "net_benefit",
        "roi_pct",
        "avg_order_value",
        "avg_daily_investment",
        "turnover_rate_pct",
        "efficiency_score",
    )


@query
def cost_by_category(stock: Stock) -> DataFrame:
    return _rounded(costs.cost_by_category(stock.queue()), 4, "estimated_order_value")


@query
def cost_by_location(stock: Stock) -> DataFrame:
    return _rounded(costs.cost_by_location(stock.queue()), 4, "estimated_order_value")


@query
def cost_insights(stock: Stock) -> DataFrame:
    return costs.cost_insights(stock.queue())


@query
def stock_projection(stock: Stock) -> DataFrame:
    return scenarios.stock_projection(stock.health)


@query
def scenario_summary(stock: Stock) -> DataFrame:
    classified = stock.written_health
    return _rounded(
        scenarios.scenario_summary(classified, stock.queue(classified), SCENARIOS),
        4,
        "budget_required",
    )


@query
def location_parameters(stock: Stock) -> DataFrame:
    return scenarios.location_parameters(stock.locations, stock.items)


@query
def demand_forecast(stock: Stock) -> DataFrame:
    return _rounded(
        consumption.demand_forecast(stock.daily, stock.as_of),
        6,
        "forecast_daily_issue",
        "forecast_cumulative_issue",
    )


@query
def transfer_suggestions(stock: Stock) -> DataFrame:
    return transfers.transfer_suggestions(stock.written_health)


# --- roll-ups -------------------------------------------------------------------------


@query
def location_risk_summary(stock: Stock) -> DataFrame:
    return rollups.location_risk_summary(stock.health)


@query
def item_risk_summary(stock: Stock) -> DataFrame:
    return _rounded(rollups.item_risk_summary(stock.health), 6, "total_daily_consumption")


@query
def executive_summary(stock: Stock) -> DataFrame:
    return _rounded(
        rollups.executive_summary(stock.health, stock.items).drop("report_generated_timestamp"),
        4,
        "total_estimated_order_value",
    )


@query
def location_comparison(stock: Stock) -> DataFrame:
    return _rounded(
        rollups.location_comparison(stock.health, COMPARED_LOCATIONS),
        6,
        "avg_health",
        "avg_days_cover",
    )


@query
def risk_counts(stock: Stock) -> DataFrame:
    return rollups.risk_counts(stock.health)


@query
def location_risk_counts(stock: Stock) -> DataFrame:
    return rollups.location_risk_counts(stock.health)


@query
def location_risk_matrix(stock: Stock) -> DataFrame:
    return rollups.location_risk_matrix(stock.health)


@query
def location_item_matrix(stock: Stock) -> DataFrame:
    return rollups.location_item_matrix(stock.health)


@query
def category_performance(stock: Stock) -> DataFrame:
    return _rounded(rollups.category_performance(stock.health), 6, "avg_health_score")


@query
def critical_items_report(stock: Stock) -> DataFrame:
    report = writers.named_reports(stock.health)["critical_items"]
    return writers.rounded(report.drop("calculated_timestamp"))


@query
def location_performance(stock: Stock) -> DataFrame:
    return rollups.location_performance(stock.health)


@query
def health_histogram(stock: Stock) -> DataFrame:
    return rollups.health_histogram(stock.health)


@query
def list_summary(stock: Stock) -> DataFrame:
    return _rounded(rollups.list_summary(stock.listed()), 6, "avg_health")


@query
def overall_performance(stock: Stock) -> DataFrame:
    return _rounded(
        rollups.overall_performance(stock.health),
        6,
        "healthy_pct",
        "critical_pct",
        "avg_coverage_days",
    )


@query
def filter_values(stock: Stock) -> DataFrame:
    return rollups.filter_values(stock.health)


@query
def smart_recommendations(stock: Stock) -> DataFrame:
    return rollups.smart_recommendations(stock.health)


@query
def summary_kpis(stock: Stock) -> DataFrame:
    classified = stock.written_health
    return _rounded(
        rollups.summary_kpis(rollups.executive_summary(classified), stock.queue(classified)),
        4,
        "reorder_value",
        "critical_item_pct",
        "critical_progress",
        "attention_progress",
        "cover_progress",
    )


@query
def parent_category_rollup(stock: Stock) -> DataFrame:
    return _rounded(
        rollups.parent_category_rollup(stock.health, seed.item_categories(stock.spark)),
        6,
        "avg_health_score",
    )


@query
def location_ranking(stock: Stock) -> DataFrame:
    summary = materialise(rollups.location_risk_summary(stock.health), "locations")
    return rollups.location_ranking(summary)


# --- ledger ---------------------------------------------------------------------------


@query
def stock_ledger(stock: Stock) -> DataFrame:
    return stock.daily.select(
        "record_date", "location_code", "item_code", "opening_stock", "receipts", "issues",
        "closing_stock",
    )


@query
def dense_calendar(stock: Stock) -> DataFrame:
    start = stock.as_of - dt.timedelta(days=CALENDAR_DAYS - 1)
    return ledger.dense_calendar(stock.daily, start, stock.as_of)


def _corrected(stock: Stock, daily: DataFrame) -> DataFrame:
    def pair(location: str, item: str):
        return (F.col("location_code") == location) & (F.col("item_code") == item)

    today = F.col("record_date") == F.lit(stock.as_of)
    lately = F.col("record_date") >= F.lit(stock.as_of - dt.timedelta(days=40))
    steps = [
        (
            pair("LOC001", "Brand#13") & today,
            {"issues": F.col("closing_stock") + 10, "closing_stock": F.lit(-10.0)},
        ),
        (F.col("closing_stock") < 0, {"closing_stock": F.lit(0.0)}),
        (pair("LOC002", "Brand#7") & today, {"closing_stock": F.lit(50.0)}),
        (
            pair("LOC005", "Brand#3") & lately,
            {"issues": F.lit(0.0), "receipts": F.lit(0.0)},
        ),
    ]
    for where, assignments in steps:
        daily = positions.conditional_update(daily, where, assignments)
    return daily


@query
def corrected_records(stock: Stock) -> DataFrame:
    return _corrected(stock, stock.daily).select(
        "record_date", "location_code", "item_code", "receipts", "issues", "closing_stock"
    )


# --- lists ----------------------------------------------------------------------------


@query
def health_list(stock: Stock) -> DataFrame:
    return explore.sort_and_show(stock.listed())


@query
def bottom_list(stock: Stock) -> DataFrame:
    return explore.sort_and_show(stock.listed(), "days", "bottom_50")


@query
def text_search(stock: Stock) -> DataFrame:
    return explore.text_search(stock.listed(), SEARCH_TEXT)


@query
def advanced_search(stock: Stock) -> DataFrame:
    return explore.advanced_search(
        stock.listed(), 50, 900, 40, "item 1", "starts_with", show_healthy=False
    )


@query
def low_stock_today(stock: Stock) -> DataFrame:
    return explore.low_stock_today(stock.daily, stock.as_of)


@query
def recent_records(stock: Stock) -> DataFrame:
    return explore.recent_records(stock.daily, stock.as_of)


@query
def top_bottom_performers(stock: Stock) -> DataFrame:
    return _rounded(explore.top_bottom_performers(stock.written_health), 4, "value")


# --- alerts ---------------------------------------------------------------------------


@query
def stock_alerts(stock: Stock) -> DataFrame:
    return alerts.stock_alerts(stock.written_health).drop("alert_timestamp")


@query
def stored_alerts(stock: Stock) -> DataFrame:
    """The same alerts, numbered by ranges of the whole order."""
    found = alerts.stored_alerts(stock.written_health, lambda rows: materialise(rows, "alerts"))
    return found.drop("alert_timestamp")


@query
def active_alerts(stock: Stock) -> DataFrame:
    return alerts.active_alerts(stock.health).drop("created_at")


def _acknowledged(active: DataFrame) -> DataFrame:
    return active.filter(F.col("is_critical_item")).select("alert_id")


@query
def unacknowledged_alerts(stock: Stock) -> DataFrame:
    active = alerts.active_alerts(stock.written_health).drop("created_at")
    return alerts.unacknowledged_alerts(active, _acknowledged(active))


@query
def alert_counts(stock: Stock) -> DataFrame:
    active = alerts.active_alerts(stock.written_health)
    acknowledged = _acknowledged(active)
    return alerts.alert_counts(alerts.unacknowledged_alerts(active, acknowledged), acknowledged)


@query
def configured_alerts(stock: Stock) -> DataFrame:
    return alerts.configured_alerts(stock.health, seed.alert_config(stock.spark))


@query
def custom_item_alerts(stock: Stock) -> DataFrame:
    thresholds = readers.literal_rows(
        stock.spark,
        [{"item_name": name, "threshold_days": days} for name, days in CUSTOM_THRESHOLDS],
        StructType.fromDDL("item_name string, threshold_days int"),
    )
    return alerts.custom_item_alerts(stock.health, thresholds)


@query
def alert_history(stock: Stock) -> DataFrame:
    return alerts.alert_history(stock.health, stock.as_of).drop("created_timestamp")


# --- quality --------------------------------------------------------------------------


@query
def quality_verdict(stock: Stock) -> DataFrame:
    return quality.quality_verdict(stock.daily, stock.as_of)


@query
def date_gaps(stock: Stock) -> DataFrame:
    return ledger.date_gaps(stock.daily)


@query
def duplicate_records(stock: Stock) -> DataFrame:
    """Order lines of one day, location and item are the copies here."""
    lines = derive.shipments(stock.spark, stock.sf_dir)
    return quality.duplicate_records(lines, "record_date", "nation", "brand").select(
        "record_date",
        derive.location_code(F.col("nation")).alias("location_code"),
        derive.item_code(F.col("brand")).alias("item_code"),
        "copies",
    )


@query
def data_profile(stock: Stock) -> DataFrame:
    return quality.data_profile(stock.daily, stock.as_of)


@query
def master_checks(stock: Stock) -> DataFrame:
    return quality.master_checks(stock.locations, stock.items)


@query
def rule_violations(stock: Stock) -> DataFrame:
    return quality.rule_violations(stock.daily, stock.as_of)


def _earlier(stock: Stock) -> dt.date:
    """A date before the newest records, which are then future records."""
    return stock.as_of - dt.timedelta(days=EARLIER_DAYS)


def _rule_table(stock: Stock) -> DataFrame:
    rows = [
        {"rule_name": rule.name, "rule_type": rule.kind, "rule_sql": rule.predicate,
         "severity": rule.severity, "is_active": True}
        for rule in quality.DEFAULT_RULES
    ]
    rows.append({"rule_name": "Switched off", "rule_type": "ANOMALY", "rule_sql": "true",
                 "severity": "LOW", "is_active": False})
    schema = "rule_name string, rule_type string, rule_sql string, severity string, is_active boolean"
    return readers.literal_rows(stock.spark, rows, StructType.fromDDL(schema))


@query
def messy_quality_verdict(stock: Stock) -> DataFrame:
    return quality.quality_verdict(messy.messy_records(stock.daily), _earlier(stock))


@query
def messy_data_profile(stock: Stock) -> DataFrame:
    return quality.data_profile(messy.messy_records(stock.daily), _earlier(stock))


@query
def messy_rule_violations(stock: Stock) -> DataFrame:
    """Rules from a rule table, over records that break every one of them."""
    records = messy.messy_records(stock.daily)
    return quality.rule_violations(records, _earlier(stock), _rule_table(stock))


@query
def messy_duplicate_rows(stock: Stock) -> DataFrame:
    rows = quality.duplicate_rows(messy.messy_records(stock.daily))
    return rows.select("record_date", "location_code", "item_code", "closing_stock")


@query
def messy_verdict_flag(stock: Stock) -> DataFrame:
    return quality.is_valid(
        quality.quality_verdict(messy.messy_records(stock.daily), _earlier(stock))
    )


@query
def messy_master_checks(stock: Stock) -> DataFrame:
    return quality.master_checks(
        messy.messy_locations(stock.locations), messy.messy_items(stock.items)
    )


@query
def missing_columns_verdict(stock: Stock) -> DataFrame:
    """The verdict of records that lack two required columns."""
    return quality.quality_verdict(stock.daily.drop("receipts", "item_code"), stock.as_of)


@query
def messy_validation_report(stock: Stock) -> DataFrame:
    """The lines of the readable report."""
    verdict = quality.quality_verdict(messy.messy_records(stock.daily), _earlier(stock))
    lines = quality.validation_report(verdict).split("\n")
    rows = [{"line_no": n, "line": line} for n, line in enumerate(lines, 1)]
    return readers.literal_rows(stock.spark, rows, StructType.fromDDL("line_no int, line string"))


@query
def latest_of_tied_records(stock: Stock) -> DataFrame:
    """Latest order line per location and item; lines of one day tie and ids pass 2^40."""
    lines = derive.shipments(stock.spark, stock.sf_dir)
    records = lines.select(
        "record_date",
        derive.location_code(F.col("nation")).alias("location_code"),
        derive.item_code(F.col("brand")).alias("item_code"),
        *[F.lit("x").alias(name) for name in positions.DESCRIPTION],
        F.col("issues").alias("closing_stock"),
        F.lit(7).alias("lead_time_days"),
        (F.col("issues").cast("bigint") * F.lit(2**36) - F.lit(2**40)).alias("stock_record_id"),
    )
    return positions.latest_stock_position(records).select(
        "location_code", "item_code", "latest_date", "closing_stock"
    )


@query
def text_numbers(stock: Stock) -> DataFrame:
    """Text to number, where some of the texts are none."""
    part = stock.spark.read.parquet(f"{stock.sf_dir}/part.parquet")
    return part.select(
        "p_partkey",
        number_or_zero(F.col("p_brand")).alias("of_brand"),
        number_or_zero(F.substring("p_brand", 7, 9)).alias("of_number"),
    )


@query
def filtered_health_list(stock: Stock) -> DataFrame:
    return explore.health_list(
        stock.health, location="NATION_9", category="MEDICINE_ANTIBIOTIC", risk="HEALTHY"
    )


@query
def low_stock_wide(stock: Stock) -> DataFrame:
    """The lowest stocks of the last day below a threshold that some are below."""
    return explore.low_stock_today(stock.daily, stock.as_of, threshold=1_000)


@query
def table_summary(stock: Stock) -> DataFrame:
    return writers.table_summary(
        {
            "Daily Stock Records": stock.daily,
            "Locations": stock.locations,
            "Items": stock.items,
        },
        {"Daily Stock Records": "record_date"},
    )


# --- sources, sinks and streams -------------------------------------------------------

_EXPORTED = (
    "record_date",
    "location_code",
    "location_name",
    "item_code",
    "item_name",
    "opening_stock",
    "receipts",
    "issues",
    "closing_stock",
    "unit_of_measure",
)


@query
def csv_round_trip(stock: Stock) -> DataFrame:
    """Exports the daily records as CSV and reads them back by the declared schema."""
    path = work_path(stock.spark, "csv")
    writers.export_csv(stock.daily.select(*_EXPORTED), path)
    fields = schemas.DAILY_STOCK
    schema = type(fields)([fields[name] for name in _EXPORTED])
    back = readers.read_stock_csv(stock.spark, path, schema, schemas.DAILY_STOCK_DEFAULTS)
    return back.withColumns(schemas.as_double(*schemas.MEASURES))


@query
def archived_records(stock: Stock) -> DataFrame:
    old, _ = writers.split_by_retention(stock.daily, stock.as_of, RETENTION_DAYS)
    return old.select("record_date", "location_code", "item_code", "issues", "closing_stock")


@query
def json_round_trip(stock: Stock) -> DataFrame:
    """Writes the daily records as JSON and reads them back by the declared schema."""
    path = work_path(stock.spark, "json")
    fields = schemas.DAILY_STOCK
    stock.daily.select(*_EXPORTED).write.json(path)
    back = readers.read_json(stock.spark, path, StructType([fields[n] for n in _EXPORTED]), multi_line=False)
    return back.withColumns(schemas.as_double(*schemas.MEASURES))


@query
def json_array_round_trip(stock: Stock) -> DataFrame:
    """Writes the daily records as JSON arrays and unpacks these."""
    path = work_path(stock.spark, "json_arrays")
    fields = schemas.DAILY_STOCK
    writers.write_json_arrays(stock.daily.select(*_EXPORTED), path)
    back = readers.read_json(stock.spark, path, StructType([fields[n] for n in _EXPORTED]), multi_line=False)
    return back.withColumns(schemas.as_double(*schemas.MEASURES))


@query
def defaults_on_load(stock: Stock) -> DataFrame:
    """Loads files that lack the last columns of the declared schema."""
    path = work_path(stock.spark, "csv")
    writers.export_csv(stock.daily.select(*_EXPORTED[:-2]), path)
    fields = schemas.DAILY_STOCK
    schema = StructType([fields[name] for name in (*_EXPORTED, "lead_time_days")])
    back = readers.read_stock_csv(stock.spark, path, schema, schemas.DAILY_STOCK_DEFAULTS)
    return back.withColumns(schemas.as_double(*schemas.MEASURES))


@query
def footer_summary(stock: Stock) -> DataFrame:
    """Rows and dates of the stored daily records from their file footers."""
    path = work_path(stock.spark, "folder")
    writers.append_daily_stock(stock.daily, path, by_date=False)
    return writers.footer_summary(stock.spark, path, "record_date")


@query
def bucketed_health(stock: Stock) -> DataFrame:
    """Classified stock over records stored in buckets by pair."""
    path = work_path(stock.spark, "by_pair")
    table = f"daily_by_pair_{path.rsplit('-', 1)[1]}"
    stored = writers.store_by_pair(stock.daily, table, path, buckets=16)
    tables = stock.tables
    found = health.stock_health_classification(
        stored, tables.items, tables.locations, tables.params, stock.as_of
    )
    return found.drop("calculated_timestamp")


@query
def archived_partitions(stock: Stock) -> DataFrame:
    """Records and dates per part after moving the old days of a table stored by date."""
    table, archived = work_path(stock.spark, "by_date"), work_path(stock.spark, "archive")
    writers.append_daily_stock(stock.daily, table, by_date=True)
    for _ in range(2):
        writers.archive_partitions(stock.spark, table, archived, stock.as_of, RETENTION_DAYS)
    parts = [
        stock.spark.read.schema(stock.daily.schema)
        .parquet(path)
        .agg(
            F.count("*").alias("records"),
            F.sum("issues").alias("issues"),
            F.min("record_date").alias("first_date"),
            F.max("record_date").alias("last_date"),
        )
        .withColumn("part", F.lit(name))
        for name, path in (("archived", archived), ("kept", table))
    ]
    return parts[0].unionByName(parts[1])


@query
def folder_round_trip(stock: Stock) -> DataFrame:
    """Loads the daily records by date and reads the folder."""
    path = work_path(stock.spark, "folder")
    writers.append_daily_stock(stock.daily.select(*_EXPORTED), path, by_date=False)
    back = readers.read_folder(stock.spark, path, stock.daily.select(*_EXPORTED).schema)
    return back.withColumns(schemas.as_double(*schemas.MEASURES))


@query
def archive_written(stock: Stock) -> DataFrame:
    """Records per part after archiving twice."""
    archived, kept = work_path(stock.spark, "archive"), work_path(stock.spark, "kept")
    for _ in range(2):
        writers.archive(stock.daily, stock.as_of, RETENTION_DAYS, archived, kept)
    parts = [
        stock.spark.read.parquet(path).agg(F.count("*").alias("records")).withColumn("part", F.lit(name))
        for name, path in (("archived", archived), ("kept", kept))
    ]
    return parts[0].unionByName(parts[1])


@query
def audit_log(stock: Stock) -> DataFrame:
    """Audit rows of the pairs whose class the record date's change would note."""
    changes = stock.health.filter(F.col("requires_attention")).select(
        "location_code",
        "item_code",
        F.struct("item_name").alias("old_value"),
        F.struct("risk_classification").alias("new_value"),
    )
    path = work_path(stock.spark, "audit")
    writers.append_rows(writers.audit_events(changes, "STATUS", "class", "job"), path)
    return stock.spark.read.parquet(path).drop("event_timestamp")


@query
def acknowledged_alerts(stock: Stock) -> DataFrame:
    active = alerts.active_alerts(stock.health).filter(F.col("is_critical_item"))
    return alerts.acknowledge(active).select("alert_id")


@query
def action_status(stock: Stock) -> DataFrame:
    """The newest action per location, item and order reference, orders as actions."""
    lines = stock.spark.read.parquet(f"{stock.sf_dir}/lineitem.parquet")
    actions = lines.select(
        F.concat(F.lit("L"), F.col("l_suppkey") % 10).alias("location_code"),
        F.concat(F.lit("I"), F.col("l_partkey") % 20).alias("item_code"),
        F.when(F.col("l_orderkey") % 3 > 0, F.concat(F.lit("PO"), F.col("l_orderkey") % 50)).alias(
            "order_reference"
        ),
        F.to_date("l_shipdate").alias("action_date"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("action_id"),
        F.col("l_linestatus").alias("status"),
    )
    return writers.latest_status(actions)


@query
def procurement_actions(stock: Stock) -> DataFrame:
    return writers.procurement_actions(stock.recommendations(), stock.as_of)


@query
def change_captured(stock: Stock) -> DataFrame:
    """From all records but the last week to the corrected records of the last year."""
    columns = ("record_date", "location_code", "item_code", "receipts", "issues", "closing_stock")
    daily = materialise(stock.daily.select(*columns), "daily")
    before = daily.filter(F.col("record_date") < F.lit(stock.as_of - dt.timedelta(days=7)))
    _, after = writers.split_by_retention(_corrected(stock, daily), stock.as_of, RETENTION_DAYS)
    return change_capture(before, after, ("record_date", "location_code", "item_code"))


def _refresher(stock: Stock) -> StockRefresh:
    """A fact folder filled with the daily records and an empty set of refreshed tables."""
    facts = work_path(stock.spark, "facts")
    writers.append_daily_stock(stock.daily, facts, by_date=False)
    return StockRefresh(
        spark=stock.spark,
        fact_path=facts,
        fact_schema=stock.daily.schema,
        root=work_path(stock.spark, "refreshed"),
        items=materialise(stock.items, "items"),
        locations=materialise(stock.locations, "locations"),
        params=materialise(stock.tables.params, "params"),
        as_of=stock.as_of,
        buckets=8,
    )


@query
def stream_refresh(stock: Stock) -> DataFrame:
    """Classified stock after streaming all records in, several files per batch."""
    refresh = _refresher(stock)
    refresh.start(every=None, files_per_batch=4).awaitTermination()
    return refresh.health().drop("calculated_timestamp")


@query
def stream_changes(stock: Stock) -> DataFrame:
    """What the change feed of all batches adds up to: one copy of every classified pair."""
    refresh = _refresher(stock)
    refresh.start(every=None, files_per_batch=2).awaitTermination()
    feed = refresh.changes()
    logged = ("version", "batch_id", "change_type", "action", "copies")
    columns = [name for name in feed.columns if name not in logged]
    signed = F.when(F.col("action") == "INSERT", F.col("copies")).otherwise(-F.col("copies"))
    return feed.groupBy(*columns).agg(F.sum(signed).alias("copies")).filter("copies != 0")


@query
def refreshed_consumption(stock: Stock) -> DataFrame:
    """Consumption from the day partials that the batches of a stream left."""
    refresh = _refresher(stock)
    refresh.start(every=None, files_per_batch=2).awaitTermination()
    partials = refresh.tables.read(refresh.tables.version(), "partials")
    return _rounded(
        consumption.metrics_of_partials(partials, stock.as_of),
        6,
        "stddev_issues_7d",
        "stddev_issues_14d",
        "stddev_issues_30d",
    )


@query
def published_rollup(stock: Stock) -> DataFrame:
    """Location risk as published behind the last version of the stream."""
    refresh = _refresher(stock)
    refresh.start(every=None, files_per_batch=4).awaitTermination()
    for follower in refresh.start_rollups({"location_risk_summary": "once"}).values():
        follower.awaitTermination()
    return refresh.rollup_table("location_risk_summary")


@query
def stream_alerts(stock: Stock) -> DataFrame:
    """Alerts logged while all records stream in as one batch."""
    refresh = _refresher(stock)
    refresh.start(every=None).awaitTermination()
    return refresh.alerts().drop("batch_id")


def _movements(events: DataFrame) -> DataFrame:
    """Events as movements: user = location, event type = item."""
    return events.select(
        utc_instant(F.col("ts")).alias("ts"),
        F.col("user_id").cast("string").alias("location_code"),
        F.col("event_type").alias("item_code"),
        F.col("value").alias("issues"),
    )


@query
def stream_late_rows(stock: Stock) -> DataFrame:
    """Weekly consumption from four batches of the event stream, of which three come late."""
    spark = stock.spark
    events = spark.read.schema(derive.INPUT_SCHEMAS["events"]).parquet(f"{stock.sf_dir}/events.parquet")
    folder = work_path(spark, "events")
    for part in range(4):
        mine = events.filter(F.pmod(F.hash("event_id"), F.lit(4)) == part)
        mine.coalesce(1).write.mode("append").parquet(folder)
    arriving = readers.stream_folder(spark, folder, derive.INPUT_SCHEMAS["events"], files_per_batch=1)
    log = ConsumptionLog(spark, work_path(spark, "consumption"))
    log.start(_movements(arriving)).awaitTermination()
    return _rounded(log.closed().unionByName(log.still_open()), 4, "issues")


@query
def stream_consumption(stock: Stock) -> DataFrame:
    """Weekly consumption of the event stream: user = location, event type = item."""
    spark = stock.spark
    events = readers.stream_folder(
        spark, stock.sf_dir, derive.INPUT_SCHEMAS["events"], glob="events.parquet"
    )

    out = work_path(spark, "consumption")
    running_consumption(_movements(events)).writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", f"{out}-checkpoint"
    ).trigger(availableNow=True).start(out).awaitTermination()
    finished = spark.read.schema(derive.INPUT_SCHEMAS["events"]).parquet(
        f"{stock.sf_dir}/events.parquet"
    )
    emitted = spark.read.parquet(out)
    windows = emitted.unionByName(open_windows(_movements(finished), emitted))
    return _rounded(windows, 4, "issues").withColumns(
        {
            "window_start": utc_date(F.col("window_start")),
            "window_end": utc_date(F.col("window_end")),
        }
    )
