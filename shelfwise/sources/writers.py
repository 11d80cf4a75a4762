"""Writing stock tables, exports, logs and archives."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions.dates import days_before
from shelfwise.operators import rollups
from shelfwise.sources import readers


def append_daily_stock(daily: DataFrame, path: str, by_date: bool = True) -> None:
    """Bulk load into the fact table.

    Stored by record date: rows are rebalanced by date first, so that a day becomes a few
    large files and adaptive execution splits a day far larger than the others.
    ``by_date=False`` suits tables too small for a folder per day: files then hold ranges
    of dates, which their statistics prune.
    """
    if by_date:
        daily.hint("rebalance", "record_date").write.mode("append").partitionBy(
            "record_date"
        ).parquet(path)
        return
    pair_hash = F.xxhash64("location_code", "item_code")
    daily.repartitionByRange("record_date", pair_hash).sortWithinPartitions(
        "record_date"
    ).write.mode("append").parquet(path)


def store_by_pair(daily: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """The fact table in hash buckets by pair, as a table of the catalog; returns it.

    Aggregates and joins by pair then need no exchange of the records, and days
    lie sorted in the files, so that a trailing window skips row groups. One task reads a bucket: this
    is for tables whose pairs have a record or so a day, as the daily ledger's have. Where one pair has a
    large share of all records, ``append_daily_stock`` spreads it.
    """
    pair = ("location_code", "item_code")
    (
        daily.hint("rebalance", *pair)
        .write.mode("overwrite")
        .bucketBy(buckets, *pair)
        .sortBy("record_date")
        .option("path", path)
        .saveAsTable(table)
    )
    return daily.sparkSession.table(table)


def write_json_arrays(rows: DataFrame, path: str, array_rows: int = 1_000) -> None:
    """JSON files whose lines are arrays of at most ``array_rows`` objects.

    Lines can be read by different tasks, which one array a file cannot.
    """
    row = F.struct(*[F.col(name) for name in rows.columns])
    array = F.expr(f"monotonically_increasing_id() DIV {array_rows}")
    (
        rows.select(row.alias("row"), array.alias("array"))
        .groupBy("array")
        .agg(F.to_json(F.collect_list("row")).alias("value"))
        .select("value")
        .write.mode("overwrite")
        .text(path)
    )


def append_rows(rows: DataFrame, path: str) -> None:
    """INSERT ... SELECT into a plain table: audit log, procurement actions, alert history."""
    rows.write.mode("append").parquet(path)


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Numeric columns rounded for display, half-even like the usual spreadsheet export."""
    numeric = [
        name
        for name, kind in df.dtypes
        if kind in ("double", "float") or kind.startswith("decimal")
    ]
    return df.withColumns({name: F.bround(name, digits) for name in numeric})


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header; ``single_file`` is for small reports only."""
    out = rounded(df)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(path)


def named_reports(health: DataFrame) -> dict[str, DataFrame]:
    """The three reports offered for export."""
    return {
        "executive_summary": rollups.executive_summary(health),
        "critical_items": health.filter(F.col("risk_classification").isin(*rollups.EXPOSED)),
        "location_performance": rollups.location_performance(health),
    }


def audit_events(
    changes: DataFrame, event_type: str, description: str, user: str
) -> DataFrame:
    """Audit rows for changed pairs; old and new values as JSON."""
    return changes.select(
        F.current_timestamp().cast("timestamp_ntz").alias("event_timestamp"),
        F.lit(event_type).alias("event_type"),
        F.lit(description).alias("event_description"),
        F.lit(user).alias("user_name"),
        "location_code",
        "item_code",
        F.to_json(F.col("old_value")).alias("old_value"),
        F.to_json(F.col("new_value")).alias("new_value"),
    )


def procurement_actions(
    recommendations: DataFrame, as_of: dt.date, status: str = "PENDING"
) -> DataFrame:
    """REORDER_CREATED actions for the recommendations given."""
    return recommendations.select(
        F.lit(as_of).alias("action_date"),
        "location_code",
        "item_code",
        F.lit("REORDER_CREATED").alias("action_type"),
        F.col("suggested_reorder_quantity").alias("recommended_quantity"),
        "supplier_code",
        F.date_add("recommended_action_date", F.col("lead_time_days")).alias(
            "expected_delivery_date"
        ),
        F.lit(status).alias("status"),
    )


def latest_status(actions: DataFrame) -> DataFrame:
    """The newest action per order reference, or per pair where there is none.

    Ranking is cut to the first row map-side, so a key with a long history stays small.
    """
    newest = Window.partitionBy("location_code", "item_code", "order_reference").orderBy(
        F.col("action_date").desc_nulls_last(), F.col("action_id").desc_nulls_last()
    )
    return (
        actions.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def split_by_retention(
    daily: DataFrame, as_of: dt.date, keep_days: int
) -> tuple[DataFrame, DataFrame]:
    """(rows to archive, rows to keep); a row without a date is kept."""
    old = F.coalesce(F.col("record_date") < days_before(as_of, keep_days), F.lit(False))
    return daily.filter(old), daily.filter(~old)


def archive(daily: DataFrame, as_of: dt.date, keep_days: int, archive_path: str,
            kept_path: str) -> None:
    """Writes old records to the archive's folder of this date, the rest to a table folder.

    Both folders are replaced, so a run that is repeated after a failure archives nothing
    twice. ``kept_path`` must not be the folder that ``daily`` is read from.
    """
    old, kept = split_by_retention(daily, as_of, keep_days)
    old.write.mode("overwrite").parquet(f"{archive_path}/archived_on={as_of.isoformat()}")
    kept.write.mode("overwrite").parquet(kept_path)


def archive_partitions(
    spark: SparkSession, table_path: str, archive_path: str, as_of: dt.date, keep_days: int
) -> list[dt.date]:
    """Moves the date folders past retention out of a table stored by record date; returns their dates.

    Days are kept or go as a whole, so no record is read or written and what is kept keeps its
    files. Late records of a day that went before join its folder in the archive. A
    run that was cut off is finished by the next one. Records without a date stay.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    table, gone = hadoop(table_path), hadoop(archive_path)
    files = table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(gone)
    key, limit, moved = "record_date=", as_of - dt.timedelta(days=keep_days), []

    def move(source, target) -> None:
        if files.exists(target) or not files.rename(source, target):
            raise RuntimeError(f"{source} could not be moved to {target}")

    for folder in sorted(status.getPath().getName() for status in files.listStatus(table)):
        text = folder.removeprefix(key)
        if not folder.startswith(key) or text == "__HIVE_DEFAULT_PARTITION__":
            continue
        day = dt.date.fromisoformat(text)
        if day >= limit:
            continue
        source, target = hadoop(table, folder), hadoop(gone, folder)
        if files.exists(target):
            for status in files.listStatus(source):
                move(status.getPath(), hadoop(target, status.getPath().getName()))
            files.delete(source, False)
        else:
            move(source, target)
        moved.append(day)
    return moved


#: Spark answers counts and extremes from Parquet footers under these settings.
FOOTER_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_summary(spark: SparkSession, path: str, date_column: str) -> DataFrame:
    """``table_summary`` of one stored table from its file footers: no row group is read.

    The date must be a column of the files, not of their folders. The settings it needs hold for
    the session, so the one row is computed here and the settings are put back.
    """
    before = {name: spark.conf.get(name) for name in FOOTER_SETTINGS}
    date = F.col(date_column)
    try:
        for name, value in FOOTER_SETTINGS.items():
            spark.conf.set(name, value)
        found = spark.read.parquet(path).agg(
            F.count("*").alias("record_count"),
            F.min(date).alias("earliest_date"),
            F.max(date).alias("latest_date"),
        )
        row = found.first()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return readers.literal_rows(spark, [row.asDict()], found.schema)


def table_summary(
    tables: dict[str, DataFrame], date_columns: dict[str, str]
) -> DataFrame:
    """Rows per table and, where the table has a date column, its first and last date."""
    parts = []
    for name, table in tables.items():
        counted = [F.lit(name).alias("data_type"), F.count("*").alias("record_count")]
        if name in date_columns:
            date = date_columns[name]
            counted += [F.min(date).alias("earliest_date"), F.max(date).alias("latest_date")]
        parts.append(table.agg(*counted[1:]).select(counted[0], "*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
