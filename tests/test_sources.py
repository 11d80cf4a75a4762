import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.operators.consumption import consumption_metrics
from shelfwise.plans import workspace
from shelfwise.sources import readers, seed, writers
from tests.fixtures import TODAY, ago, classified, daily, records, table


def _subset(*names):
    fields = schemas.DAILY_STOCK
    return type(fields)([fields[name] for name in names])


def test_csv_markers_quotes_trimming_and_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "record_date,location_code,item_name,issues,closing_stock,lead_time_days\n"
        '2024-06-30, L1 ,"Rice, ""fine""",1.5,NULL,N/A\n'
        "2024-06-29,null,Oil,NA,7\n"
        "2024-06-28,L3,,abc,8.25,9,extra\n"
    )
    schema = _subset(
        "record_date", "location_code", "item_name", "issues", "closing_stock", "lead_time_days"
    )
    rows = readers.read_stock_csv(spark, str(tmp_path), schema, bad_values="null")
    got = rows.orderBy("record_date").collect()
    assert [tuple(r) for r in got] == [
        (dt.date(2024, 6, 28), "L3", None, None, Decimal("8.25"), 9),
        (dt.date(2024, 6, 29), None, "Oil", None, Decimal("7.00"), None),
        (dt.date(2024, 6, 30), "L1", 'Rice, "fine"', Decimal("1.50"), None, None),
    ]
    loaded = readers.read_stock_csv(
        spark, str(tmp_path), schema, schemas.DAILY_STOCK_DEFAULTS, bad_values="skip"
    ).collect()
    assert sorted((r["location_code"] or "", r["closing_stock"]) for r in loaded) == [
        ("", Decimal("7.00")), ("L1", None),
    ]
    rejected = readers.rejected_rows(spark, str(tmp_path), schema).collect()
    assert [(r["issues"], r["bad_fields"]) for r in rejected] == [("abc", ["issues"])]
    with pytest.raises(Exception, match="bad value in issues: abc"):
        readers.read_stock_csv(spark, str(tmp_path), schema).collect()


def test_csv_absent_columns_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'record_date,item_name\n2024-06-30,"two\nlines"\n2024-06-29,Oil\n'
    )
    schema = _subset("record_date", "item_name", "closing_stock", "lead_time_days")
    got = readers.read_stock_csv(
        spark, str(tmp_path), schema, schemas.DAILY_STOCK_DEFAULTS, multi_line=True
    ).orderBy("record_date").collect()
    assert [(r["item_name"], r["closing_stock"], r["lead_time_days"]) for r in got] == [
        ("Oil", 0, 7), ("two\nlines", 0, 7),
    ]


def test_json_outer_array(spark, tmp_path):
    rows = [{"category_code": "A", "display_order": 1}, {"category_code": "B"}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    got = readers.read_json(spark, str(tmp_path / "c.json"), schemas.ITEM_CATEGORIES)
    assert sorted((r["category_code"], r["display_order"]) for r in got.collect()) == [
        ("A", 1), ("B", None),
    ]


@pytest.mark.parametrize("by_date", [True, False])
def test_bulk_load_appends(spark, tmp_path, by_date):
    path = str(tmp_path / "facts")
    frame = daily(spark, records([0, 1]) + records([1], item_code="I2"))
    writers.append_daily_stock(frame, path, by_date)
    writers.append_daily_stock(daily(spark, records([2])), path, by_date)
    back = spark.read.schema(frame.schema).parquet(path)
    assert back.count() == 4
    assert sorted({r["record_date"] for r in back.collect()}) == [ago(2), ago(1), TODAY]
    folder = readers.read_folder(spark, path, frame.drop("record_date").schema)
    assert folder.count() == 4


def test_export_rounds(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = spark.createDataFrame([("x", 1.005, 2.345)], "name string, a double, b double")
    writers.export_csv(frame, path, single_file=True)
    assert spark.read.option("header", True).csv(path).collect()[0].asDict() == {
        "name": "x", "a": "1.0", "b": "2.34",
    }


def test_named_reports(spark):
    frame = classified(
        spark, records([0], issues=5.0, closing_stock=0.0) + records([0], item_code="I2")
    )
    reports = writers.named_reports(frame)
    assert reports["executive_summary"].count() == 1
    assert [r["item_code"] for r in reports["critical_items"].collect()] == ["I1"]
    assert reports["location_performance"].first()["items_at_risk"] == 1


def test_audit_and_procurement_logs(spark, tmp_path):
    changes = spark.sql(
        "SELECT 'L1' AS location_code, 'I1' AS item_code, "
        "named_struct('stock', 5) AS old_value, named_struct('stock', 7) AS new_value"
    )
    path = str(tmp_path / "audit")
    for _ in range(2):
        writers.append_rows(writers.audit_events(changes, "DATA_LOAD", "daily", "me"), path)
    got = spark.read.parquet(path).collect()
    assert [(r["old_value"], r["new_value"]) for r in got] == [('{"stock":5}', '{"stock":7}')] * 2

    actions = table(spark, schemas.PROCUREMENT_ACTIONS, [
        {"action_id": n, "action_date": ago(d), "location_code": "L1", "item_code": "I1",
         "order_reference": ref, "status": status}
        for n, d, ref, status in (
            (1, 3, "A", "PENDING"), (2, 1, "A", "ORDERED"), (3, 1, "A", "RECEIVED"),
            (4, 9, "B", "PENDING"), (5, 9, None, "CANCELLED"),
        )
    ])
    latest = {r["order_reference"]: r["status"] for r in writers.latest_status(actions).collect()}
    assert latest == {"A": "RECEIVED", "B": "PENDING", None: "CANCELLED"}


def test_archive_splits_everything(spark, tmp_path):
    frame = daily(spark, records([0, 29, 30, 31, 400]))
    old, kept = str(tmp_path / "old"), str(tmp_path / "kept")
    for _ in range(2):  # a repeated run archives nothing twice
        writers.archive(frame, TODAY, 30, old, kept)
    days = [
        sorted((TODAY - r["record_date"]).days for r in spark.read.parquet(p).collect())
        for p in (old, kept)
    ]
    assert days == [[31, 400], [0, 29, 30]]
    undated = daily(spark, [{"record_date": None}])
    assert [f.count() for f in writers.split_by_retention(undated, TODAY, 30)] == [0, 1]


def test_old_date_folders_move_whole(spark, tmp_path):
    table, gone = str(tmp_path / "facts"), str(tmp_path / "archive")
    frame = daily(spark, records([0, 29, 30, 31, 400]) + [{"record_date": None}])
    writers.append_daily_stock(frame, table)

    def files(path):
        return {str(p.relative_to(path)) for p in (tmp_path / path).rglob("part-*.parquet")}

    def days(path):
        found = spark.read.schema(frame.schema).parquet(path).collect()
        return sorted((TODAY - r["record_date"]).days if r["record_date"] else -1 for r in found)

    before = files(tmp_path / "facts")
    assert writers.archive_partitions(spark, table, gone, TODAY, 30) == [ago(400), ago(31)]
    assert files(tmp_path / "facts") | files(tmp_path / "archive") == before  # nothing was written anew
    assert (days(table), days(gone)) == ([-1, 0, 29, 30], [31, 400])
    assert writers.archive_partitions(spark, table, gone, TODAY, 30) == []
    writers.append_daily_stock(daily(spark, records([31, 5], item_code="late")), table)
    assert writers.archive_partitions(spark, table, gone, TODAY, 30) == [ago(31)]
    assert (days(table), days(gone)) == ([-1, 0, 5, 29, 30], [31, 31, 400])


def test_health_over_stored_buckets_moves_no_record_by_pair(spark, tmp_path):
    rows = [
        {"record_date": ago(n % 40), "item_code": f"I{n % 9}", "location_code": f"L{n % 4}", "issues": float(n % 7)}
        for n in range(300)
    ]
    frame = daily(spark, rows)
    stored = writers.store_by_pair(frame, "facts_by_pair", str(tmp_path / "by_pair"), 4)
    metrics = consumption_metrics(stored, TODAY)
    assert "Exchange" not in metrics._jdf.queryExecution().sparkPlan().toString()
    plan = metrics._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SelectedBucketsCount: 4" in plan
    rounded = [F.round(c, 6).alias(c) if c.startswith("stddev") else F.col(c) for c in metrics.columns]
    expected = consumption_metrics(frame, TODAY).select(rounded)
    assert expected.exceptAll(metrics.select(rounded)).isEmpty()
    spark.sql("DROP TABLE facts_by_pair")


def test_footers_answer_the_summary(spark, tmp_path):
    path = str(tmp_path / "facts")
    frame = daily(spark, records([0, 5, 5, 90]) + [{"record_date": None}])
    writers.append_daily_stock(frame, path, by_date=False)
    settings = {name: spark.conf.get(name) for name in writers.FOOTER_SETTINGS}
    got = writers.footer_summary(spark, path, "record_date")
    assert [tuple(r) for r in got.collect()] == [(5, ago(90), TODAY)]
    assert settings == {name: spark.conf.get(name) for name in writers.FOOTER_SETTINGS}
    try:
        for name, value in writers.FOOTER_SETTINGS.items():
            spark.conf.set(name, value)
        asked = spark.read.parquet(path).agg(F.count("*"), F.min("record_date"), F.max("record_date"))
        assert "PushedAggregation: [COUNT(*), MIN(record_date), MAX(record_date)]" in (
            asked._jdf.queryExecution().executedPlan().toString()
        )
    finally:
        for name, value in settings.items():
            spark.conf.set(name, value)


def test_json_arrays_are_split_among_lines(spark, tmp_path):
    path = str(tmp_path / "arrays")
    rows = table(spark, schemas.ITEM_CATEGORIES, [
        {"category_code": f"C{n}", "display_order": n if n % 3 else None} for n in range(25)
    ])
    writers.write_json_arrays(rows.coalesce(1), path, array_rows=10)
    assert spark.read.text(path).count() == 3
    back = readers.read_json(spark, path, schemas.ITEM_CATEGORIES, multi_line=False)
    assert back.exceptAll(rows).isEmpty() and back.count() == 25


def test_table_summary(spark):
    frame = daily(spark, records([0, 5]))
    got = writers.table_summary(
        {"Daily": frame, "Places": table(spark, schemas.LOCATION_MASTER, [])},
        {"Daily": "record_date"},
    ).collect()
    assert [tuple(r) for r in got] == [("Daily", 2, ago(5), TODAY), ("Places", 0, None, None)]


def test_seed_rows(spark):
    assert seed.item_categories(spark).count() == 12
    assert seed.alert_config(spark).filter("is_active").count() == 5


def test_materialised_frame_reads_back_equal(spark):
    frame = daily(spark, records([0, 1, 2]))
    back = workspace.materialise(frame, "test")
    assert back.exceptAll(frame).count() == 0 and back.count() == 3
    assert "LogicalRDD" not in back._jdf.queryExecution().logical().toString()
    assert workspace.work_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_cluster_sessions_need_a_shared_folder():
    class Cluster:
        class conf:
            @staticmethod
            def get(name, default):
                return None

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_folder(Cluster)


def test_streaming_reader_takes_new_files(spark, tmp_path):
    frame = daily(spark, records([0, 1]))
    path = str(tmp_path / "in")
    frame.write.parquet(path)
    stream = readers.stream_folder(spark, path, frame.schema, glob="*.parquet")
    assert stream.isStreaming
    query = stream.select(F.col("item_code")).writeStream.format("memory").queryName(
        "taken"
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("taken").count() == 2
