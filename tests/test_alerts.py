import itertools
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.operators import alerts
from shelfwise.sources import seed
from tests.fixtures import TODAY, by
from tests.test_operators import health


def _many(spark):
    rnd = random.Random(11)
    classes = ["OUT_OF_STOCK", "CRITICAL", "HIGH_RISK", "MEDIUM_RISK", "OVERSTOCK", "HEALTHY"]
    return health(spark, [
        {"location_code": f"L{p}", "item_code": f"I{i}", "risk_classification": risk,
         "closing_stock": 0.0 if risk == "OUT_OF_STOCK" else 300.0,
         "days_until_stockout": rnd.randint(0, 5),
         "is_critical_item": rnd.choice([True, False, None]),
         "avg_daily_issue": rnd.choice([0.0, 10.0]),
         "requires_attention": risk in classes[:3]}
        for p, i in itertools.product(range(20), range(20))
        for risk in [rnd.choice(classes)]
    ])


def test_numbers_equal_one_global_row_number(spark):
    frame = _many(spark)
    got = alerts.stock_alerts(frame)
    order = Window.orderBy(
        "_rank", "days_until_stockout", F.md5(F.concat_ws("|", "location_code", "item_code"))
    )
    expected = alerts._actionable(frame).withColumn("alert_id", F.row_number().over(order))
    columns = ["alert_id", "location_code", "item_code", "alert_type", "severity"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(
        map(tuple, expected.select(columns).collect())
    )
    kinds = {r["alert_type"] for r in got.collect()}
    assert kinds == {"STOCK_OUT", "CRITICAL_LOW", "HIGH_RISK", "OVERSTOCK"}


def test_one_hot_group_is_numbered_by_many_tasks(spark, tmp_path):
    def keep(frame):
        frame.write.parquet(str(tmp_path / "ranges"))
        return spark.read.schema(frame.schema).parquet(str(tmp_path / "ranges"))

    rows = 400_000
    frame = health(spark, [{"risk_classification": "CRITICAL", "days_until_stockout": 3}])
    many = frame.drop("item_code").crossJoin(
        spark.range(rows).select(F.concat(F.lit("I"), F.col("id")).alias("item_code"))
    )
    some = health(spark, [
        {"item_code": "first", "risk_classification": "OUT_OF_STOCK", "days_until_stockout": None},
        {"item_code": "last", "risk_classification": "HIGH_RISK", "days_until_stockout": None},
        {"item_code": "near", "risk_classification": "HIGH_RISK", "days_until_stockout": 9},
    ])
    both = many.select(some.columns).unionByName(some)
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")  # these rows are few enough for a task or two
    try:
        got = alerts.stored_alerts(both, keep)
    finally:
        spark.conf.unset(coalesced)
    order = Window.orderBy(
        "_rank", F.col("days_until_stockout").asc_nulls_last(), F.md5(F.concat_ws("|", "location_code", "item_code"))
    )
    expected = alerts._actionable(both).withColumn("alert_id", F.row_number().over(order).cast("long"))
    columns = ["alert_id", "item_code", "severity"]
    assert got.count() == rows + 3
    assert got.select(columns).exceptAll(expected.select(columns)).isEmpty()
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "ranges")).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < rows / 5


def test_stored_alerts_of_no_rows_and_equal_rows(spark, tmp_path):
    def keep(frame):
        frame.write.mode("overwrite").parquet(str(tmp_path / "ranges"))
        return spark.read.schema(frame.schema).parquet(str(tmp_path / "ranges"))

    same = health(spark, [{"risk_classification": "CRITICAL", "days_until_stockout": 3}] * 5)
    assert sorted(r["alert_id"] for r in alerts.stored_alerts(same, keep).collect()) == [1, 2, 3, 4, 5]
    assert alerts.stored_alerts(same.limit(0), keep).count() == 0


def test_texts(spark):
    rows = [
        {"item_code": "a", "risk_classification": "OUT_OF_STOCK"},
        {"item_code": "b", "risk_classification": "CRITICAL", "days_until_stockout": 2,
         "closing_stock": 12.5},
        {"item_code": "c", "risk_classification": "HIGH_RISK", "days_until_stockout": 6},
        {"item_code": "d", "risk_classification": "OVERSTOCK", "days_until_stockout": 999,
         "closing_stock": 900.0, "days_since_last_movement": 70, "is_critical_item": True},
        {"item_code": "e", "risk_classification": "OVERSTOCK", "closing_stock": 100.0},
    ]
    got = by(alerts.stock_alerts(health(spark, rows)), "item_code")
    assert {k: r["alert_message"] for k, r in got.items()} == {
        "a": "Item 1 is OUT OF STOCK at Place 1. Immediate action required.",
        "b": "Item 1 at Place 1 will run out in 2 days. Current stock: 12.50 KG",
        "c": "Item 1 at Place 1 requires reorder. 6 days of supply remaining.",
        "d": "Item 1 at Place 1 has not moved in 70 days. Consider redistribution.",
    }
    assert got["c"]["recommended_action"] == (
        "Place order today - stock-out expected in 6 days"
    )
    assert [got[k]["severity"] for k in "abcd"] == ["CRITICAL", "CRITICAL", "HIGH", "CRITICAL"]


def test_acknowledged_alerts_leave_the_list_after_the_limit(spark):
    active = alerts.active_alerts(
        health(spark, [
            {"item_name": f"Item {n}", "item_code": f"I{n}", "requires_attention": True,
             "risk_classification": "HIGH_RISK", "days_until_stockout": n} for n in range(6)
        ]), limit=4,
    )
    assert active.count() == 4
    done = active.filter(F.col("days_until_stockout") == 1)
    left = alerts.unacknowledged_alerts(active, alerts.acknowledge(done))
    assert sorted(r["days_until_stockout"] for r in left.collect()) == [0, 2, 3]
    counts = alerts.alert_counts(left, done).first()
    assert tuple(counts) == (3, 0, 1)


def test_configured_alerts(spark):
    rows = [
        {"item_code": "out", "closing_stock": 0.0, "days_until_stockout": 999},
        {"item_code": "low", "days_until_stockout": 5},
        {"item_code": "old", "days_until_stockout": 999, "days_since_last_movement": 61},
        {"item_code": "fine"},
    ]
    got = alerts.configured_alerts(health(spark, rows), seed.alert_config(spark)).collect()
    assert sorted((r["item_code"], r["alert_type"], r["measured_days"]) for r in got) == [
        ("low", "LOW_STOCK", 5), ("old", "OVERSTOCK", 61), ("out", "CRITICAL", 0),
        ("out", "LOW_STOCK", 0), ("out", "STOCK_OUT", 0),
    ]
    narrow = seed.alert_config(spark).withColumns(
        {"location_filter": F.lit("L9, L1"), "item_category_filter": F.lit("PPE"),
         "is_active": F.col("alert_type") == "LOW_STOCK"}
    )
    rows = [{"days_until_stockout": 5, "item_category": "PPE", "location_code": place}
            for place in ("L1", "L2", "L9")] + [{"days_until_stockout": 5}]
    got = alerts.configured_alerts(health(spark, rows), narrow).collect()
    assert sorted(r["location_code"] for r in got) == ["L1", "L9"]
    for places, count in ((" L9 , L1 ", 2), ("", 3), ("  ", 3), ("L7", 0)):
        padded = narrow.withColumns({"location_filter": F.lit(places), "item_category_filter": F.lit("")})
        got = alerts.configured_alerts(health(spark, rows[:3]), padded)
        assert got.count() == count


def test_literal_rows_need_no_exchange(spark, tmp_path):
    health(spark, [{"item_code": "a"}]).write.parquet(str(tmp_path / "health"))
    written = spark.read.parquet(str(tmp_path / "health"))
    found = alerts.configured_alerts(written, seed.alert_config(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_item_thresholds(spark):
    own = spark.createDataFrame([("Item 2", 30)], "item_name string, threshold_days int")
    rows = [{"item_name": name, "days_until_stockout": days}
            for name in ("Item 1", "Item 2") for days in (7, 8, 30, 31)]
    got = alerts.custom_item_alerts(health(spark, rows), own).collect()
    assert sorted((r["item_name"], r["days_until_stockout"]) for r in got) == [
        ("Item 1", 7), ("Item 2", 7), ("Item 2", 8), ("Item 2", 30),
    ]


def test_history_rows(spark):
    got = alerts.alert_history(_many(spark), TODAY)
    assert got.count() == alerts.alerts_without_id(_many(spark)).count()
    assert got.filter(F.col("alert_date") != F.lit(TODAY)).count() == 0
