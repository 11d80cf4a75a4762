import re

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import alerts, consumption, health, positions, rollups, transfers
from shelfwise.plans import chain, registry
from shelfwise.sources import derive

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stock(spark):
    return registry.Stock(spark, SF)


def test_views_answer_sql(spark, stock):
    names = chain.register_views(stock.tables, stock.as_of)
    assert {"v_executive_summary", "stock_alerts", "daily_stock_raw"} <= set(names)
    row = spark.sql("SELECT TOTAL_LOCATIONS, TOTAL_ITEMS FROM V_EXECUTIVE_SUMMARY LIMIT 1").first()
    assert tuple(row) == (10, 25)


def test_written_tables_answer_sql(spark, stock, tmp_path):
    paths = chain.write_tables(stock.tables, stock.as_of, str(tmp_path))
    assert "as_of=2001-11-04" in paths["executive_summary"]
    chain.register_written(spark, paths)
    counts = spark.sql(
        "SELECT (SELECT count(*) FROM DT_STOCK_HEALTH_CLASSIFICATION),"
        " (SELECT sum(total_items) FROM DT_LOCATION_RISK_SUMMARY),"
        " (SELECT total_location_item_combinations FROM DT_EXECUTIVE_SUMMARY),"
        " (SELECT count(*) FROM STOCK_ALERTS)"
    ).first()
    assert counts[0] == counts[1] == counts[2]
    assert counts[3] > 0


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_dates_and_columns_reach_the_scan(spark, stock):
    plan = _plan(consumption.consumption_metrics(stock.daily, stock.as_of))
    assert "GreaterThanOrEqual(l_shipdate,2001-08-06T00:00)" in plan
    assert "Window" not in plan  # balances are not needed for consumption
    scan = re.search(r"ReadSchema: (struct<l_[^>]*>)", plan).group(1)
    assert set(re.findall(r"l_\w+", scan)) == {
        "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate",
    }


def test_plans_of_the_core_operators(spark, stock, tmp_path):
    stock.daily.withColumn("stock_record_id", F.lit(1).cast("long")).write.parquet(
        str(tmp_path / "facts")
    )
    facts = spark.read.parquet(str(tmp_path / "facts"))
    candidates = _plan(positions.position_candidates(facts))
    assert "HashAggregate" in candidates and "Sort" not in candidates
    used = _plan(consumption.consumption_metrics(facts, stock.as_of))
    assert "Expand" not in used and "Sort" not in used
    classified = health.stock_health_classification(
        facts, stock.items, stock.locations, stock.tables.params, stock.as_of
    )
    for frame in (
        classified,
        rollups.executive_summary(classified, stock.items),
        transfers.transfer_suggestions(classified),
        alerts.stock_alerts(classified),
    ):
        plan = _plan(frame)
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval"):
            assert word not in plan


def test_metrics_take_one_scan_and_one_exchange_by_pair(spark, stock, tmp_path):
    stock.daily.withColumn("stock_record_id", F.lit(1).cast("long")).write.parquet(
        str(tmp_path / "facts")
    )
    facts = spark.read.parquet(str(tmp_path / "facts"))
    plan = _plan(consumption.position_with_consumption(facts, stock.as_of))
    assert plan.count("FileScan") == 1
    by_pair = re.findall(r"hashpartitioning\(location_code#\d+, item_code#\d+, (\d+)\)", plan)
    assert len(by_pair) == 1 and plan.count("Exchange") == 3  # by name, by beyond-mask date, by pair
    assert "SortAggregate" not in plan and "Join" not in plan


def test_forecast_cuts_days_before_its_only_shuffle(spark, stock, tmp_path):
    stock.daily.write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    plan = _plan(consumption.demand_forecast(facts, stock.as_of))
    assert plan.count("Exchange") == 1
    before = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before and "dense_rank" in before and ", 14, Partial" in before


def test_ranks_are_cut_before_the_shuffle(spark, stock, tmp_path):
    stock.health.write.parquet(str(tmp_path / "health"))
    plan = _plan(transfers.transfer_suggestions(spark.read.parquet(str(tmp_path / "health"))))
    assert plan.count("WindowGroupLimit") == 4  # partial and final, sources and targets


def test_derived_tables_cover_the_null_cases(spark, stock):
    frame = stock.health
    assert frame.filter("is_critical_item IS NULL").count() > 0
    assert frame.filter("location_priority IS NULL").count() > 0
    assert stock.items.filter("default_lead_time_days IS NULL").count() == 2
    assert derive.read_table(spark, SF, "nation").count() == 25
