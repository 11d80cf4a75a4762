import datetime as dt
import statistics

import pytest

from shelfwise import schemas
from shelfwise.operators.consumption import consumption_metrics, demand_forecast
from shelfwise.operators.health import capacity_overstock, movement_velocity
from shelfwise.operators.positions import (
    conditional_update,
    latest_stock_position,
    with_defaults,
)
from tests.fixtures import TODAY, ago, by, classified, daily, records, table


def test_window_edges_and_record_day_average(spark):
    rows = records([0, 3, 7, 8, 14, 30, 31, 90, 91], issues=10.0)
    rows += records([-2], issues=40.0)
    got = consumption_metrics(daily(spark, rows), TODAY).first()
    assert got["avg_daily_issue_7d"] == pytest.approx((3 * 10 + 40) / 4)
    assert got["total_issues_7d"] == 70
    assert got["total_issues_14d"] == 90
    assert got["total_issues_30d"] == 100
    assert got["stddev_issues_7d"] == pytest.approx(statistics.stdev([10, 10, 10, 40]))
    assert got["days_with_movement_30d"] == 7
    assert got["last_movement_date"] == ago(-2)
    assert got["days_since_last_movement"] == -2


def test_no_records_in_window_gives_null_average_and_zero_total(spark):
    got = consumption_metrics(daily(spark, records([20], issues=6.0)), TODAY).first()
    assert got["avg_daily_issue_14d"] is None
    assert got["total_issues_14d"] == 0
    assert got["stddev_issues_30d"] is None
    assert got["avg_daily_issue_30d"] == 6


def test_movement_days_count_each_date_once_even_far_in_the_future(spark):
    rows = records([0, 0, 5, 30], issues=1.0) + records([1, 31], issues=0.0)
    rows += records([-32, -33, -33, -400], issues=2.0) + records([-500], issues=0.0)
    got = consumption_metrics(daily(spark, rows), TODAY).first()
    assert got["days_with_movement_30d"] == 6


def test_renamed_item_makes_two_consumption_rows_and_duplicates_health(spark):
    rows = records([5, 6], issues=4.0, item_name="Old") + records([0, 1], issues=8.0)
    assert consumption_metrics(daily(spark, rows), TODAY).count() == 2
    both = classified(spark, rows).collect()
    assert sorted(row["avg_daily_issue"] for row in both) == [4, 8]
    assert {row["item_name"] for row in both} == {"Item 1"}
    merged = classified(spark, rows, group_by_codes_only=True).collect()
    assert [row["avg_daily_issue"] for row in merged] == [6]


def test_latest_position_breaks_ties_by_record_id_and_keeps_null_stock(spark):
    rows = [
        {"stock_record_id": 2, "closing_stock": 20.0, "location_name": "New name"},
        {"stock_record_id": 1, "closing_stock": 10.0},
        {"stock_record_id": 99, "record_date": ago(1), "closing_stock": 5.0},
        {"stock_record_id": 3, "item_code": "I2", "closing_stock": None},
        {"stock_record_id": 2, "item_code": "I2", "closing_stock": 7.0},
    ]
    got = by(latest_stock_position(daily(spark, rows)), "item_code")
    assert got["I1"]["closing_stock"] == 20
    assert got["I1"]["location_name"] == "New name"
    assert got["I2"]["closing_stock"] is None


def test_extreme_dates_keep_their_order(spark):
    days = [dt.date(1, 1, 1), dt.date(1969, 12, 31), dt.date(9999, 12, 30), dt.date(9999, 12, 31)]
    for count in range(1, 5):
        rows = [{"record_date": day, "stock_record_id": 2**40 - 1 - n}
                for n, day in enumerate(days[:count])]
        assert latest_stock_position(daily(spark, rows)).first()["latest_date"] == days[count - 1]


def test_position_without_record_ids(spark):
    rows = records([4, 2, 3])
    got = latest_stock_position(daily(spark, rows).drop("stock_record_id")).first()
    assert got["latest_date"] == ago(2)


def _idle(code, days):
    """Last issue some days ago, a quiet record today."""
    return [
        {"item_code": code, "item_name": code, "record_date": ago(days), "issues": 3.0},
        {"item_code": code, "item_name": code, "issues": 0.0, "closing_stock": 900.0},
    ]


def test_idle_stock_classes(spark):
    rows = _idle("d30", 30) + _idle("d31", 31) + _idle("d61", 61) + _idle("d91", 91)
    got = by(classified(spark, rows), "item_code")
    assert {code: row["risk_classification"] for code, row in got.items()} == {
        "d30": "HEALTHY", "d31": "SLOW_MOVING", "d61": "OVERSTOCK", "d91": "HEALTHY",
    }
    assert got["d31"]["stock_health_score"] == 60
    assert got["d91"]["stock_health_score"] == 100
    assert got["d91"]["days_since_last_movement"] is None
    assert got["d61"]["days_of_cover"] == 999
    assert got["d61"]["projected_stockout_date"] is None
    assert got["d61"]["is_overstock"] and not got["d30"]["is_overstock"]


def test_score_tests_movement_first_class_tests_stock_first(spark):
    rows = _idle("empty", 31)
    rows[-1]["closing_stock"] = 0.0
    got = classified(spark, rows).first()
    assert got["stock_health_score"] == 60
    assert got["risk_classification"] == "OUT_OF_STOCK"
    assert got["requires_attention"]


def test_zero_14_day_average_wins_over_older_use(spark):
    rows = records([0, 1], issues=0.0) + records([20], issues=50.0)
    got = classified(spark, rows).first()
    assert got["avg_daily_issue"] == 0
    assert got["days_until_stockout"] == 999


def test_30_day_average_is_used_without_14_day_records(spark):
    got = classified(spark, records([20], issues=5.0, closing_stock=52.0)).first()
    assert got["avg_daily_issue"] == 5
    assert got["days_until_stockout"] == 10
    assert got["projected_stockout_date"] == TODAY + dt.timedelta(days=10)


def test_null_stock_is_healthy_and_never_flagged(spark):
    got = classified(spark, records([0], issues=5.0, closing_stock=None)).first()
    assert got["risk_classification"] == "HEALTHY"
    assert got["requires_attention"] is False
    assert got["days_until_stockout"] is None


def test_parameter_fallbacks(spark):
    items = table(
        spark,
        schemas.ITEM_MASTER,
        [
            {"item_code": "I1", "default_lead_time_days": 10, "is_critical": True},
            {"item_code": "I2"},
        ],
    )
    params = table(
        spark,
        schemas.ITEM_LOCATION_PARAMS,
        [{"location_code": "L2", "item_code": "I1", "custom_lead_time_days": 21}],
    )
    locations = table(
        spark, schemas.LOCATION_MASTER, [{"location_code": "L2", "priority_level": "HIGH"}]
    )
    rows = [
        {"location_code": "L1", "item_code": "I1", "lead_time_days": 3},
        {"location_code": "L2", "item_code": "I1", "lead_time_days": 3},
        {"location_code": "L1", "item_code": "I2", "lead_time_days": 3},
        {"location_code": "L1", "item_code": "I3", "lead_time_days": None},
    ]
    got = by(classified(spark, rows, items, locations, params), "location_code", "item_code")
    assert {key: row["lead_time_days"] for key, row in got.items()} == {
        ("L1", "I1"): 10, ("L2", "I1"): 21, ("L1", "I2"): 3, ("L1", "I3"): 7,
    }
    assert got["L2", "I1"]["location_priority"] == "HIGH"
    assert got["L1", "I3"]["is_critical_item"] is None
    assert got["L1", "I3"]["safety_stock"] == 0
    assert got["L1", "I3"]["reorder_point"] is None
    assert got["L1", "I3"]["max_stock_level"] == 999999


def test_capacity_overstock(spark):
    params = table(
        spark,
        schemas.ITEM_LOCATION_PARAMS,
        [{"location_code": "L1", "item_code": "I1", "max_stock_level": 60}],
    )
    rows = [{"closing_stock": 100.0}, {"item_code": "I2", "closing_stock": 5000.0}]
    got = capacity_overstock(classified(spark, rows, params=params)).collect()
    assert [(row["item_code"], row["excess_stock"]) for row in got] == [("I1", 40)]


def test_velocity_shares(spark):
    rows = [{"item_code": c, "issues": i} for c, i in (("a", 6.0), ("b", 5.0), ("c", 1.0))]
    got = by(movement_velocity(classified(spark, rows)), "velocity")
    assert {name: row["items"] for name, row in got.items()} == {
        "Fast Mover": 1, "Normal Mover": 1, "Slow Mover": 1,
    }
    assert got["Slow Mover"]["pct_of_total"] == 33.3


def test_forecast_averages_the_last_record_days(spark):
    rows = records(range(0, 20), issues=2.0) + records([0], issues=7.0)
    got = by(demand_forecast(daily(spark, rows), TODAY, window=14, horizon=3), "forecast_date")
    assert sorted(got) == [ago(-1), ago(-2), ago(-3)]
    expected = (13 * 2 + 9) / 14
    assert got[ago(-3)]["forecast_daily_issue"] == pytest.approx(expected)
    assert got[ago(-3)]["forecast_cumulative_issue"] == pytest.approx(3 * expected)


def test_forecast_reaches_back_to_any_record_day(spark):
    rows = [r for n in range(20) for r in records([30 * n], issues=float(n + 1))]
    got = by(demand_forecast(daily(spark, rows), TODAY, horizon=1), "forecast_date")
    assert got[ago(-1)]["forecast_daily_issue"] == pytest.approx(sum(range(1, 15)) / 14)
    short = demand_forecast(daily(spark, rows), TODAY, horizon=1, history_days=90).first()
    assert short["forecast_daily_issue"] == pytest.approx(2.5)


@pytest.mark.parametrize(
    ("older", "newer"), [(2**40 - 1, 2**40 + 3), (-5, -4), (None, -(2**63)), (2**62, 2**63 - 1)]
)
def test_highest_record_id_of_a_day_wins(spark, older, newer):
    rows = records([0], stock_record_id=newer, closing_stock=9.0)
    rows += records([0], stock_record_id=older, closing_stock=50.0)
    rows += records([1], stock_record_id=2**63 - 1, closing_stock=70.0)
    for given in (rows, rows[::-1]):
        got = latest_stock_position(daily(spark, given)).collect()
        assert [r["closing_stock"] for r in got] == [9.0]


def test_copies_without_ids_and_renames_give_one_order(spark):
    rows = records([0], closing_stock=9.0) + records([0], closing_stock=50.0)
    for given in (rows, rows[::-1]):
        frame = daily(spark, given).drop("stock_record_id")
        assert latest_stock_position(frame).first()["closing_stock"] == 50.0
    tied = records([0], stock_record_id=4, item_name="A") + records([0], stock_record_id=4, item_name="B")
    for given in (tied, tied[::-1]):
        assert latest_stock_position(daily(spark, given)).first()["item_name"] == "B"


def test_conditional_update_reads_old_values(spark):
    from pyspark.sql import functions as F

    df = daily(spark, [{"issues": 1.0, "closing_stock": 30.0}])
    got = conditional_update(
        df,
        F.col("item_code") == "I1",
        {"issues": F.col("closing_stock") + 10, "closing_stock": F.col("issues")},
    ).first()
    assert (got["issues"], got["closing_stock"]) == (40, 1)


def test_defaults_fill_only_missing_fields(spark):
    df = daily(spark, [{"lead_time_days": None, "issues": None, "receipts": 4.0}])
    got = with_defaults(df, schemas.DAILY_STOCK_DEFAULTS).first()
    assert (got["lead_time_days"], got["issues"], got["receipts"]) == (7, 0, 4)
