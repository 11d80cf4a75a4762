"""Ledger, reorder, cost, transfer, scenario, roll-up and list operators."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.functions import dates
from shelfwise.operators import costs, explore, ledger, reorder, rollups, scenarios, transfers
from shelfwise.sources import seed
from tests.fixtures import TODAY, ago, by, classified, daily, records, table

HEALTH_DDL = (
    "location_code string, location_name string, item_code string, item_name string, "
    "item_category string, latest_date date, closing_stock double, unit_of_measure string, "
    "lead_time_days int, safety_stock double, reorder_point double, max_stock_level double, "
    "avg_daily_issue double, days_since_last_movement int, days_of_cover double, "
    "projected_stockout_date date, days_until_stockout long, is_critical_item boolean, "
    "location_priority string, stock_health_score double, risk_classification string, "
    "risk_color string, requires_attention boolean"
)
HEALTH_DEFAULTS = dict(
    location_code="L1", location_name="Place 1", item_code="I1", item_name="Item 1",
    item_category="FOOD_GRAIN", latest_date=TODAY, closing_stock=100.0, unit_of_measure="KG",
    lead_time_days=7, safety_stock=0.0, reorder_point=None, max_stock_level=999999.0,
    avg_daily_issue=2.0, days_since_last_movement=0, days_of_cover=50.0,
    projected_stockout_date=ago(-50), days_until_stockout=50, is_critical_item=False,
    location_priority=None, stock_health_score=90.0, risk_classification="HEALTHY",
    risk_color="GREEN", requires_attention=False,
)


def health(spark, rows):
    unknown = {name for row in rows for name in row} - set(HEALTH_DEFAULTS)
    assert not unknown, unknown
    return spark.createDataFrame(
        [tuple({**HEALTH_DEFAULTS, **row}.values()) for row in rows], HEALTH_DDL
    )


# --- ledger ---------------------------------------------------------------------------


def test_ledger_balances(spark):
    rnd = random.Random(7)
    moves = [
        (f"L{p}", "I1", ago(d), float(rnd.randint(0, 9)), float(rnd.randint(0, 9)), 50.0 + p)
        for p in range(3) for d in range(0, 40, p + 1)
    ]
    frame = spark.createDataFrame(
        moves, "location_code string, item_code string, record_date date, receipts double, "
        "issues double, initial_stock double",
    )
    got = ledger.stock_ledger(frame).collect()
    assert len(got) == len(moves)
    for place, rows in itertools.groupby(
        sorted(got, key=lambda r: (r["location_code"], r["record_date"])),
        key=lambda r: r["location_code"],
    ):
        held = 50.0 + int(place[1:])
        for number, row in enumerate(rows, 1):
            assert row["day_num"] == number
            assert row["opening_stock"] == held
            held += row["receipts"] - row["issues"]
            assert row["closing_stock"] == held


def test_dense_calendar_fills_quiet_days(spark):
    rows = records([0, 3, 3, 20], issues=2.0) + records([50], item_code="I2")
    got = ledger.dense_calendar(daily(spark, rows), ago(4), TODAY).collect()
    assert len(got) == 10
    cells = {(r["item_code"], r["record_date"]): (r["issues"], r["has_record"]) for r in got}
    assert cells["I1", ago(3)] == (4.0, True)
    assert cells["I1", ago(1)] == (0.0, False)
    assert cells["I2", ago(0)] == (0.0, False)


def test_date_gaps_ignore_repeated_days_and_unknown_pairs(spark):
    rows = records([0, 0, 1, 5, 6, 20]) + records([0, 9], item_code=None)
    rows += records([0, 1, 2], item_code="I2")
    got = ledger.date_gaps(daily(spark, rows)).collect()
    assert [(r["item_code"], r["gaps"], r["longest_gap_days"]) for r in got] == [("I1", 2, 14)]


# --- reorder and cost -----------------------------------------------------------------


def test_reorder_rows_and_dates(spark):
    items = table(
        spark, schemas.ITEM_MASTER,
        [{"item_code": "I1", "unit_cost": 2, "supplier_code": "S"}],
    )
    rows = [
        {"location_code": "out", "closing_stock": 0.0, "days_until_stockout": 0,
         "days_of_cover": 0.0, "risk_classification": "OUT_OF_STOCK"},
        {"location_code": "soon", "closing_stock": 18.0, "days_until_stockout": 9,
         "projected_stockout_date": ago(-9), "risk_classification": "MEDIUM_RISK"},
        {"location_code": "point", "closing_stock": 40.0, "reorder_point": 40.0,
         "days_until_stockout": 20, "projected_stockout_date": ago(-20), "safety_stock": 60.0},
        {"location_code": "dead", "closing_stock": 0.0, "avg_daily_issue": 0.0,
         "days_until_stockout": 999, "projected_stockout_date": None,
         "risk_classification": "OUT_OF_STOCK"},
        {"location_code": "fine"},
    ]
    got = by(reorder.reorder_recommendations(health(spark, rows), items, TODAY), "location_code")
    assert set(got) == {"out", "soon", "point", "dead"}
    assert got["out"]["suggested_reorder_quantity"] == pytest.approx(16.8)
    assert got["out"]["estimated_order_value"] == pytest.approx(33.6)
    assert got["out"]["recommended_action_date"] == TODAY
    assert got["soon"]["suggested_reorder_quantity"] == 0
    assert got["soon"]["recommended_action_date"] == ago(-2)
    assert got["point"]["suggested_reorder_quantity"] == pytest.approx(36.8)
    assert got["dead"]["suggested_reorder_quantity"] == 0
    assert got["dead"]["urgency_score"] == 100
    assert got["dead"]["recommended_action_date"] is None
    assert got["out"]["supplier_code"] == "S"


QUEUE_DDL = (
    "location_name string, item_category string, estimated_order_value double, "
    "procurement_priority_score double, is_critical_item boolean"
)


def test_cost_figures_and_insights(spark):
    queue = spark.createDataFrame(
        [("A", "FOOD", 1000.0, 90.0, True), ("A", "PPE", 3000.0, 60.0, None),
         ("B", "PPE", 6000.0, 30.0, False)],
        QUEUE_DDL,
    )
    rows = [{"item_code": f"I{n}"} for n in range(4)]
    got = costs.cost_metrics(queue, health(spark, rows)).first()
    assert got["potential_savings"] == pytest.approx(1500)
    assert got["stockout_prevention"] == 500
    assert got["roi_pct"] == pytest.approx(20)
    assert got["turnover_rate_pct"] == 75
    assert got["efficiency_score"] == 25
    assert got["avg_daily_investment"] == pytest.approx(10000 / 30)
    insights = [row["insight"] for row in costs.cost_insights(queue).collect()]
    assert insights == [
        costs.GOOD_ROI, "📦 **Top Category**: PPE requires the highest reorder investment.",
    ]
    assert costs.cost_insights(queue.limit(0)).count() == 0
    assert [r["location_name"] for r in costs.cost_by_location(queue).collect()] == ["A", "B"]


def test_transfers_equal_the_full_pairing(spark):
    rnd = random.Random(3)
    rows = []
    for item, place in itertools.product(range(4), range(30)):
        risk = rnd.choice(["OVERSTOCK", "CRITICAL", "OUT_OF_STOCK", "HEALTHY"])
        rows.append({
            "item_name": f"Item {item}", "item_code": f"I{item}", "location_name": f"P{place:02}",
            "location_code": f"L{place:02}", "risk_classification": risk,
            "closing_stock": float(rnd.choice([0, 30, 500])),
            "avg_daily_issue": float(rnd.choice([0, 1, 9])),
            "stock_health_score": float(rnd.choice([0, 10, 60])),
        })
    ordered = sorted(rows, key=lambda r: (r["item_name"], r["stock_health_score"],
                                          r["location_name"]))
    expected = []
    for source, target in itertools.product(ordered, ordered):
        if (source["item_name"] == target["item_name"]
                and source["risk_classification"] == "OVERSTOCK"
                and target["risk_classification"] in ("CRITICAL", "OUT_OF_STOCK")):
            amount = min(source["closing_stock"] * 0.3, target["avg_daily_issue"] * 14)
            if amount > 0:
                high = target["risk_classification"] == "OUT_OF_STOCK"
                expected.append((source["item_name"], source["location_name"],
                                 target["location_name"], float(round(amount)),
                                 "High" if high else "Medium"))
    assert len(expected) > 60
    for limit in (0, 1001):
        with pytest.raises(ValueError, match="limit"):
            transfers.transfer_suggestions(health(spark, rows), limit)
    for limit in (10, 55):
        found = transfers.transfer_suggestions(health(spark, rows), limit).collect()
        got = [tuple(r) for r in found]
        assert sorted(got) == sorted(expected[:limit])


def test_scenarios_truncate(spark):
    rows = [{"risk_classification": "CRITICAL"}] * 3 + [{}]
    queue = spark.createDataFrame([("A", "FOOD", 100.0, 1.0, True)], QUEUE_DDL)
    got = scenarios.scenario_summary(
        health(spark, rows), queue, [(50, 0, 100), (-50, 30, 80)]
    ).collect()
    assert [(r["projected_critical"], r["potential_stockouts"], r["critical_change"],
             r["budget_required"]) for r in got] == [(4, 4, 1, 100.0), (1, 1, -2, 80.0)]


def test_projection_stops_at_zero(spark):
    rows = [{"closing_stock": 5.0, "avg_daily_issue": 2.0},
            {"item_code": "I2", "closing_stock": None, "avg_daily_issue": 0.0}]
    got = scenarios.stock_projection(health(spark, rows), 4).collect()
    first = [r["projected_stock"] for r in got if r["item_code"] == "I1"]
    assert first == [5, 3, 1, 0, 0]
    assert {(r["item_code"], r["stockout_day"]) for r in got} == {("I1", 2), ("I2", 999)}


def test_location_parameters_equal_the_full_product(spark):
    kinds = ["HOSPITAL", "WAREHOUSE", "NGO_CENTER", "DISTRIBUTION_CENTER"]
    places = [
        {"location_code": f"L{n:02}", "location_type": kinds[n % 4], "is_active": n != 5,
         "region": "North" if n % 3 else "South"} for n in range(12)
    ]
    names = ["MEDICINE_X", "FOOD", "MEDICAL_SUPPLY", "PPE"]
    goods = [
        {"item_code": f"I{n:02}", "item_category": names[n % 4], "is_active": n != 3,
         "safety_stock": n, "default_lead_time_days": 5} for n in range(10)
    ]
    expected = []
    for place, item in itertools.product(places, goods):
        medical = item["item_category"].startswith(("MEDICINE", "MEDICAL"))
        kind = place["location_type"]
        allowed = kind in ("WAREHOUSE", "NGO_CENTER") or (kind == "HOSPITAL" and medical)
        if allowed and place["is_active"] and item["is_active"]:
            lead = 5 + (2 if place["region"] == "North" else 0)
            expected.append((place["location_code"], item["item_code"], lead,
                             item["safety_stock"] * 1.5))
    for limit in (7, 50):
        got = scenarios.location_parameters(
            table(spark, schemas.LOCATION_MASTER, places),
            table(spark, schemas.ITEM_MASTER, goods), limit,
        ).collect()
        found = [(r[0], r[1], r["custom_lead_time_days"], r["custom_reorder_point"]) for r in got]
        assert sorted(found) == sorted(expected)[:limit]


# --- roll-ups -------------------------------------------------------------------------


def test_location_class_thresholds(spark):
    def place(name, classes):
        return [
            {"location_code": name, "location_name": name, "item_code": f"I{n}",
             "risk_classification": risk} for n, risk in enumerate(classes)
        ]

    rows = (
        place("one_out", ["OUT_OF_STOCK"] + ["HEALTHY"] * 9)
        + place("three", ["CRITICAL"] * 2 + ["HIGH_RISK"] + ["HEALTHY"] * 7)
        + place("four", ["CRITICAL"] * 4 + ["OVERSTOCK"] * 6)
        + place("half", ["MEDIUM_RISK"] * 5 + ["HEALTHY"] * 5)
        + place("over", ["MEDIUM_RISK"] * 6 + ["SLOW_MOVING"] * 4)
    )
    frame = health(spark, rows)
    got = by(rollups.location_risk_summary(frame), "location_code")
    assert {k: r["location_risk_classification"] for k, r in got.items()} == {
        "one_out": "CRITICAL", "three": "HEALTHY", "four": "HIGH_RISK", "half": "HEALTHY",
        "over": "MEDIUM_RISK",
    }
    assert got["four"]["location_risk_score"] == 36
    assert got["over"]["overstock_count"] == 4
    for row in got.values():
        assert row["total_items"] == sum(
            row[f"{name}_count"] for name in
            ("out_of_stock", "critical", "high_risk", "medium_risk", "healthy", "overstock")
        )
    ranks = [(r["risk_rank"], r["location_code"]) for r in
             rollups.location_ranking(rollups.location_risk_summary(frame)).collect()]
    assert ranks == [(1, "four"), (2, "three"), (3, "over"), (4, "half"), (5, "one_out")]


def test_executive_totals_count_master_copies_like_the_joins(spark):
    items = table(
        spark, schemas.ITEM_MASTER,
        [{"item_code": "I1", "unit_cost": 2}, {"item_code": "I1", "unit_cost": 3},
         {"item_code": "I2", "unit_cost": None}],
    )
    rows = [
        {"closing_stock": 0.0, "risk_classification": "OUT_OF_STOCK", "is_critical_item": True},
        {"item_code": "I2", "closing_stock": 0.0, "risk_classification": "OUT_OF_STOCK"},
        {"item_code": "I9", "closing_stock": 0.0, "risk_classification": "CRITICAL"},
        {"item_code": "I1", "location_code": "L2"},
    ]
    frame = health(spark, rows)
    recs = reorder.reorder_recommendations(frame, items, TODAY)
    expected = recs.agg(F.count("*"), F.sum("estimated_order_value")).first()
    got = rollups.executive_summary(frame, items).first()
    assert got["total_reorder_recommendations"] == expected[0] == 4
    assert got["total_estimated_order_value"] == pytest.approx(expected[1])
    assert got["total_location_item_combinations"] == 4
    assert (got["total_locations"], got["total_items"]) == (2, 3)
    assert got["critical_items_at_risk"] == 1
    assert got["pct_requiring_attention"] == 75


def test_roll_ups_of_nothing(spark):
    empty = health(spark, [{}]).limit(0)
    got = rollups.executive_summary(empty).first()
    assert got["total_items"] == 0 and got["pct_healthy"] is None
    assert rollups.smart_recommendations(empty).count() == 0
    assert rollups.overall_performance(empty).first()["healthy_pct"] is None


def test_display_groupings_leave_out_unnamed_rows(spark):
    frame = health(spark, [{"location_name": None, "item_category": None}, {}])
    for build in (rollups.location_risk_counts, rollups.location_risk_matrix,
                  rollups.category_performance, rollups.location_performance):
        assert build(frame).count() == 1
    assert rollups.location_risk_summary(frame).count() == 2


def test_smart_recommendations(spark):
    rows = [
        {"location_name": "good", "item_code": f"I{n}", "stock_health_score": 95.0}
        for n in range(8)
    ] + [
        {"location_name": "bad", "item_code": f"I{n}", "stock_health_score": 20.0,
         "risk_classification": "CRITICAL"} for n in range(2)
    ]
    got = [(r["rule_no"], r["reason"], r["action"]) for r in
           rollups.smart_recommendations(health(spark, rows)).collect()]
    assert got == [
        (1, "20.0% items at risk", "Increase Safety Stock"),
        (4, "Health score: 20.0/100", "Priority Support for bad"),
        (5, "Health score: 95.0/100", "Replicate Best Practices from good"),
    ]


def test_parent_categories(spark):
    rows = [{"item_category": name, "item_code": name} for name in
            ("FOOD", "FOOD_GRAIN", "FOOD_DAIRY", "PPE", "UNLISTED")]
    got = by(
        rollups.parent_category_rollup(health(spark, rows), seed.item_categories(spark)),
        "parent_category",
    )
    assert {k: r["total_items"] for k, r in got.items()} == {"FOOD": 3, "PPE": 1, "UNLISTED": 1}


# --- lists ----------------------------------------------------------------------------


def _scored(spark):
    return explore.health_list(health(spark, [
        {"item_code": f"I{n:03}", "item_name": f"Item {n:03}", "stock_health_score": float(n),
         "days_until_stockout": 200 - n, "location_name": f"P{n % 3}"} for n in range(120)
    ]))


def test_sorted_heads_and_tail(spark):
    listed = _scored(spark)

    def shown(sort_by, show):
        return [r["stock_health_score"] for r in
                explore.sort_and_show(listed, sort_by, show).collect()]

    assert shown("health", "top_50") == list(range(50))
    assert shown("health", "bottom_50") == list(range(70, 120))
    assert shown("days", "top_100") == list(range(119, 19, -1))
    assert len(shown("location", "all")) == 120


def test_filters_and_searches(spark):
    listed = _scored(spark)
    two = health(spark, [{"location_name": "X"}, {}])
    assert explore.health_list(two, location="X").count() == 1
    assert explore.text_search(listed, "ITEM 01").count() == 10
    assert explore.text_search(listed, "i01").count() == 0  # codes are not shown
    assert explore.advanced_search(listed, min_health=100).count() == 20
    assert explore.advanced_search(listed, text="item 00", mode="starts_with").count() == 10
    assert explore.advanced_search(listed, text="ITEM 005", mode="exact").count() == 1
    assert explore.advanced_search(listed, max_stock=99).count() == 0
    assert explore.advanced_search(listed, show_healthy=False).count() == 0


def test_top_lists_break_ties_by_name(spark):
    rows = [
        {"location_name": f"P{n}", "item_name": f"Item {n % 2}", "stock_health_score": 90.0,
         "days_of_cover": 10.0 * n} for n in range(8)
    ]
    got = explore.top_bottom_performers(health(spark, rows), k=3).collect()
    lists = {}
    for row in sorted(got, key=lambda r: r["rank"]):
        lists.setdefault(row["list"], []).append((row["location_name"], row["value"]))
    assert lists["healthiest_locations"] == [("P0", 90), ("P1", 90), ("P2", 90)]
    assert lists["optimal_coverage"] == [("P7", 70), ("P6", 60), ("P5", 50)]
    assert "most_critical_items" not in lists


def test_daily_lists(spark):
    frame = daily(spark, records([0], closing_stock=99.0) + records([0], item_code="I2")
                  + records([1], closing_stock=1.0))
    assert [r["closing_stock"] for r in explore.low_stock_today(frame, TODAY).collect()] == [99]
    dates = [r["record_date"] for r in explore.recent_records(frame, TODAY, 7, 2).collect()]
    assert dates == [TODAY, TODAY - dt.timedelta(days=1)]


def test_classified_and_summaries_agree(spark):
    rows = records([0, 1], issues=5.0, closing_stock=30.0) + records([0], item_code="I2")
    frame = classified(spark, rows)
    got = rollups.list_summary(explore.health_list(frame)).first()
    assert (got["items_displayed"], got["at_risk"], got["critical"]) == (2, 1, 0)


def test_calendar_keeps_movements_of_unknown_codes(spark):
    frame = daily(spark, records([1], location_code=None, issues=2.0))
    got = ledger.dense_calendar(frame, ago(2), TODAY).orderBy("record_date").collect()
    assert [(r["has_record"], r["issues"]) for r in got] == [(False, 0), (True, 2), (False, 0)]


def test_calendar_ends_bound_the_stockout_date(spark):
    last = (dt.date.max - TODAY).days
    rows = spark.createDataFrame([(last,), (last + 1,), (-3,)], "days bigint")
    got = [r[0] for r in rows.select(dates.plus_days(TODAY, F.col("days"))).collect()]
    assert got == [dt.date.max, None, ago(3)]


def test_matrix_has_a_cell_for_every_item(spark):
    rows = [{"item_name": f"Item {n}", "item_code": f"I{n}"} for n in range(30)]
    assert rollups.location_item_matrix(health(spark, rows)).count() == 30
    wide = rollups.location_item_matrix(health(spark, rows), ["Item 1", "Item 2"])
    assert wide.columns == ["location_name", "Item 1", "Item 2"]
