from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.operators import quality
from tests.fixtures import TODAY, by, daily, records, table


def _messy(spark):
    good = dict(opening_stock=10.0, receipts=5.0, issues=3.0, closing_stock=12.0)
    rows = records([0, 1, 2], **good)
    rows += records([3, 3], **good)  # duplicate key
    rows += records([9], **good)  # after a gap of six days
    rows += records([0], item_code="neg", opening_stock=0.0, issues=4.0, closing_stock=-4.0)
    rows += records([0], item_code="off", opening_stock=1.0, closing_stock=1.02)
    rows += records([1], item_code="off", opening_stock=1.0, closing_stock=1.005)
    rows += records([-1], item_code="future", closing_stock=0.0)
    rows += records([0], item_code="", location_code=None, closing_stock=0.0)
    rows += records([5], item_code="", location_code=None, closing_stock=0.0)
    rows += records([0], item_code="nulls", issues=None, closing_stock=None)
    rows += records([0], item_code="big", opening_stock=2e6, issues=20000.0,
                    closing_stock=2e6 - 20000)
    return daily(spark, rows)


EXPECTED = {
    "negative_stock": ("ISSUE", 1),
    "balance_mismatch": ("ISSUE", 1),
    "future_date": ("ISSUE", 1),
    "duplicate_records": ("ISSUE", 2),
    "missing_location_code": ("WARNING", 2),
    "missing_item_code": ("WARNING", 2),
    "date_gaps": ("WARNING", 1),
    "null_opening_stock": ("WARNING", 0),
    "null_receipts": ("WARNING", 0),
    "null_issues": ("WARNING", 1),
    "null_closing_stock": ("WARNING", 1),
    "large_opening_stock": ("WARNING", 1),
    "large_issues": ("WARNING", 1),
}


def test_verdict_and_report(spark):
    verdict = quality.quality_verdict(_messy(spark), TODAY)
    got = {r["check"]: (r["level"], r["findings"]) for r in verdict.collect()}
    assert got == EXPECTED
    assert quality.is_valid(verdict).first()["is_valid"] is False
    report = quality.validation_report(verdict, quality.data_profile(_messy(spark), TODAY))
    assert "FAILED" in report
    assert "duplicate_records: 2" in report
    assert "null_receipts" not in report.split("Warnings")[1]


def test_clean_data_passes(spark):
    clean = daily(spark, records([0, 1, 2], closing_stock=0.0))
    verdict = quality.quality_verdict(clean, TODAY)
    assert quality.is_valid(verdict).first()["is_valid"] is True
    report = quality.validation_report(verdict)
    assert "PASSED" in report and "Warnings: none" in report


def test_missing_columns_stop_the_validation(spark):
    got = quality.quality_verdict(_messy(spark).drop("issues", "receipts"), TODAY).collect()
    assert [tuple(r) for r in got] == [("missing_required_columns", "ISSUE", 2)]


def test_profile(spark):
    got = quality.data_profile(_messy(spark), TODAY).first()
    assert got["total_records"] == 14
    assert got["unique_locations"] == 1
    assert got["unique_items"] == 7
    assert got["days_covered"] == 10
    assert abs(got["max_balance_difference"] - 0.02) < 1e-9
    tidy = quality.data_profile(daily(spark, records([0], closing_stock=0.0)), TODAY).first()
    assert tidy["max_balance_difference"] is None


def test_balance_tolerance(spark):
    rows = [dict(opening_stock=100.0, receipts=50.0, issues=30.0, closing_stock=c)
            for c in (120.0, 100.0)]
    difference = daily(spark, rows).select(quality.balance_difference().alias("d")).collect()
    assert [r["d"] < quality.TOLERANCE for r in difference] == [True, False]


def test_rules(spark):
    got = by(quality.rule_violations(_messy(spark), TODAY), "rule_name")
    assert {k: r["violations"] for k, r in got.items()} == {
        "Negative Closing Stock": 1, "Missing Location Name": 0, "Missing Item Name": 0,
        "Stock Mismatch": 2, "Future Date": 1,
    }
    own = quality.QualityRule("Big", "ANOMALY", "issues > 10000")
    off = quality.QualityRule("Off", "ANOMALY", "true", is_active=False)
    got = quality.rule_violations(_messy(spark), TODAY, [own, off]).collect()
    assert [tuple(r) for r in got] == [("Big", "ANOMALY", "MEDIUM", 1)]
    rules = spark.createDataFrame(
        [("Big", "ANOMALY", "issues > 10000", "LOW", True), ("Off", "ANOMALY", "true", "LOW", False)],
        "rule_name string, rule_type string, rule_sql string, severity string, is_active boolean",
    )
    got = quality.rule_violations(_messy(spark), TODAY, rules).collect()
    assert [tuple(r) for r in got] == [("Big", "ANOMALY", "LOW", 1)]
    assert quality.violating_rows(_messy(spark), TODAY, own).first()["item_code"] == "big"


def test_duplicates_with_unknown_codes(spark):
    frame = daily(spark, records([0, 0, 0], item_code=None) + records([0, 1]))
    assert quality.duplicate_records(frame).first()["copies"] == 3
    assert quality.duplicate_rows(frame).filter(F.col("item_code").isNull()).count() == 3
    assert quality.duplicate_rows(frame).count() == 3


def test_masters(spark):
    places = table(spark, schemas.LOCATION_MASTER, [
        {"location_code": "a", "location_name": "A"}, {"location_code": "a", "location_name": "B"},
        {"location_code": "b"},
    ])
    goods = table(spark, schemas.ITEM_MASTER, [
        {"item_code": f"i{n}", "item_name": "x", "default_lead_time_days": lead}
        for n, lead in enumerate((0, 1, 90, 91, None))
    ] + [{"item_code": "i0"}])
    got = {r["check"]: r["findings"] for r in quality.master_checks(places, goods).collect()}
    assert got == {
        "duplicate_locations": 2, "missing_location_names": 1, "duplicate_items": 2,
        "missing_item_names": 1, "unusual_lead_times": 2, "location_count": 3, "item_count": 6,
    }


def test_rule_texts_may_hold_braces_or_be_missing(spark):
    rows = daily(spark, records([0], item_name="{a} {} {as_of", closing_stock=0.0) + records([-1], closing_stock=1.0))
    rules = [
        quality.QualityRule("braces", "X", "item_name LIKE '%{a}%{}%{as_of'"),
        quality.QualityRule("regular", "X", "item_name RLIKE '^[{]a[}].{3,}$'"),
        quality.QualityRule("late", "X", "record_date > DATE'{as_of}'"),
        quality.QualityRule("none", "X", None),
        quality.QualityRule("off", "X", "true", is_active=False),
    ]
    got = {r["rule_name"]: r["violations"] for r in quality.rule_violations(rows, TODAY, rules).collect()}
    assert got == {"braces": 1, "regular": 1, "late": 1, "none": 0}
    assert [quality.violating_rows(rows, TODAY, r).count() for r in rules[:4]] == [1, 1, 1, 0]
    assert quality.rule_violations(rows, TODAY, rules[4:]).collect() == []
