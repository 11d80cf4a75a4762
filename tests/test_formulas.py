import pytest
from pyspark.sql import functions as F

from shelfwise.functions import labels, nulls, stock


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "cover, lead, idle, low, high, exact",
    [
        (20.0, 7, 0, 90, 100, 80 + (20 - 10.5) / 7 * 10),
        (3.0, 7, 0, 10, 30, 3 / 3.5 * 25),
        (0.0, 7, 0, 0, 0, 0),
        (30.0, 7, 35, 55, 65, 60),
        (500.0, 7, 0, 100, 100, 100),
        (8.0, 7, 0, 50, 80, 50 + 1 / 3.5 * 30),
        (5.0, 7, 0, 25, 50, 25 + 1.5 / 3.5 * 25),
        (0.0, 7, 31, 60, 60, 60),
    ],
)
def test_health_score(spark, cover, lead, idle, low, high, exact):
    score = one(spark, stock.health_score(F.lit(cover), F.lit(lead), F.lit(idle)))
    assert low <= score <= high
    assert score == pytest.approx(exact)


@pytest.mark.parametrize(
    "issue, lead, held, safety, expected",
    [(50.0, 7, 200.0, 100.0, 320), (20.0, 7, 500.0, 50.0, 0), (100.0, 7, 50.0, 200.0, 990),
     (0.0, 7, 0.0, 100.0, 0)],
)
def test_reorder_quantity(spark, issue, lead, held, safety, expected):
    value = one(
        spark, stock.reorder_quantity(F.lit(issue), F.lit(lead), F.lit(safety), F.lit(held))
    )
    assert value == pytest.approx(expected, abs=0.01)


@pytest.mark.parametrize(
    "held, issue, expected", [(500.0, 25.0, 20), (500.0, 0.0, 999), (50.0, 25.0, 2)]
)
def test_days_of_cover(spark, held, issue, expected):
    assert one(spark, stock.days_of_cover(F.lit(held), F.lit(issue))) == expected


RISK_CASES = [
    (0.0, 0, 7, 0, "OUT_OF_STOCK", "BLACK"),
    (50.0, 2, 7, 0, "CRITICAL", "DARK_RED"),
    (200.0, 5, 7, 0, "HIGH_RISK", "RED"),
    (300.0, 9, 7, 0, "MEDIUM_RISK", "ORANGE"),
    (500.0, 20, 7, 0, "HEALTHY", "GREEN"),
    (1000.0, 100, 7, 65, "OVERSTOCK", "PURPLE"),
    (500.0, 100, 7, 35, "SLOW_MOVING", "YELLOW"),
    (500.0, 100, 7, None, "HEALTHY", "GREEN"),
]


@pytest.mark.parametrize("held, days, lead, idle, name, color", RISK_CASES)
def test_risk_class(spark, held, days, lead, idle, name, color):
    arguments = [F.lit(held), F.lit(days), F.lit(lead), F.lit(idle).cast("int")]
    assert one(spark, stock.risk_class(*arguments)) == name
    assert one(spark, stock.risk_color(*arguments)) == color


@pytest.mark.parametrize(
    "held, days, critical, place, expected",
    [
        (0.0, 0, True, "HIGH", 195),
        (9.0, 10, False, "MEDIUM", 50),
        (9.0, 20, True, "HIGH", 97.5),
        (9.0, 2, False, "LOW", (100 - 2 / 7 * 30) * 0.8),
        (9.0, 20, None, None, 50),
    ],
)
def test_procurement_priority(spark, held, days, critical, place, expected):
    value = one(
        spark,
        stock.procurement_priority(
            F.lit(held), F.lit(days), F.lit(7), F.lit(critical).cast("boolean"),
            F.lit(place).cast("string"),
        ),
    )
    assert value == pytest.approx(expected)


@pytest.mark.parametrize(
    "held, days, expected",
    [(0.0, 50, 100), (5.0, 0, 100), (5.0, 3, 95), (5.0, 5, 100 - 5 / 7 * 30),
     (5.0, 9, 70 - 2 / 3.5 * 20), (5.0, 11, 50)],
)
def test_urgency_has_the_three_day_step(spark, held, days, expected):
    assert one(spark, stock.urgency_score(F.lit(held), F.lit(days), F.lit(7))) == pytest.approx(
        expected
    )


def test_zero_lead_time_gives_null_not_an_error(spark):
    assert one(spark, stock.health_score(F.lit(5.0), F.lit(0), F.lit(0))) is None


def test_greatest_and_least_keep_null(spark):
    missing = F.lit(None).cast("double")
    assert one(spark, nulls.greatest(F.lit(0.0), missing)) is None
    assert one(spark, nulls.least(F.lit(0.0), missing)) is None
    assert one(spark, nulls.greatest(F.lit(0.0), F.lit(3.0))) == 3.0


def test_number_or_zero(spark):
    assert one(spark, nulls.number_or_zero(F.lit("x1"))) == 0.0
    assert one(spark, nulls.number_or_zero(F.lit("2.5"))) == 2.5
    assert one(spark, nulls.number_or_zero(F.lit(None).cast("string"))) == 0.0


def test_labels(spark):
    assert one(spark, labels.tidy(F.lit("HIGH_RISK"))) == "High Risk"
    assert one(spark, labels.hex_color(F.lit("CRITICAL"))) == "#dc2626"
    assert one(spark, labels.hex_color(F.lit("SLOW_MOVING"))) == labels.DEFAULT_HEX_COLOR
    assert one(spark, labels.icon(F.lit("other"))) == labels.DEFAULT_ICON
    assert one(spark, labels.band(F.lit(59.9))) == "40-59"
    assert one(spark, labels.fixed(F.lit(12.25), 1)) == "12.2"


def test_traffic_light(spark):
    lights = [one(spark, stock.traffic_light(F.lit(c), F.lit(10))) for c in (10.0, 15.0, 15.1)]
    assert lights == ["RED", "YELLOW", "GREEN"]
