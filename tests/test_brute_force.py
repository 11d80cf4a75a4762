"""Random records with NULLs, ties, renames and future dates against plain Python."""

import math
import random
import statistics
from collections import defaultdict

import pytest

from shelfwise import schemas
from shelfwise.functions.stock import RISK_CLASSES
from shelfwise.operators import ledger, quality, reorder, rollups
from tests.fixtures import TODAY, ago, classified, daily, table

NAMES = ("location_name", "item_name", "item_category", "unit_of_measure")


def _records(seed):
    rnd = random.Random(seed)
    rows = []
    for number in range(500):
        rows.append({
            "stock_record_id": number,
            "record_date": ago(rnd.choice([0, 0, 1, 2, 6, 7, 8, 13, 14, 15, 29, 30, 31, 45, 61,
                                           62, 89, 90, 91, 120, -1, -40, -41])),
            "location_code": f"L{rnd.randint(0, 7)}",
            "item_code": f"I{rnd.randint(0, 9)}",
            "item_name": rnd.choice(["Item"] * 19 + [None]),
            "opening_stock": float(rnd.randint(0, 50)),
            "receipts": rnd.choice([0.0, 5.0, None]),
            "issues": rnd.choice([None, 0.0, 0.0, 1.0, 7.0, 20.0, -2.0]),
            "closing_stock": rnd.choice([None, -3.0, 0.0, 1.0, 40.0, 150.0, 900.0]),
            "lead_time_days": rnd.choice([None, 5, 9]),
        })
    rnd.shuffle(rows)
    return rows


def _mean(values):
    return math.fsum(values) / len(values) if values else None


def _consumption(rows):
    groups = defaultdict(list)
    for row in rows:
        age = (TODAY - row["record_date"]).days
        if age <= 90:
            groups[row["location_code"], row["item_code"], row["item_name"]].append((age, row))
    found = defaultdict(list)
    for (place, item, _), aged in groups.items():
        out = {}
        for days in (7, 14, 30):
            values = [r["issues"] for age, r in aged if age <= days and r["issues"] is not None]
            out[f"avg_{days}"] = _mean(values)
            out[f"sum_{days}"] = None if all(
                age <= days and r["issues"] is None for age, r in aged
            ) else sum(values)
            out[f"dev_{days}"] = statistics.stdev(values) if len(values) > 1 else None
        moved = [age for age, r in aged if (r["issues"] or 0) > 0]
        out["days"] = len({age for age in moved if age <= 30})
        out["idle"] = min(moved) if moved else None
        found[place, item].append(out)
    return found


def _score(cover, lead, idle):
    if idle is not None and idle > 30:
        return 60
    if cover is None:
        return 0
    if cover > lead * 1.5:
        return min(100, 80 + (cover - lead * 1.5) / lead * 10)
    if cover > lead:
        return 50 + (cover - lead) / (lead * 0.5) * 30
    if cover > lead * 0.5:
        return 25 + (cover - lead * 0.5) / (lead * 0.5) * 25
    return cover / (lead * 0.5) * 25 if cover > 0 else 0


def _risk(held, days, lead, idle):
    if held is not None and held <= 0:
        return "OUT_OF_STOCK"
    if days is not None:
        for limit, name in ((3, "CRITICAL"), (lead, "HIGH_RISK"), (lead * 1.5, "MEDIUM_RISK")):
            if days <= limit:
                return name
    if idle is not None and idle > 30:
        return "OVERSTOCK" if idle > 60 else "SLOW_MOVING"
    return "HEALTHY"


def _expected(rows):
    latest = {}
    for row in rows:
        key = row["location_code"], row["item_code"]
        rank = row["record_date"], row["stock_record_id"]
        if key not in latest or rank > latest[key][0]:
            latest[key] = rank, row
    used = _consumption(rows)
    result = []
    for key, (_, row) in latest.items():
        for c in used.get(key) or [{}]:
            use = next(
                (c[f"avg_{d}"] for d in (14, 7, 30) if c.get(f"avg_{d}") is not None), 0
            )
            held = row["closing_stock"]
            lead = row["lead_time_days"] or 7
            cover = (None if held is None else held / use) if use > 0 else 999
            days = None if cover is None else math.floor(cover) if use > 0 else 999
            idle = c.get("idle")
            result.append((
                *key, held, lead, use, c.get("days"), idle, days,
                _score(cover, lead, idle), _risk(held, days, lead, idle),
            ))
    return result


def _key(row):
    return tuple((value is None, value if value is not None else 0) for value in
                 (round(v, 6) if isinstance(v, float) else v for v in row))


def _close(got, expected):
    assert len(got) == len(expected)
    for left, right in zip(sorted(got, key=_key), sorted(expected, key=_key)):
        for a, b in zip(left, right):
            assert a == b or a == pytest.approx(b), (left, right)


@pytest.mark.parametrize("seed", [1, 2])
def test_classification(spark, seed):
    rows = _records(seed)
    got = classified(spark, rows).select(
        "location_code", "item_code", "closing_stock", "lead_time_days", "avg_daily_issue",
        "days_with_movement_30d", "days_since_last_movement", "days_until_stockout",
        "stock_health_score", "risk_classification",
    ).collect()
    _close([tuple(r) for r in got], _expected(rows))


def test_consumption_columns(spark):
    from shelfwise.operators.consumption import consumption_metrics

    rows = _records(3)
    got = consumption_metrics(daily(spark, rows), TODAY).collect()
    measured = [
        tuple(r[f"{kind}_{days}d"] for days in (7, 14, 30)
              for kind in ("avg_daily_issue", "total_issues", "stddev_issues"))
        for r in got
    ]
    expected = [
        tuple(c[f"{kind}_{days}"] for days in (7, 14, 30) for kind in ("avg", "sum", "dev"))
        for found in _consumption(rows).values() for c in found
    ]
    _close(measured, expected)


def test_roll_ups_add_up(spark):
    rows = _records(4)
    health = classified(spark, rows).cache()
    expected = _expected(rows)
    by_class = {r[0]: r[1] for r in rollups.risk_counts(health).collect()}
    assert by_class == {
        name: n for name in RISK_CLASSES
        if (n := sum(row[-1] == name for row in expected))
    }
    matrix = rollups.location_risk_matrix(health).collect()
    for name in RISK_CLASSES:
        assert sum(r[name.lower()] for r in matrix) == by_class.get(name, 0)
    summary = rollups.location_risk_summary(health).collect()
    assert sum(r["total_items"] for r in summary) == len(expected)
    items = table(spark, schemas.ITEM_MASTER, [{"item_code": "I1", "unit_cost": 3}])
    recs = reorder.reorder_recommendations(health, items, TODAY)
    executive = rollups.executive_summary(health, items).first()
    assert executive["total_reorder_recommendations"] == recs.count()
    assert reorder.reorder_queue(recs, 5).count() == 5
    health.unpersist()


def test_quality_counts(spark):
    rows = _records(5)
    frame = daily(spark, rows)
    got = {r["check"]: r["findings"] for r in quality.quality_verdict(frame, TODAY).collect()}
    keys = defaultdict(int)
    for r in rows:
        keys[r["record_date"], r["location_code"], r["item_code"]] += 1
    assert got["duplicate_records"] == sum(n for n in keys.values() if n > 1)
    assert got["negative_stock"] == sum((r["closing_stock"] or 0) < 0 for r in rows)
    assert got["future_date"] == sum(r["record_date"] > TODAY for r in rows)
    assert got["null_issues"] == sum(r["issues"] is None for r in rows)
    off = [
        abs(r["closing_stock"] - (r["opening_stock"] + r["receipts"] - r["issues"]))
        for r in rows if None not in (r["closing_stock"], r["receipts"], r["issues"])
    ]
    assert got["balance_mismatch"] == sum(d > 0.01 for d in off)
    days = defaultdict(set)
    for date, place, item in keys:
        days[place, item].add(date)
    gaps = {
        pair: sum((b - a).days > 1 for a, b in zip(sorted(found), sorted(found)[1:]))
        for pair, found in days.items()
    }
    assert got["date_gaps"] == sum(n > 0 for n in gaps.values())
    listed = ledger.date_gaps(frame).collect()
    assert {(r["location_code"], r["item_code"]): r["gaps"] for r in listed} == {
        pair: n for pair, n in gaps.items() if n
    }
