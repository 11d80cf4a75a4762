"""Inline rows for the tests: daily records and master data with defaults."""

from __future__ import annotations

import datetime as dt

from shelfwise import schemas

TODAY = dt.date(2024, 6, 30)

DAILY_DDL = (
    "stock_record_id long, record_date date, location_code string, location_name string, "
    "item_code string, item_name string, item_category string, opening_stock double, "
    "receipts double, issues double, closing_stock double, unit_of_measure string, "
    "lead_time_days int"
)
DAILY_DEFAULTS = {
    "stock_record_id": None,
    "record_date": TODAY,
    "location_code": "L1",
    "location_name": "Place 1",
    "item_code": "I1",
    "item_name": "Item 1",
    "item_category": "MEDICINE",
    "opening_stock": 0.0,
    "receipts": 0.0,
    "issues": 0.0,
    "closing_stock": 100.0,
    "unit_of_measure": "BOXES",
    "lead_time_days": 7,
}


def ago(days: int) -> dt.date:
    return TODAY - dt.timedelta(days=days)


def daily(spark, rows: list[dict]):
    full = [tuple({**DAILY_DEFAULTS, **row}.values()) for row in rows]
    return spark.createDataFrame(full, DAILY_DDL)


def records(days, **fields) -> list[dict]:
    """One record per number of days ago."""
    return [{**fields, "record_date": ago(n)} for n in days]


def table(spark, schema, rows: list[dict]):
    from shelfwise.sources.readers import literal_rows

    return literal_rows(spark, rows, schema)


def empty_masters(spark):
    return (
        table(spark, schemas.ITEM_MASTER, []),
        table(spark, schemas.LOCATION_MASTER, []),
        table(spark, schemas.ITEM_LOCATION_PARAMS, []),
    )


def classified(
    spark, rows: list[dict], items=None, locations=None, params=None, as_of=TODAY, **options
):
    from shelfwise.operators.health import stock_health_classification

    no_items, no_locations, no_params = empty_masters(spark)
    return stock_health_classification(
        daily(spark, rows),
        no_items if items is None else items,
        no_locations if locations is None else locations,
        no_params if params is None else params,
        as_of,
        **options,
    )


def by(frame, *keys):
    """Collected rows by the value(s) of the key columns."""
    found = {}
    for row in frame.collect():
        key = tuple(row[k] for k in keys)
        found[key[0] if len(keys) == 1 else key] = row
    return found
