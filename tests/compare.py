"""Runs a registered query and its DuckDB twin and compares all rows."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return str(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    plain = [tuple(_plain(row[n]) for n in order) for row in rows]
    return sorted(columns), sorted(plain, key=repr)


def differences(frame, connection, sql: str) -> list[str]:
    """Empty when both sides give the same columns, kinds and rows."""
    expected = connection.sql(sql)
    want = _sorted_rows(expected.columns, expected.fetchall())
    got = _sorted_rows(frame.columns, [tuple(row) for row in frame.collect()])
    found = []
    if want[0] != got[0]:
        return [f"columns differ: spark {got[0]} duckdb {want[0]}"]
    kinds = {
        "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
        "BOOLEAN": "boolean", "DATE": "date",
    }
    spark_kinds = dict(frame.dtypes)
    for name, kind in zip(expected.columns, expected.types):
        if kinds.get(str(kind), str(kind)) != spark_kinds[name]:
            found.append(f"type of {name}: spark {spark_kinds[name]} duckdb {kind}")
    if len(want[1]) != len(got[1]):
        found.append(f"rows: spark {len(got[1])} duckdb {len(want[1])}")
    unequal = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if unequal:
        found.append(f"{len(unequal)} rows differ, first {dict(zip(want[0], zip(*unequal[0])))}")
    return found
