"""Data-quality checks of daily stock records and master data."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.nulls import count_if, is_blank
from shelfwise.operators.frames import one_row
from shelfwise.operators.positions import PAIR
from shelfwise.schemas import MEASURES, as_double

REQUIRED_COLUMNS = (
    "record_date",
    "location_code",
    "item_code",
    "opening_stock",
    "receipts",
    "issues",
    "closing_stock",
)
# Fixed values.
TOLERANCE = 0.01
LARGEST_OPENING = 1_000_000
LARGEST_ISSUE = 10_000
SHORTEST_LEAD, LONGEST_LEAD = 1, 90

ISSUE, WARNING, METRIC = "ISSUE", "WARNING", "METRIC"


def balance_difference() -> Column:
    return F.abs(
        F.col("closing_stock") - (F.col("opening_stock") + F.col("receipts") - F.col("issues"))
    )


@dataclass(frozen=True)
class QualityRule:
    """A rule and the SQL predicate that its violations meet ({as_of} is the date)."""

    name: str
    kind: str
    predicate: str
    severity: str = "MEDIUM"
    is_active: bool = True


DEFAULT_RULES = (
    QualityRule("Negative Closing Stock", "NEGATIVE_STOCK", "closing_stock < 0", "HIGH"),
    QualityRule(
        "Missing Location Name", "MISSING_DATA", "location_name IS NULL OR location_name = ''"
    ),
    QualityRule("Missing Item Name", "MISSING_DATA", "item_name IS NULL OR item_name = ''"),
    QualityRule(
        "Stock Mismatch", "ANOMALY", "opening_stock + receipts - issues != closing_stock", "HIGH"
    ),
    QualityRule("Future Date", "ANOMALY", "record_date > DATE'{as_of}'", "CRITICAL"),
)


def rules_of(table: DataFrame) -> list[QualityRule]:
    """The rules of a rule table (rule_name, rule_type, rule_sql, severity, is_active).

    A rule table is configuration: its rows are read to build the expressions from them.
    """
    rows = table.select("rule_name", "rule_type", "rule_sql", "severity", "is_active").collect()
    return [QualityRule(*row[:4], is_active=row[4] is not False) for row in rows]


def _predicate(rule: QualityRule, as_of: dt.date) -> Column:
    """The condition a rule's violations meet; other braces of its text stay as they are."""
    return F.expr((rule.predicate or "false").replace("{as_of}", as_of.isoformat()))


def rule_violations(
    daily: DataFrame,
    as_of: dt.date,
    rules: Sequence[QualityRule] | DataFrame = DEFAULT_RULES,
) -> DataFrame:
    """Violations per active rule, all rules in one pass over the records; no row without one.

    A rule without a predicate has no violations.
    """
    if isinstance(rules, DataFrame):
        rules = rules_of(rules)
    active = [rule for rule in rules if rule.is_active]
    if not active:
        schema = "rule_name string, rule_type string, severity string, violations bigint"
        return daily.sparkSession.createDataFrame([], schema)
    counts = daily.agg(
        *[
            count_if(_predicate(rule, as_of)).alias(f"_{n}")
            for n, rule in enumerate(active)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(rule.name).alias("rule_name"),
                F.lit(rule.kind).alias("rule_type"),
                F.lit(rule.severity).alias("severity"),
                F.col(f"_{n}").alias("violations"),
            )
            for n, rule in enumerate(active)
        ]
    )
    return counts.select(F.inline(rows))


def violating_rows(daily: DataFrame, as_of: dt.date, rule: QualityRule) -> DataFrame:
    """The records that break one rule."""
    return daily.filter(_predicate(rule, as_of))


def duplicate_records(daily: DataFrame, *keys: str) -> DataFrame:
    """Keys (date, location, item unless given) that occur more than once, with their copies."""
    return (
        daily.groupBy(*(keys or ("record_date", *PAIR)))
        .agg(F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )


def duplicate_rows(daily: DataFrame) -> DataFrame:
    """All copies of every duplicated key."""
    keys = duplicate_records(daily).select(
        *[F.col(name).alias(f"_{name}") for name in ("record_date", *PAIR)]
    )
    same = (
        F.col("record_date").eqNullSafe(F.col("_record_date"))
        & F.col("location_code").eqNullSafe(F.col("_location_code"))
        & F.col("item_code").eqNullSafe(F.col("_item_code"))
    )
    return daily.join(keys, same, "left_semi")


def missing_columns(daily: DataFrame) -> list[str]:
    return [name for name in REQUIRED_COLUMNS if name not in daily.columns]


def _by_day(daily: DataFrame, as_of: dt.date) -> DataFrame:
    """All checks summed per (location, item, date).

    The one shuffle of the raw records, combined map-side: a key with very many copies
    arrives as one partial row per task, and later steps see one row per pair and day.
    """
    difference = balance_difference()
    return (
        daily.withColumns(as_double(*MEASURES))
        .groupBy(*PAIR, "record_date")
        .agg(
            F.count("*").alias("records"),
            count_if(F.col("closing_stock") < 0).alias("negative"),
            count_if(difference > TOLERANCE).alias("mismatched"),
            F.max(difference).alias("difference"),
            *[count_if(F.col(name).isNull()).alias(f"null_{name}") for name in MEASURES],
            F.max("opening_stock").alias("opening"),
            F.max("issues").alias("issued"),
        )
        .withColumns(
            {
                "future": F.when(F.col("record_date") > F.lit(as_of), F.col("records")),
                "copies": F.when(F.col("records") > 1, F.col("records")),
                "no_location": F.when(is_blank(F.col("location_code")), F.col("records")),
                "no_item": F.when(is_blank(F.col("item_code")), F.col("records")),
            }
        )
    )


def _totals(daily: DataFrame, as_of: dt.date) -> DataFrame:
    """Every count of the validation in one row: per day, then per pair, then over all."""
    in_order = Window.partitionBy(*PAIR).orderBy("record_date")
    known_pair = F.col("location_code").isNotNull() & F.col("item_code").isNotNull()
    step = F.datediff(F.col("record_date"), F.lag("record_date").over(in_order))
    sums = ("records", "negative", "mismatched", "future", "copies", "no_location", "no_item",
            *[f"null_{name}" for name in MEASURES])
    per_pair = (
        _by_day(daily, as_of)
        .withColumn("_gap", known_pair & (step > 1))
        .groupBy(*PAIR)
        .agg(
            *[F.sum(name).alias(name) for name in sums],
            *[F.max(name).alias(name) for name in ("difference", "opening", "issued")],
            F.max("_gap").alias("has_gap"),
            F.min("record_date").alias("first_date"),
            F.max("record_date").alias("last_date"),
        )
    )
    return per_pair.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sums],
        *[F.max(name).alias(name) for name in ("difference", "opening", "issued")],
        count_if(F.col("has_gap")).alias("pairs_with_gaps"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.count_distinct("location_code").alias("unique_locations"),
        F.count_distinct("item_code").alias("unique_items"),
    )


def quality_verdict(daily: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per check: name, level and number of findings.

    Findings of level ISSUE make the data invalid, WARNINGs do not. A missing required
    column stops the validation, as nothing else can be computed without it.
    """
    missing = missing_columns(daily)
    if missing:
        rows = [("missing_required_columns", ISSUE, len(missing))]
        return daily.sparkSession.createDataFrame(rows, "check string, level string, findings long")
    checks = [
        ("negative_stock", ISSUE, F.col("negative")),
        ("balance_mismatch", ISSUE, F.col("mismatched")),
        ("future_date", ISSUE, F.col("future")),
        ("duplicate_records", ISSUE, F.col("copies")),
        ("missing_location_code", WARNING, F.col("no_location")),
        ("missing_item_code", WARNING, F.col("no_item")),
        ("date_gaps", WARNING, F.col("pairs_with_gaps")),
        *[(f"null_{name}", WARNING, F.col(f"null_{name}")) for name in MEASURES],
        ("large_opening_stock", WARNING, _exceeds("opening", LARGEST_OPENING)),
        ("large_issues", WARNING, _exceeds("issued", LARGEST_ISSUE)),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.lit(level).alias("level"),
                findings.cast("bigint").alias("findings"),
            )
            for name, level, findings in checks
        ]
    )
    return _totals(daily, as_of).select(F.inline(rows))


def _exceeds(name: str, bound: float) -> Column:
    return F.when(F.col(name) > bound, 1).otherwise(0)


def data_profile(daily: DataFrame, as_of: dt.date) -> DataFrame:
    """Completeness figures in one row."""
    return _totals(daily, as_of).select(
        F.col("records").alias("total_records"),
        "unique_locations",
        "unique_items",
        F.col("first_date").alias("date_range_start"),
        F.col("last_date").alias("date_range_end"),
        F.datediff("last_date", "first_date").cast("bigint").alias("days_covered"),
        *[f"null_{name}" for name in MEASURES],
        F.col("opening").alias("largest_opening_stock"),
        F.col("issued").alias("largest_issues"),
        F.when(F.col("mismatched") > 0, F.col("difference")).alias("max_balance_difference"),
    )


def _copies(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows whose key occurs more than once."""
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias(name))
    )


def master_checks(locations: DataFrame, items: DataFrame) -> DataFrame:
    """Duplicate codes, missing names, odd lead times and row counts of the masters."""
    lead = F.col("default_lead_time_days")
    odd_lead = (
        (lead < SHORTEST_LEAD) | (lead > LONGEST_LEAD)
        if "default_lead_time_days" in items.columns
        else F.lit(False)
    )
    facts = one_row(
        _copies(locations, "location_code", "duplicate_locations"),
        locations.agg(
            count_if(F.col("location_name").isNull()).alias("missing_location_names"),
            F.count("*").alias("location_count"),
        ),
        _copies(items, "item_code", "duplicate_items"),
        items.agg(
            count_if(F.col("item_name").isNull()).alias("missing_item_names"),
            count_if(odd_lead).alias("unusual_lead_times"),
            F.count("*").alias("item_count"),
        ),
    )
    levels = {
        "duplicate_locations": ISSUE,
        "missing_location_names": WARNING,
        "duplicate_items": ISSUE,
        "missing_item_names": WARNING,
        "unusual_lead_times": WARNING,
        "location_count": METRIC,
        "item_count": METRIC,
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.lit(level).alias("level"),
                F.col(name).alias("findings"),
            )
            for name, level in levels.items()
        ]
    )
    return facts.select(F.inline(rows))


def is_valid(verdict: DataFrame) -> DataFrame:
    """One row: TRUE where no issue was found."""
    issues = F.when(F.col("level") == ISSUE, F.col("findings")).otherwise(0)
    return verdict.agg((F.coalesce(F.sum(issues), F.lit(0)) == 0).alias("is_valid"))


def validation_report(verdict: DataFrame, profile: DataFrame | None = None) -> str:
    """Readable report; collects the verdict's and profile's few rows."""
    found = [row for row in verdict.collect() if row["findings"]]
    issues = [row for row in found if row["level"] == ISSUE]
    warnings = [row for row in found if row["level"] == WARNING]
    passed = "PASSED - no critical issues found"
    failed = "FAILED - critical issues detected"
    lines = ["DATA VALIDATION REPORT", f"Validation {failed if issues else passed}", ""]
    if profile is not None:
        row = profile.first()
        if row is not None:
            lines += ["Metrics:", *[f"  {key}: {value}" for key, value in row.asDict().items()], ""]
    for title, rows in (("Critical issues", issues), ("Warnings", warnings)):
        lines.append(f"{title}:" if rows else f"{title}: none")
        lines += [f"  {n}. {row['check']}: {row['findings']}" for n, row in enumerate(rows, 1)]
        lines.append("")
    return "\n".join(lines)
