"""Latest row per (location, item), and conditional rewrites of rows."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PAIR = ("location_code", "item_code")
DESCRIPTION = ("location_name", "item_name", "item_category", "unit_of_measure")


def _recency(daily: DataFrame) -> Column:
    """Sort value of a record: date, then record id, then stock and lead time.

    All go into one DECIMAL, so that the MAX_BY buffers keep a fixed width and the
    aggregation stays a hash aggregate instead of a sort. The date decides first; among
    copies of a day the highest id wins over the whole BIGINT range and any id over NULL.
    Without an id column the copy with the most stock wins, then the longest lead time.
    """
    whole = "decimal(38,0)"
    if "stock_record_id" in daily.columns:
        second = F.col("stock_record_id").cast("bigint").cast(whole)
    else:
        second = (F.col("closing_stock").try_cast("decimal(18,2)") * 100).cast(whole)
    lead = F.greatest(F.col("lead_time_days").cast("int"), F.lit(0)).cast(whole)
    day = F.unix_date("record_date").cast(whole)
    step = lambda bits: F.lit(Decimal(2**bits)).cast(whole)
    lowest = F.lit(Decimal(-(2**63) - 1)).cast(whole)
    value = day * step(65) + F.coalesce(second, lowest)
    return (value.cast(whole) * step(31) + F.coalesce(lead, F.lit(0))).cast(whole)


POSITION_COLUMNS = (
    "location_code",
    "location_name",
    "item_code",
    "item_name",
    "item_category",
    "latest_date",
    "closing_stock",
    "unit_of_measure",
    "lead_time_days",
)


def position_measures(daily: DataFrame) -> list[Column]:
    """The aggregates that find a pair's most recent record, with its recency."""
    recency = _recency(daily)
    return [
        F.max(recency).alias("recency"),
        F.max("record_date").alias("latest_date"),
        F.max_by(F.col("closing_stock").cast("double"), recency).alias("closing_stock"),
        F.max_by("lead_time_days", recency).alias("lead_time_days"),
    ]


def position_candidates(daily: DataFrame) -> DataFrame:
    """The most recent record per pair and description, with its recency.

    Combines map-side, so the shuffle carries about one row per pair and task however
    many records a pair has.
    """
    return (
        daily.filter(F.col("record_date").isNotNull())
        .groupBy(*PAIR, *DESCRIPTION)
        .agg(*position_measures(daily))
    )


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates of several sets of records as one row per pair and description."""
    return candidates.groupBy(*PAIR, *DESCRIPTION).agg(
        F.max("recency").alias("recency"),
        F.max("latest_date").alias("latest_date"),
        F.max_by("closing_stock", "recency").alias("closing_stock"),
        F.max_by("lead_time_days", "recency").alias("lead_time_days"),
    )


def choose_positions(candidates: DataFrame) -> DataFrame:
    """One position per pair: a renamed item or location leaves several candidates.

    Candidates of equal recency compare by their details, so that the choice repeats.
    """
    details = [name for name in POSITION_COLUMNS if name not in PAIR]
    return (
        candidates.groupBy(*PAIR)
        .agg(F.max(F.struct("recency", *details)).alias("_latest"))
        .select(
            *[
                F.col(name if name in PAIR else f"_latest.{name}")
                for name in POSITION_COLUMNS
            ]
        )
    )


def latest_stock_position(daily: DataFrame) -> DataFrame:
    """The most recent record of every pair; on one date the highest record id wins."""
    return choose_positions(position_candidates(daily))


def conditional_update(
    df: DataFrame, where: Column, assignments: Mapping[str, Column]
) -> DataFrame:
    """UPDATE ... SET ... WHERE: every right-hand side reads the old values."""
    return df.withColumns(
        {
            name: F.when(where, value).otherwise(F.col(name))
            for name, value in assignments.items()
        }
    )


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Missing fields of the columns present take their declared default."""
    present = {name: value for name, value in defaults.items() if name in df.columns}
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value).cast(df.schema[name].dataType))
            for name, value in present.items()
        }
    )
