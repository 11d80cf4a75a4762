"""What changed between two snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(keys: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"{prefix}{key}"))
    return condition


def change_capture(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows removed from ``before`` and added in ``after``, counted with their copies.

    Both snapshots are tagged -1 and +1 and summed per distinct row, which leaves only
    the rows whose number changed. That needs one aggregation instead of an outer join,
    so repeated keys cannot multiply. A key with rows on both sides is an UPDATE: its
    old rows have action DELETE and its new ones INSERT, as in a table change stream.
    """
    columns = before.columns
    net = (
        before.withColumn("_side", F.lit(-1))
        .unionByName(after.select(*columns).withColumn("_side", F.lit(1)))
        .groupBy(*columns)
        .agg(F.sum("_side").alias("_net"))
        .filter(F.col("_net") != 0)
    )
    sides = net.groupBy(*[F.col(key).alias(f"_{key}") for key in keys]).agg(
        (F.min("_net") < 0).alias("_removed"), (F.max("_net") > 0).alias("_added")
    )
    change = (
        F.when(F.col("_removed") & F.col("_added"), "UPDATE")
        .when(F.col("_added"), "INSERT")
        .otherwise("DELETE")
    )
    return net.join(sides, _same(keys, "_")).select(
        *columns,
        change.alias("change_type"),
        F.when(F.col("_net") > 0, "INSERT").otherwise("DELETE").alias("action"),
        F.abs("_net").alias("copies"),
    )
