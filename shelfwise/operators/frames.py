"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(*frames: DataFrame) -> DataFrame:
    """Puts one-row frames side by side without a join (NULL-padded union, one aggregate)."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.agg(*[F.first(name, ignorenulls=True).alias(name) for name in merged.columns])


def emit_rules(facts: DataFrame, rules: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """One output row per rule whose condition holds on the one-row ``facts``."""
    found = F.array(
        *[
            F.when(
                condition,
                F.struct(
                    F.lit(number).alias("rule_no"),
                    *[value.cast("string").alias(name) for name, value in outputs.items()],
                ),
            )
            for number, (condition, outputs) in enumerate(rules, 1)
        ]
    )
    return facts.select(F.inline(F.filter(found, lambda rule: rule.isNotNull())))
