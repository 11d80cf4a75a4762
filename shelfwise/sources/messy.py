"""Records with every kind of flaw that the quality checks look for.

Which record gets which flaw follows from its date, location and item by fixed arithmetic,
so the same flaws come out wherever the tables are derived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_number() -> Column:
    """Days since 1970 + 5 * location number + 3 * item number."""
    location = F.substring("location_code", 4, 9).cast("int")
    item = F.substring("item_code", 7, 9).cast("int")
    return F.unix_date("record_date") + 5 * location + 3 * item


def messy_records(daily: DataFrame) -> DataFrame:
    """Daily records with negative, missing, large and unbalanced figures, missing codes and
    names, and copies."""
    rest = lambda divisor, remainder: F.col("_k") % divisor == remainder
    missing = lambda name, kind="double": F.lit(None).cast(kind)
    numbered = daily.withColumn("_k", record_number())
    flawed = numbered.withColumns(
        {
            "closing_stock": F.when(rest(97, 0), F.lit(-5.0))
            .when(rest(89, 1), F.col("closing_stock") + 1)
            .when(rest(83, 2), missing("closing_stock"))
            .otherwise(F.col("closing_stock")),
            "opening_stock": F.when(rest(79, 3), missing("opening_stock"))
            .when(rest(101, 4), F.lit(2_000_000.0))
            .otherwise(F.col("opening_stock")),
            "receipts": F.when(~rest(73, 5), F.col("receipts")),
            "issues": F.when(rest(71, 6), missing("issues"))
            .when(rest(103, 7), F.lit(20_000.0))
            .otherwise(F.col("issues")),
            "location_code": F.when(rest(67, 8), missing("location_code", "string"))
            .when(rest(61, 9), F.lit(""))
            .otherwise(F.col("location_code")),
            "item_code": F.when(rest(59, 10), missing("item_code", "string"))
            .when(rest(53, 11), F.lit(""))
            .otherwise(F.col("item_code")),
            "location_name": F.when(~rest(47, 12), F.col("location_name")),
            "item_name": F.when(rest(43, 13), F.lit("")).otherwise(F.col("item_name")),
            "_copies": F.when(rest(41, 14), 2).otherwise(1),
        }
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    return flawed.select(*daily.columns, copies).drop("_copy")


def messy_locations(locations: DataFrame) -> DataFrame:
    """Locations of which every fifth has no name and every seventh shares the code of LOC001."""
    number = F.substring("location_code", 4, 9).cast("int")
    return locations.withColumns(
        {
            "location_name": F.when(number % 5 != 0, F.col("location_name")),
            "location_code": F.when(number % 7 == 1, F.lit("LOC001")).otherwise(
                F.col("location_code")
            ),
        }
    )


def messy_items(items: DataFrame) -> DataFrame:
    """Items with missing names, a shared code and lead times of 0 and 91 days."""
    number = F.substring("item_code", 7, 9).cast("int")
    return items.withColumns(
        {
            "item_name": F.when(number % 6 != 0, F.col("item_name")),
            "default_lead_time_days": F.when(number % 8 == 1, F.lit(0))
            .when(number % 8 == 2, F.lit(91))
            .otherwise(F.col("default_lead_time_days")),
            "item_code": F.when(number % 9 == 1, F.lit("Brand#1")).otherwise(F.col("item_code")),
        }
    )
