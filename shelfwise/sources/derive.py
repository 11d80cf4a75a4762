"""Stock tables derived from order tables (lineitem, supplier, part, nation, region).

A location is a supplier nation, an item a part brand, a record date a ship date.
Returned lines are receipts, all others issues. The initial stock of a pair is chosen
so that its last closing stock lies between 0 and 1200.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators.ledger import daily_movements, stock_ledger

# Fixed values of the mapping.
CATEGORIES = (
    "MEDICINE",
    "MEDICINE_ANTIBIOTIC",
    "MEDICINE_ANALGESIC",
    "MEDICINE_CARDIOVASCULAR",
    "FOOD",
    "FOOD_GRAIN",
    "FOOD_DAIRY",
    "FOOD_PROTEIN",
    "MEDICAL_SUPPLY",
    "MEDICAL_SUPPLY_CONSUMABLE",
    "PPE",
    "EQUIPMENT",
)
UNITS = ("TABLETS", "BOXES", "KG", "UNITS")
LEAD_TIMES = ("5", "7", "10", "14")
REGIONS = ("North", "South", "East", "West", "Central")
LOCATION_TYPES = ("HOSPITAL", "WAREHOUSE", "DISTRIBUTION_CENTER", "NGO_CENTER")
PRIORITIES = ("HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW", "")

# Columns read from the order tables.
INPUT_SCHEMAS = {
    "lineitem": "l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string, "
    "l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_brand string, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


@dataclass(frozen=True)
class StockTables:
    daily: DataFrame
    items: DataFrame
    locations: DataFrame
    params: DataFrame


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One order table by its declared schema, so that no job runs to infer it."""
    return spark.read.schema(INPUT_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    """The index-th of a few texts, counted modulo their number; "" stands for NULL."""
    texts = F.array(*map(F.lit, values))
    return F.nullif(F.element_at(texts, (index % len(values) + 1).cast("int")), F.lit(""))


def location_code(nation: Column) -> Column:
    return F.concat(F.lit("LOC"), F.lpad(nation.cast("string"), 3, "0"))


def item_code(brand: Column) -> Column:
    return F.concat(F.lit("Brand#"), brand.cast("string"))


def _item_name(brand: Column) -> Column:
    return F.concat(F.lit("Item "), F.lpad(brand.cast("string"), 2, "0"))


def _brand_number() -> Column:
    return F.substring("p_brand", 7, 10).cast("int")


def as_of_date(spark: SparkSession, sf_dir: str) -> dt.date:
    """The last ship date: one aggregate over one column, one value to the driver."""
    row = read_table(spark, sf_dir, "lineitem").agg(
        F.to_date(F.max("l_shipdate")).alias("as_of")
    ).first()
    return row["as_of"]


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: nation, brand, date, receipts, issues."""
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"
    )
    suppliers = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")
    )
    parts = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), _brand_number().alias("brand")
    )
    returned = F.col("l_returnflag") == "R"
    return (
        lines.join(suppliers, "l_suppkey")
        .join(parts, "l_partkey")
        .select(
            "nation",
            "brand",
            F.to_date("l_shipdate").alias("record_date"),
            F.when(returned, F.col("l_quantity")).otherwise(0.0).alias("receipts"),
            F.when(returned, 0.0).otherwise(F.col("l_quantity")).alias("issues"),
        )
    )


def daily_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table: a ledger row per location, item and day.

    Balances are computed on the bare numbers; codes and names are added to the result.
    """
    nation, brand = F.col("nation"), F.col("brand")
    nations = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nation"), F.col("n_name").alias("location_name")
    )
    whole_pair = (
        Window.partitionBy("nation", "brand")
        .orderBy("record_date")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    offset = ((nation * 7 + brand * 3) % 41) * 30.0
    started = daily_movements(shipments(spark, sf_dir), "nation", "brand").withColumn(
        "initial_stock", F.sum(F.col("issues") - F.col("receipts")).over(whole_pair) + offset
    )
    return (
        stock_ledger(started, "nation", "brand")
        .join(nations, "nation", "left")
        .select(
            "record_date",
            location_code(nation).alias("location_code"),
            "location_name",
            item_code(brand).alias("item_code"),
            _item_name(brand).alias("item_name"),
            _pick(CATEGORIES, brand).alias("item_category"),
            "opening_stock",
            "receipts",
            "issues",
            "closing_stock",
            _pick(UNITS, brand).alias("unit_of_measure"),
            F.when(nation != 24, 6 + nation % 3).alias("lead_time_days"),
        )
    )


def item_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand but number 23, which stays without master data."""
    brand = F.col("brand")
    safety = (brand % 5) * 20.0
    supplier = (brand % 5 + 1).cast("string")
    return (
        read_table(spark, sf_dir, "part")
        .groupBy(_brand_number().alias("brand"))
        .agg((F.min("p_retailprice") / 100).alias("unit_cost"))
        .filter(brand != 23)
        .select(
            item_code(brand).alias("item_code"),
            _item_name(brand).alias("item_name"),
            _pick(CATEGORIES, brand).alias("item_category"),
            _pick(UNITS, brand).alias("unit_of_measure"),
            "unit_cost",
            (brand % 3 == 0).alias("is_critical"),
            F.when(brand % 2 == 1, safety * 1.5 + 10).alias("reorder_point"),
            safety.alias("safety_stock"),
            F.when(brand % 11 != 0, _pick(LEAD_TIMES, brand).cast("int")).alias(
                "default_lead_time_days"
            ),
            F.concat(F.lit("Supplier "), supplier).alias("supplier_name"),
            F.concat(F.lit("SUP00"), supplier).alias("supplier_code"),
            F.lit(True).alias("is_active"),
        )
    )


def location_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation; every seventh priority is unknown."""
    nation = F.col("n_nationkey")
    regions = read_table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), "r_name"
    )
    return (
        read_table(spark, sf_dir, "nation")
        .join(regions, "n_regionkey", "left")
        .select(
            location_code(nation).alias("location_code"),
            F.col("n_name").alias("location_name"),
            _pick(LOCATION_TYPES, nation).alias("location_type"),
            _pick(REGIONS, F.col("n_regionkey")).alias("region"),
            F.col("r_name").alias("state"),
            _pick(PRIORITIES, nation).alias("priority_level"),
            (nation % 13 != 12).alias("is_active"),
        )
    )


def item_location_params(items: DataFrame, locations: DataFrame) -> DataFrame:
    """Overrides for every pair whose nation and brand numbers add up to a multiple of 4."""
    brand = F.substring("item_code", 7, 10).cast("int")
    nation = F.substring("location_code", 4, 10).cast("int")
    left = items.select(
        "item_code",
        brand.alias("brand"),
        "default_lead_time_days",
        "safety_stock",
        ((4 - brand % 4) % 4).alias("_class"),
    )
    right = locations.select(
        "location_code", nation.alias("nation"), "region", (nation % 4).alias("_class")
    )
    return left.join(right, "_class").select(
        "location_code",
        "item_code",
        F.when(
            F.col("region").isin("North", "Central"), F.col("default_lead_time_days") + 2
        ).alias("custom_lead_time_days"),
        (F.col("safety_stock") * 1.5).alias("custom_reorder_point"),
        F.when(F.col("brand") % 2 == 0, F.col("safety_stock")).alias("custom_safety_stock"),
        F.when(F.col("nation") % 2 == 0, F.lit(400.0)).alias("max_stock_level"),
        F.lit(True).alias("is_stocked"),
    )


def load_tables(spark: SparkSession, sf_dir: str) -> StockTables:
    items = item_master(spark, sf_dir)
    locations = location_master(spark, sf_dir)
    return StockTables(
        daily=daily_stock(spark, sf_dir),
        items=items,
        locations=locations,
        params=item_location_params(items, locations),
    )
