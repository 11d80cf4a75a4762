"""Reference rows: item categories and alert configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise import schemas
from shelfwise.sources.readers import literal_rows

# Fixed values: (code, name, parent, display order, colour).
CATEGORY_ROWS = (
    ("MEDICINE", "Medicines", None, 1, "#FF6B6B"),
    ("MEDICINE_ANTIBIOTIC", "Antibiotics", "MEDICINE", 11, "#FF6B6B"),
    ("MEDICINE_ANALGESIC", "Analgesics", "MEDICINE", 12, "#FF6B6B"),
    ("MEDICINE_CARDIOVASCULAR", "Cardiovascular", "MEDICINE", 13, "#FF6B6B"),
    ("FOOD", "Food Items", None, 2, "#4ECDC4"),
    ("FOOD_GRAIN", "Grains", "FOOD", 21, "#4ECDC4"),
    ("FOOD_DAIRY", "Dairy Products", "FOOD", 22, "#4ECDC4"),
    ("FOOD_PROTEIN", "Proteins", "FOOD", 23, "#4ECDC4"),
    ("MEDICAL_SUPPLY", "Medical Supplies", None, 3, "#95E1D3"),
    ("MEDICAL_SUPPLY_CONSUMABLE", "Consumables", "MEDICAL_SUPPLY", 31, "#95E1D3"),
    ("PPE", "Personal Protective Equipment", None, 4, "#F38181"),
    ("EQUIPMENT", "Medical Equipment", None, 5, "#AA96DA"),
)
# Fixed values: (name, type, threshold days, severity).
ALERT_ROWS = (
    ("Critical Stock-Out Alert", "STOCK_OUT", 0, "CRITICAL"),
    ("3-Day Stock-Out Warning", "CRITICAL", 3, "CRITICAL"),
    ("Low Stock Alert", "LOW_STOCK", 7, "HIGH"),
    ("Overstock Warning", "OVERSTOCK", 60, "MEDIUM"),
    ("Expiry Warning - 30 Days", "EXPIRY_WARNING", 30, "MEDIUM"),
)


def item_categories(spark: SparkSession) -> DataFrame:
    names = schemas.ITEM_CATEGORIES.names
    return literal_rows(
        spark, [dict(zip(names, row)) for row in CATEGORY_ROWS], schemas.ITEM_CATEGORIES
    )


def alert_config(spark: SparkSession) -> DataFrame:
    names = ("alert_name", "alert_type", "threshold_days", "severity")
    rows = [{**dict(zip(names, row)), "is_active": True} for row in ALERT_ROWS]
    return literal_rows(spark, rows, schemas.ALERT_CONFIG)
