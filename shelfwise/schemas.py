"""Declared schemas of the stock tables (codes are strings, quantities DECIMAL(18,2))."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STR, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()
_BOOL, _DATE, _TS = T.BooleanType(), T.DateType(), T.TimestampNTZType()
_QTY = T.DecimalType(18, 2)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, *rest) for name, kind, *rest in fields])


DAILY_STOCK = _schema(
    ("stock_record_id", _LONG),
    ("record_date", _DATE),
    ("location_code", _STR),
    ("location_name", _STR),
    ("item_code", _STR),
    ("item_name", _STR),
    ("item_category", _STR),
    ("opening_stock", _QTY),
    ("receipts", _QTY),
    ("issues", _QTY),
    ("closing_stock", _QTY),
    ("unit_of_measure", _STR),
    ("lead_time_days", _INT),
    ("data_source", _STR),
    ("created_timestamp", _TS),
    ("modified_timestamp", _TS),
)

LOCATION_MASTER = _schema(
    ("location_id", _LONG),
    ("location_code", _STR),
    ("location_name", _STR),
    ("location_type", _STR),
    ("region", _STR),
    ("district", _STR),
    ("state", _STR),
    ("country", _STR),
    ("address", _STR),
    ("contact_person", _STR),
    ("contact_phone", _STR),
    ("contact_email", _STR),
    ("is_active", _BOOL),
    ("priority_level", _STR),
    ("capacity_rating", _INT),
    ("created_timestamp", _TS),
    ("modified_timestamp", _TS),
)

ITEM_MASTER = _schema(
    ("item_id", _LONG),
    ("item_code", _STR),
    ("item_name", _STR),
    ("item_category", _STR),
    ("item_subcategory", _STR),
    ("unit_of_measure", _STR),
    ("standard_pack_size", T.DecimalType(10, 2)),
    ("unit_cost", _QTY),
    ("is_critical", _BOOL),
    ("is_controlled", _BOOL),
    ("storage_requirements", _STR),
    ("shelf_life_days", _INT),
    ("reorder_point", _QTY),
    ("safety_stock", _QTY),
    ("default_lead_time_days", _INT),
    ("supplier_name", _STR),
    ("supplier_code", _STR),
    ("is_active", _BOOL),
    ("created_timestamp", _TS),
    ("modified_timestamp", _TS),
)

SUPPLIER_MASTER = _schema(
    ("supplier_id", _LONG),
    ("supplier_code", _STR),
    ("supplier_name", _STR),
    ("supplier_type", _STR),
    ("contact_person", _STR),
    ("contact_phone", _STR),
    ("contact_email", _STR),
    ("address", _STR),
    ("city", _STR),
    ("state", _STR),
    ("country", _STR),
    ("average_lead_time_days", _INT),
    ("reliability_rating", T.DecimalType(3, 1)),
    ("is_active", _BOOL),
    ("payment_terms", _STR),
    ("created_timestamp", _TS),
    ("modified_timestamp", _TS),
)

ITEM_LOCATION_PARAMS = _schema(
    ("param_id", _LONG),
    ("location_code", _STR),
    ("item_code", _STR),
    ("custom_lead_time_days", _INT),
    ("custom_reorder_point", _QTY),
    ("custom_safety_stock", _QTY),
    ("max_stock_level", _QTY),
    ("min_order_quantity", _QTY),
    ("is_stocked", _BOOL),
    ("last_order_date", _DATE),
    ("notes", _STR),
    ("created_timestamp", _TS),
    ("modified_timestamp", _TS),
)

ALERT_CONFIG = _schema(
    ("alert_config_id", _LONG),
    ("alert_name", _STR),
    ("alert_type", _STR),
    ("threshold_days", _INT),
    ("severity", _STR),
    ("notification_email", _STR),
    ("is_active", _BOOL),
    ("location_filter", _STR),
    ("item_category_filter", _STR),
    ("created_timestamp", _TS),
    ("modified_timestamp", _TS),
)

AUDIT_LOG = _schema(
    ("audit_id", _LONG),
    ("event_timestamp", _TS),
    ("event_type", _STR),
    ("event_description", _STR),
    ("user_name", _STR),
    ("location_code", _STR),
    ("item_code", _STR),
    ("old_value", _STR),  # JSON text
    ("new_value", _STR),  # JSON text
    ("ip_address", _STR),
    ("session_id", _STR),
)

PROCUREMENT_ACTIONS = _schema(
    ("action_id", _LONG),
    ("action_date", _DATE),
    ("location_code", _STR),
    ("item_code", _STR),
    ("action_type", _STR),
    ("recommended_quantity", _QTY),
    ("actual_quantity", _QTY),
    ("order_reference", _STR),
    ("supplier_code", _STR),
    ("expected_delivery_date", _DATE),
    ("actual_delivery_date", _DATE),
    ("status", _STR),
    ("notes", _STR),
    ("created_by", _STR),
    ("created_timestamp", _TS),
    ("modified_timestamp", _TS),
)

ITEM_CATEGORIES = _schema(
    ("category_code", _STR),
    ("category_name", _STR),
    ("parent_category", _STR),
    ("display_order", _INT),
    ("color_code", _STR),
)

ALERT_HISTORY = _schema(
    ("alert_date", _DATE),
    ("location_code", _STR),
    ("item_code", _STR),
    ("alert_type", _STR),
    ("severity", _STR),
    ("stock_health_score", T.DoubleType()),
    ("days_of_cover", T.DoubleType()),
    ("created_timestamp", _TS),
)

# Values a missing field takes on load, per table.
DAILY_STOCK_DEFAULTS = {
    "opening_stock": 0,
    "receipts": 0,
    "issues": 0,
    "closing_stock": 0,
    "unit_of_measure": "UNITS",
    "lead_time_days": 7,
}
LOCATION_DEFAULTS = {"country": "India", "is_active": True, "priority_level": "MEDIUM"}
ITEM_DEFAULTS = {
    "unit_of_measure": "UNITS",
    "is_critical": False,
    "is_controlled": False,
    "default_lead_time_days": 7,
    "is_active": True,
}

MEASURES = ("opening_stock", "receipts", "issues", "closing_stock")


def as_double(*names: str) -> dict[str, Column]:
    """Casts for ``withColumns``: measures are stored as decimals, computed as doubles."""
    return {name: F.col(name).cast("double") for name in names}
