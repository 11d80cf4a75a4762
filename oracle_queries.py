"""DuckDB twins of the registered queries, over the same order tables.

One prelude of common table expressions derives the stock tables and the classified
stock; each query adds its own SELECT. Unreferenced expressions cost nothing.
"""

from __future__ import annotations

from string import Formatter

# Fixed values of the specification, written out so that the twins stand alone.
ACTION_OUT = "URGENT: Place emergency order immediately"
ACTION_OVER = "Review for redistribution or reduced ordering"
ACTION_SOON = "Place order today - stock-out expected in {days} days"
MESSAGES = {
    "OUT_OF_STOCK": "{item} is OUT OF STOCK at {place}. Immediate action required.",
    "CRITICAL": "{item} at {place} will run out in {days} days. Current stock: {stock} {unit}",
    "HIGH_RISK": "{item} at {place} requires reorder. {days} days of supply remaining.",
    "OVERSTOCK": "{item} at {place} has not moved in {idle} days. Consider redistribution.",
}
EXCELLENT_ROI = (
    "✅ **Excellent ROI**: Expected returns exceed 20%, indicating highly efficient inventory "
    "management."
)
GOOD_ROI = "⚠️ **Good ROI**: Returns are positive but there's room for optimization."
HIGH_CRITICAL_SPEND = (
    "🔴 **High Critical Spend**: Over 30% of reorder budget is for critical items. Consider "
    "increasing safety stock."
)
POOR_ROI = "🔴 **Action Required**: Consider reviewing procurement strategies to improve ROI."
SAVINGS_RATE = 0.15
STOCKOUT_COST = 500
TOP_CATEGORY = "📦 **Top Category**: {category} requires the highest reorder investment."
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
LEAD_TIMES = ("5", "7", "10", "14")
LOCATION_TYPES = ("HOSPITAL", "WAREHOUSE", "DISTRIBUTION_CENTER", "NGO_CENTER")
PRIORITIES = ("HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW", "")
REGIONS = ("North", "South", "East", "West", "Central")
UNITS = ("TABLETS", "BOXES", "KG", "UNITS")
DEFAULT_HEX_COLOR = "#6b7280"
DEFAULT_ICON = "⚪"
HEX_COLORS = {
    "OUT_OF_STOCK": "#1f2937",
    "CRITICAL": "#dc2626",
    "HIGH_RISK": "#f59e0b",
    "MEDIUM_RISK": "#fbbf24",
    "HEALTHY": "#10b981",
    "OVERSTOCK": "#3b82f6",
}
ICONS = {
    "OUT_OF_STOCK": "🚫",
    "CRITICAL": "🔴",
    "HIGH_RISK": "⚠️",
    "MEDIUM_RISK": "🟡",
    "HEALTHY": "✅",
    "OVERSTOCK": "📦",
}
LOWEST_BADGE = "Critical"
LOWEST_BAND = "below 40"
LOWEST_MONITORING = "Critical"
MONITORING_BANDS = ((80, "Healthy"), (50, "Monitoring"))
SCORE_BANDS = ((80, "80+"), (60, "60-79"), (40, "40-59"))
SUMMARY_BADGES = ((80, "Excellent"), (60, "Fair"))
CALENDAR_DAYS = 60
COMPARED_LOCATIONS = ("NATION_1", "NATION_5", "NATION_12", "NATION_20")
CUSTOM_THRESHOLDS = (("Item 03", 14), ("Item 08", 30), ("Item 17", 2))
RETENTION_DAYS = 365
SCENARIOS = ((0, 0, 100), (25, 0, 100), (-50, 50, 80), (100, 100, 200), (33, -25, 150))
SEARCH_TEXT = "Food_Gr"
ADVICE = {
    "critical": ("🔴 High",
                 "Increase Safety Stock",
                 "{critical_pct}% items at risk",
                 "Reduce stockout risk by 40%"),
    "overstock": ("🟡 Medium",
                  "Optimize Reorder Quantities",
                  "{overstock_pct}% items overstocked",
                  "Free up $5K-10K in working capital"),
    "slow": ("🟠 Low",
             "Review Slow-Moving Items",
             "{slow} slow movers identified",
             "Reduce holding costs by 15%"),
    "worst": ("🔴 High",
              "Priority Support for {worst}",
              "Health score: {worst_score}/100",
              "Improve overall system health by 8%"),
    "best": ("⭐ Strategic",
             "Replicate Best Practices from {best}",
             "Health score: {best_score}/100",
             "System-wide efficiency improvement"),
}
ALERT_ROWS = (
    ("Critical Stock-Out Alert", "STOCK_OUT", 0, "CRITICAL"),
    ("3-Day Stock-Out Warning", "CRITICAL", 3, "CRITICAL"),
    ("Low Stock Alert", "LOW_STOCK", 7, "HIGH"),
    ("Overstock Warning", "OVERSTOCK", 60, "MEDIUM"),
    ("Expiry Warning - 30 Days", "EXPIRY_WARNING", 30, "MEDIUM"),
)
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
RISK_CLASSES = (
    "OUT_OF_STOCK",
    "CRITICAL",
    "HIGH_RISK",
    "MEDIUM_RISK",
    "OVERSTOCK",
    "SLOW_MOVING",
    "HEALTHY",
)
RISK_COLORS = ("BLACK", "DARK_RED", "RED", "ORANGE", "PURPLE", "YELLOW", "GREEN")
RISK_WEIGHTS = {"OUT_OF_STOCK": 100, "CRITICAL": 90, "HIGH_RISK": 70, "MEDIUM_RISK": 40}


def _literal(value) -> str:
    if value is None or value == "":
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def _pick(values, index: str) -> str:
    inner = ", ".join(_literal(value) for value in values)
    return f"([{inner}])[({index}) % {len(values)} + 1]"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(_literal(value) for value in row) + ")" for row in rows)


def _class_count(*names: str) -> str:
    inner = ", ".join(_literal(name) for name in names)
    return f"count(*) FILTER (WHERE risk_classification IN ({inner}))"


AS_OF = "(SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)"


def _window_metrics(days: int) -> str:
    inside = f"FILTER (WHERE record_date >= {AS_OF} - {days})"
    return f"""
      avg(issues) {inside} AS avg_daily_issue_{days}d,
      coalesce(sum(issues) {inside}, 0) AS total_issues_{days}d,
      round(stddev_samp(issues) {inside}, 6) AS stddev_issues_{days}d"""


def _by_risk(values) -> str:
    tests = (
        "closing_stock <= 0",
        "days_until_stockout <= 3",
        "days_until_stockout <= lead_time_days",
        "days_until_stockout <= 1.5 * lead_time_days",
        "days_since_last_movement > 60",
        "days_since_last_movement > 30",
    )
    arms = " ".join(f"WHEN {t} THEN {_literal(v)}" for t, v in zip(tests, values))
    return f"CASE {arms} ELSE {_literal(values[-1])} END"


RISK_WEIGHT = (
    "CASE risk_classification "
    + " ".join(f"WHEN '{name}' THEN {weight}" for name, weight in RISK_WEIGHTS.items())
    + " ELSE 0 END"
)
NEEDS_REORDER = """(days_until_stockout <= 1.5 * lead_time_days
      OR closing_stock <= coalesce(reorder_point, 0)
      OR risk_classification IN ('OUT_OF_STOCK', 'CRITICAL', 'HIGH_RISK'))"""
LEAD_URGENCY = "100 - days_until_stockout / lead_time_days * 30"

_SOURCES = {
    "item": "item_name",
    "place": "location_name",
    "days": "days_until_stockout",
    "stock": "CAST(closing_stock AS DECIMAL(18, 2))",
    "unit": "unit_of_measure",
    "idle": "days_since_last_movement",
    "category": "item_category",
    "critical_pct": "format('{:.1f}', rate * 100)",
    "overstock_pct": "format('{:.1f}', rate * 100)",
    "slow": "n",
    "worst": "location_name",
    "best": "location_name",
    "worst_score": "format('{:.1f}', stock_health_score)",
    "best_score": "format('{:.1f}', stock_health_score)",
}


def _text(template: str) -> str:
    """A text template as a chain of literals and columns."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(_literal(text))
        if name is not None:
            parts.append(_SOURCES[name])
    return " || ".join(parts)


_ALERT_MESSAGES = " ".join(
    f"WHEN '{name}' THEN {_text(text)}" for name, text in MESSAGES.items()
)

PRELUDE = f"""
WITH shipments AS (
  SELECT s_nationkey AS nation, CAST(substr(p_brand, 7) AS INTEGER) AS brand,
    CAST(l_shipdate AS DATE) AS record_date,
    CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS receipts,
    CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS issues
  FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey
  JOIN part ON p_partkey = l_partkey
), moved AS (
  SELECT nation, brand, record_date, sum(receipts) AS receipts, sum(issues) AS issues
  FROM shipments GROUP BY nation, brand, record_date
), started AS (
  SELECT *, ((nation * 7 + brand * 3) % 41) * 30.0
    + sum(issues - receipts) OVER (PARTITION BY nation, brand) AS initial_stock
  FROM moved
), balanced AS (
  SELECT *, initial_stock + sum(receipts - issues) OVER (
      PARTITION BY nation, brand ORDER BY record_date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS closing_stock
  FROM started
), daily AS (
  SELECT record_date,
    'LOC' || lpad(CAST(nation AS VARCHAR), 3, '0') AS location_code,
    n_name AS location_name,
    'Brand#' || CAST(brand AS VARCHAR) AS item_code,
    'Item ' || lpad(CAST(brand AS VARCHAR), 2, '0') AS item_name,
    {_pick(CATEGORIES, "brand")} AS item_category,
    coalesce(lag(closing_stock) OVER (PARTITION BY nation, brand ORDER BY record_date),
      initial_stock) AS opening_stock,
    receipts, issues, closing_stock,
    {_pick(UNITS, "brand")} AS unit_of_measure,
    CASE WHEN nation <> 24 THEN 6 + nation % 3 END AS lead_time_days
  FROM balanced LEFT JOIN nation ON n_nationkey = nation
), brands AS (
  SELECT CAST(substr(p_brand, 7) AS INTEGER) AS brand, min(p_retailprice) / 100 AS unit_cost
  FROM part GROUP BY 1
), items AS (
  SELECT brand, 'Brand#' || CAST(brand AS VARCHAR) AS item_code,
    'Item ' || lpad(CAST(brand AS VARCHAR), 2, '0') AS item_name,
    {_pick(CATEGORIES, "brand")} AS item_category,
    unit_cost, brand % 3 = 0 AS is_critical,
    CAST((brand % 5) * 20 AS DOUBLE) AS safety_stock,
    CASE WHEN brand % 2 = 1 THEN CAST((brand % 5) * 30 + 10 AS DOUBLE) END AS reorder_point,
    CASE WHEN brand % 11 <> 0 THEN CAST({_pick(LEAD_TIMES, "brand")} AS INTEGER) END
      AS default_lead_time_days,
    'Supplier ' || CAST(brand % 5 + 1 AS VARCHAR) AS supplier_name,
    'SUP00' || CAST(brand % 5 + 1 AS VARCHAR) AS supplier_code
  FROM brands WHERE brand <> 23
), locations AS (
  SELECT n_nationkey AS nation,
    'LOC' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS location_code,
    n_name AS location_name,
    {_pick(LOCATION_TYPES, "n_nationkey")} AS location_type,
    {_pick(REGIONS, "n_regionkey")} AS region,
    {_pick(PRIORITIES, "n_nationkey")} AS priority_level,
    n_nationkey % 13 <> 12 AS is_active
  FROM nation
), params AS (
  SELECT location_code, item_code,
    CASE WHEN region IN ('North', 'Central') THEN default_lead_time_days + 2 END
      AS custom_lead_time_days,
    safety_stock * 1.5 AS custom_reorder_point,
    CASE WHEN brand % 2 = 0 THEN safety_stock END AS custom_safety_stock,
    CASE WHEN nation % 2 = 0 THEN CAST(400 AS DOUBLE) END AS max_stock_level
  FROM items, locations WHERE (nation + brand) % 4 = 0
), position AS (
  SELECT location_code, location_name, item_code, item_name, item_category,
    record_date AS latest_date, closing_stock, unit_of_measure, lead_time_days
  FROM daily
  QUALIFY row_number() OVER (PARTITION BY location_code, item_code
    ORDER BY record_date DESC) = 1
), consumption AS (
  SELECT location_code, location_name, item_code, item_name, item_category, unit_of_measure,
    {_window_metrics(7)},
    {_window_metrics(14)},
    {_window_metrics(30)},
    count(DISTINCT record_date) FILTER (WHERE record_date >= {AS_OF} - 30 AND issues > 0)
      AS days_with_movement_30d,
    max(record_date) FILTER (WHERE issues > 0) AS last_movement_date,
    CAST({AS_OF} - max(record_date) FILTER (WHERE issues > 0) AS INTEGER)
      AS days_since_last_movement
  FROM daily WHERE record_date >= {AS_OF} - 90
  GROUP BY location_code, location_name, item_code, item_name, item_category, unit_of_measure
), joined AS (
  SELECT p.location_code, p.location_name, p.item_code, p.item_name, p.item_category,
    p.latest_date, p.closing_stock, p.unit_of_measure,
    CAST(coalesce(o.custom_lead_time_days, i.default_lead_time_days, p.lead_time_days, 7)
      AS INTEGER) AS lead_time_days,
    coalesce(o.custom_safety_stock, i.safety_stock, 0) AS safety_stock,
    coalesce(o.custom_reorder_point, i.reorder_point) AS reorder_point,
    coalesce(o.max_stock_level, CAST(999999 AS DOUBLE)) AS max_stock_level,
    coalesce(c.avg_daily_issue_14d, c.avg_daily_issue_7d, c.avg_daily_issue_30d, 0)
      AS avg_daily_issue,
    c.total_issues_7d, c.total_issues_14d, c.total_issues_30d, c.days_with_movement_30d,
    c.last_movement_date, c.days_since_last_movement,
    i.is_critical AS is_critical_item, l.priority_level AS location_priority
  FROM position p
  LEFT JOIN consumption c USING (location_code, item_code)
  LEFT JOIN items i USING (item_code)
  LEFT JOIN locations l USING (location_code)
  LEFT JOIN params o ON o.location_code = p.location_code AND o.item_code = p.item_code
), covered AS (
  SELECT *, CASE WHEN avg_daily_issue > 0 THEN closing_stock / avg_daily_issue END AS cover
  FROM joined
), metrics AS (
  SELECT * EXCLUDE (cover, is_critical_item, location_priority),
    coalesce(cover, CAST(999 AS DOUBLE)) AS days_of_cover,
    {AS_OF} + CAST(floor(cover) AS INTEGER) AS projected_stockout_date,
    coalesce(CAST(floor(cover) AS BIGINT), 999) AS days_until_stockout,
    is_critical_item, location_priority
  FROM covered
), health AS (
  SELECT *,
    CAST(CASE
      WHEN days_since_last_movement > 30 THEN 60
      WHEN days_of_cover > lead_time_days * 1.5
        THEN least(100, 80 + (days_of_cover - lead_time_days * 1.5) / lead_time_days * 10)
      WHEN days_of_cover > lead_time_days
        THEN 50 + (days_of_cover - lead_time_days) / (lead_time_days * 0.5) * 30
      WHEN days_of_cover > lead_time_days * 0.5
        THEN 25 + (days_of_cover - lead_time_days * 0.5) / (lead_time_days * 0.5) * 25
      WHEN days_of_cover > 0 THEN days_of_cover / (lead_time_days * 0.5) * 25
      ELSE 0 END AS DOUBLE) AS stock_health_score,
    {_by_risk(RISK_CLASSES)} AS risk_classification,
    {_by_risk(RISK_COLORS)} AS risk_color,
    coalesce(closing_stock <= 0 OR days_until_stockout <= lead_time_days, false)
      AS requires_attention,
    coalesce(days_since_last_movement > 30 AND closing_stock > avg_daily_issue * 60, false)
      AS is_overstock
  FROM metrics
), priced AS (
  SELECT h.*, i.unit_cost, i.supplier_name, i.supplier_code,
    avg_daily_issue * lead_time_days * 1.2 + h.safety_stock - closing_stock AS shortfall
  FROM (SELECT * FROM health WHERE {NEEDS_REORDER}) h LEFT JOIN items i USING (item_code)
), recommendations AS (
  SELECT location_code, location_name, item_code, item_name, item_category,
    closing_stock AS current_stock, avg_daily_issue, lead_time_days, safety_stock,
    days_of_cover, days_until_stockout, projected_stockout_date, risk_classification,
    stock_health_score,
    CASE WHEN avg_daily_issue > 0 THEN greatest(0, round(shortfall, 2)) ELSE 0 END
      AS suggested_reorder_quantity,
    CASE WHEN avg_daily_issue > 0 THEN greatest(0, shortfall) * coalesce(unit_cost, 0)
      ELSE 0 END AS estimated_order_value,
    CAST(CASE WHEN closing_stock <= 0 OR days_until_stockout = 0 THEN 100
      WHEN days_until_stockout <= 3 THEN 95
      WHEN days_until_stockout <= lead_time_days THEN {LEAD_URGENCY}
      WHEN days_until_stockout <= lead_time_days * 1.5
        THEN 70 - (days_until_stockout - lead_time_days) / (lead_time_days * 0.5) * 20
      ELSE 50 END AS DOUBLE) AS urgency_score,
    CAST(CASE WHEN closing_stock <= 0 THEN 100
      WHEN days_until_stockout <= lead_time_days THEN {LEAD_URGENCY} ELSE 50 END AS DOUBLE)
      * CASE WHEN is_critical_item THEN CAST(1.5 AS DOUBLE) ELSE 1 END
      * CASE location_priority WHEN 'HIGH' THEN CAST(1.3 AS DOUBLE) WHEN 'LOW' THEN 0.8
          ELSE 1 END AS procurement_priority_score,
    CASE WHEN days_until_stockout <= lead_time_days THEN {AS_OF}
      ELSE projected_stockout_date - lead_time_days END AS recommended_action_date,
    supplier_name, supplier_code, is_critical_item, location_priority, unit_of_measure,
    latest_date AS data_as_of_date
  FROM priced
), queue AS (
  SELECT location_code, location_name, item_code, item_name, item_category, current_stock,
    avg_daily_issue, suggested_reorder_quantity, estimated_order_value,
    procurement_priority_score, urgency_score, recommended_action_date, is_critical_item,
    days_until_stockout, risk_classification
  FROM recommendations
  ORDER BY procurement_priority_score DESC NULLS FIRST, location_code, item_code LIMIT 50
), listed AS (
  SELECT location_name, item_name, item_category, closing_stock AS current_stock,
    stock_health_score, risk_classification, days_of_cover, days_until_stockout,
    avg_daily_issue, is_critical_item, requires_attention, location_code, item_code
  FROM health
), ranked AS (
  SELECT *, CASE risk_classification WHEN 'OUT_OF_STOCK' THEN 1 WHEN 'CRITICAL' THEN 2
    WHEN 'HIGH_RISK' THEN 3 ELSE 4 END AS class_rank
  FROM health
), active AS (
  SELECT location_name || '-' || item_name AS alert_id, location_name, item_name,
    item_category, closing_stock AS current_stock, days_until_stockout,
    risk_classification AS severity, is_critical_item, projected_stockout_date
  FROM ranked WHERE requires_attention
  ORDER BY class_rank, days_until_stockout, location_code, item_code LIMIT 100
), alerts AS (
  SELECT row_number() OVER (ORDER BY class_rank, days_until_stockout,
      md5(location_code || '|' || item_code)) AS alert_id,
    CASE risk_classification WHEN 'OUT_OF_STOCK' THEN 'STOCK_OUT'
      WHEN 'CRITICAL' THEN 'CRITICAL_LOW' ELSE risk_classification END AS alert_type,
    CASE WHEN class_rank <= 2 OR coalesce(is_critical_item, false) THEN 'CRITICAL'
      WHEN class_rank = 3 THEN 'HIGH' ELSE 'LOW' END AS severity,
    location_code, location_name, item_code, item_name, item_category,
    closing_stock AS current_stock, days_until_stockout,
    CASE WHEN class_rank = 1 THEN {_literal(ACTION_OUT)}
      WHEN days_until_stockout <= lead_time_days THEN {_text(ACTION_SOON)}
      ELSE {_literal(ACTION_OVER)} END AS recommended_action,
    CASE risk_classification {_ALERT_MESSAGES} END AS alert_message,
    stock_health_score, days_of_cover
  FROM ranked
  WHERE class_rank < 4
    OR (risk_classification = 'OVERSTOCK' AND closing_stock > avg_daily_issue * 90)
), queue_cost AS (
  SELECT coalesce(sum(estimated_order_value), 0) AS total_reorder_value,
    count(*) FILTER (WHERE is_critical_item) AS critical_orders,
    coalesce(sum(estimated_order_value) FILTER (WHERE is_critical_item), 0) AS critical_value,
    count(*) AS orders
  FROM queue
), savings AS (
  SELECT *, total_reorder_value * {SAVINGS_RATE} AS potential_savings,
    critical_orders * CAST({STOCKOUT_COST} AS DOUBLE) AS stockout_prevention,
    total_reorder_value * {SAVINGS_RATE} + critical_orders * {STOCKOUT_COST}
      AS net_benefit
  FROM queue_cost
), return_on_cost AS (
  SELECT *, CASE WHEN total_reorder_value > 0
    THEN net_benefit / total_reorder_value * 100 ELSE 0 END AS roi_pct
  FROM savings
), corrected_1 AS (
  SELECT record_date, location_code, item_code, receipts,
    CASE WHEN hit THEN closing_stock + 10 ELSE issues END AS issues,
    CASE WHEN hit THEN -10 ELSE closing_stock END AS closing_stock
  FROM (SELECT *, location_code = 'LOC001' AND item_code = 'Brand#13'
    AND record_date = {AS_OF} AS hit FROM daily)
), corrected AS (
  SELECT record_date, location_code, item_code,
    CASE WHEN idle THEN 0 ELSE receipts END AS receipts,
    CASE WHEN idle THEN 0 ELSE issues END AS issues,
    CASE WHEN location_code = 'LOC002' AND item_code = 'Brand#7' AND record_date = {AS_OF}
      THEN 50 ELSE greatest(closing_stock, 0) END AS closing_stock
  FROM (SELECT *, location_code = 'LOC005' AND item_code = 'Brand#3'
    AND record_date >= {AS_OF} - 40 AS idle FROM corrected_1)
), gaps AS (
  SELECT location_code, item_code, count(*) AS gaps, max(step) AS longest_gap_days
  FROM (SELECT location_code, item_code, record_date - lag(record_date) OVER (
      PARTITION BY location_code, item_code ORDER BY record_date) AS step FROM daily)
  WHERE step > 1 AND location_code IS NOT NULL AND item_code IS NOT NULL
  GROUP BY location_code, item_code
), checked AS (
  SELECT *, abs(closing_stock - (opening_stock + receipts - issues)) AS difference FROM daily
)
"""

_CLASS_COUNTS = f"""
  {_class_count("OUT_OF_STOCK")} AS out_of_stock_count,
  {_class_count("CRITICAL")} AS critical_count,
  {_class_count("HIGH_RISK")} AS high_risk_count,
  {_class_count("MEDIUM_RISK")} AS medium_risk_count,
  {_class_count("HEALTHY")} AS healthy_count,
  {_class_count("OVERSTOCK", "SLOW_MOVING")} AS overstock_count,
  round(avg(stock_health_score), 2) AS avg_stock_health_score,
  round(avg(days_of_cover), 2) AS avg_days_of_cover"""

_LOCATION_SUMMARY = f"""
SELECT location_code, location_name, location_priority, count(*) AS total_items,
  {_CLASS_COUNTS},
  round(sum({RISK_WEIGHT}) / count(*), 2) AS location_risk_score,
  CASE WHEN {_class_count("OUT_OF_STOCK")} > 0 THEN 'CRITICAL'
    WHEN {_class_count("CRITICAL", "HIGH_RISK")} > 0.3 * count(*) THEN 'HIGH_RISK'
    WHEN {_class_count("CRITICAL", "HIGH_RISK", "MEDIUM_RISK")} > 0.5 * count(*)
      THEN 'MEDIUM_RISK'
    ELSE 'HEALTHY' END AS location_risk_classification,
  max(latest_date) AS data_as_of_date
FROM health GROUP BY location_code, location_name, location_priority"""

_EXECUTIVE = f"""
SELECT count(DISTINCT location_code) AS total_locations,
  count(DISTINCT item_code) AS total_items,
  count(*) AS total_location_item_combinations,
  {_CLASS_COUNTS},
  round({_class_count("OUT_OF_STOCK", "CRITICAL", "HIGH_RISK")} * 100.0 / count(*), 2)
    AS pct_requiring_attention,
  round({_class_count("HEALTHY")} * 100.0 / count(*), 2) AS pct_healthy,
  count(*) FILTER (WHERE is_critical_item
    AND risk_classification IN ('OUT_OF_STOCK', 'CRITICAL')) AS critical_items_at_risk,
  max(latest_date) AS data_as_of_date
FROM health"""


def _performance(key: str, average: str) -> str:
    return f"""SELECT {key}, {average} AS avg_health_score, count(item_name) AS total_items,
      count(*) FILTER (WHERE requires_attention) AS items_at_risk
      FROM health GROUP BY {key}"""


def _lookup(mapping: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{key}' THEN {_literal(value)}" for key, value in mapping.items())
    return f"CASE risk_classification {arms} ELSE {_literal(default)} END"


def _band(bands, lowest: str, score: str = "stock_health_score") -> str:
    arms = " ".join(f"WHEN {score} >= {floor} THEN {_literal(name)}" for floor, name in bands)
    return f"CASE {arms} ELSE {_literal(lowest)} END"


def _title(column: str) -> str:
    words = f"string_split(lower({column}), '_')"
    return f"list_aggregate([upper(w[1]) || w[2:] for w in {words}], 'string_agg', ' ')"


def _top(name: str, source: str, sort: str, value: str, descending: bool) -> str:
    direction = "DESC" if descending else "ASC"
    order = f"{sort} {direction}, location_name, item_name"
    return f"""SELECT '{name}' AS list, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER)
      AS rank, location_name, item_name, round({value}, 4) AS value
      FROM ({source}) ORDER BY {order} LIMIT 5"""


_MEANS = """SELECT location_name, CAST(NULL AS VARCHAR) AS item_name,
  avg(stock_health_score) AS stock_health_score FROM health GROUP BY location_name"""


def _of(condition: str) -> str:
    return f"SELECT * FROM health WHERE {condition}"


_TOPS = [
    ("healthiest_locations", _MEANS, "stock_health_score", "stock_health_score", True),
    ("locations_needing_support", _MEANS, "stock_health_score", "stock_health_score", False),
    ("best_managed_items", _of("risk_classification = 'HEALTHY'"), "stock_health_score",
     "stock_health_score", True),
    ("optimal_coverage", _of("days_of_cover BETWEEN 30 AND 90"), "days_of_cover",
     "days_of_cover", True),
    ("most_critical_items", _of("risk_classification IN ('CRITICAL', 'OUT_OF_STOCK')"),
     "stock_health_score", "closing_stock", False),
    ("overstock_items", _of("risk_classification = 'OVERSTOCK'"), "days_of_cover",
     "days_of_cover", True),
    ("fast_movers", _of("avg_daily_issue > 5"), "avg_daily_issue", "avg_daily_issue", True),
]


_CHECK_ORDER = (
    "negative_stock", "balance_mismatch", "future_date", "duplicate_records", "missing_location_code",
    "missing_item_code", "date_gaps", "null_opening_stock", "null_receipts", "null_issues",
    "null_closing_stock", "large_opening_stock", "large_issues",
)


def _report(verdict: str) -> str:
    """The numbered lines of the report on a verdict."""
    found = f"""(SELECT *, row_number() OVER (PARTITION BY level
    ORDER BY list_position({list(_CHECK_ORDER)}, "check")) AS n FROM ({verdict}) WHERE findings > 0)"""
    issues = f"(SELECT count(*) FROM {found} WHERE level = 'ISSUE')"
    warnings = f"(SELECT count(*) FROM {found} WHERE level = 'WARNING')"
    return f"""
SELECT CAST(row_number() OVER (ORDER BY part, n) AS INTEGER) AS line_no, line FROM (
  SELECT 0 AS part, 0 AS n, 'DATA VALIDATION REPORT' AS line
  UNION ALL SELECT 1, 0, 'Validation ' || CASE WHEN {issues} > 0
    THEN 'FAILED - critical issues detected' ELSE 'PASSED - no critical issues found' END
  UNION ALL SELECT 2, 0, ''
  UNION ALL SELECT 3, 0, 'Critical issues:' || CASE WHEN {issues} > 0 THEN '' ELSE ' none' END
  UNION ALL SELECT CASE level WHEN 'ISSUE' THEN 3 ELSE 5 END, n,
    '  ' || n || '. ' || "check" || ': ' || findings FROM {found}
  UNION ALL SELECT 4, 0, ''
  UNION ALL SELECT 5, 0, 'Warnings:' || CASE WHEN {warnings} > 0 THEN '' ELSE ' none' END
  UNION ALL SELECT 6, 0, '')"""


def _oracle() -> dict[str, str]:
    scenario_rows = _rows(SCENARIOS)
    compared = ", ".join(_literal(name) for name in COMPARED_LOCATIONS)
    calendar_start = f"({AS_OF} - {CALENDAR_DAYS - 1})"
    categories = _rows([(code, parent) for code, _, parent, _, _ in CATEGORY_ROWS])
    sql = {}

    sql["latest_stock_position"] = "SELECT * FROM position"
    sql["consumption_metrics"] = "SELECT * FROM consumption"
    sql["consumption_by_codes"] = "SELECT * FROM consumption"
    sql["stock_health_metrics"] = "SELECT * FROM metrics"
    sql["stock_health_classification"] = "SELECT * FROM health"
    sql["movement_velocity"] = """
SELECT velocity, count(*) AS items,
  round(count(*) * 100.0 / (SELECT count(*) FROM health), 1) AS pct_of_total
FROM (SELECT CASE WHEN avg_daily_issue > 5 THEN 'Fast Mover'
    WHEN avg_daily_issue > 1 THEN 'Normal Mover' ELSE 'Slow Mover' END AS velocity FROM health)
GROUP BY velocity"""
    sql["health_bands"] = f"""
SELECT location_code, item_code, stock_health_score, risk_classification,
  {_band(SCORE_BANDS, LOWEST_BAND)} AS score_band,
  {_band(SUMMARY_BADGES, LOWEST_BADGE)} AS summary_badge,
  {_band(MONITORING_BANDS, LOWEST_MONITORING)} AS monitoring_band,
  CASE WHEN days_of_cover <= lead_time_days THEN 'RED'
    WHEN days_of_cover <= 1.5 * lead_time_days THEN 'YELLOW' ELSE 'GREEN' END AS traffic_light,
  {_lookup(HEX_COLORS, DEFAULT_HEX_COLOR)} AS hex_color,
  {_lookup(ICONS, DEFAULT_ICON)} || ' ' || risk_classification AS risk_label,
  {_title("risk_classification")} AS risk_title,
  {_title("item_category")} AS category_title
FROM health"""
    sql["capacity_overstock"] = """
SELECT location_code, item_code, closing_stock, max_stock_level,
  closing_stock - max_stock_level AS excess_stock
FROM health WHERE closing_stock > max_stock_level"""

    sql["reorder_recommendations"] = "SELECT * FROM recommendations"
    sql["reorder_queue"] = "SELECT * FROM queue"
    sql["queue_totals"] = """
SELECT round(sum(estimated_order_value), 4) AS total_reorder_value,
  count(*) AS items_to_reorder,
  round(avg(procurement_priority_score), 4) AS avg_priority_score FROM queue"""
    turnover = "orders / (SELECT count(DISTINCT item_code) FROM health) * 100"
    sql["cost_savings"] = f"""
SELECT round(total_reorder_value, 4) AS total_reorder_value, critical_orders,
  round(critical_value, 4) AS critical_value, orders,
  round(potential_savings, 4) AS potential_savings,
  round(stockout_prevention, 4) AS stockout_prevention, round(net_benefit, 4) AS net_benefit,
  (SELECT count(DISTINCT item_code) FROM health) AS total_items,
  round(roi_pct, 4) AS roi_pct,
  round(total_reorder_value / orders, 4) AS avg_order_value,
  round(total_reorder_value / 30, 4) AS avg_daily_investment,
  round({turnover}, 4) AS turnover_rate_pct,
  round(CASE WHEN {turnover} < 100 THEN 100 - {turnover} ELSE 0 END, 4) AS efficiency_score
FROM return_on_cost"""
    sql["cost_by_category"] = """
SELECT item_category, round(sum(estimated_order_value), 4) AS estimated_order_value
FROM queue GROUP BY item_category"""
    sql["cost_by_location"] = """
SELECT location_name, round(sum(estimated_order_value), 4) AS estimated_order_value
FROM queue GROUP BY location_name"""
    sql["cost_insights"] = f"""
SELECT 1 AS rule_no, {_literal(EXCELLENT_ROI)} AS insight
FROM return_on_cost WHERE roi_pct > 20
UNION ALL SELECT 2, {_literal(GOOD_ROI)}
FROM return_on_cost WHERE roi_pct > 10 AND roi_pct <= 20
UNION ALL SELECT 3, {_literal(POOR_ROI)} FROM return_on_cost WHERE roi_pct <= 10
UNION ALL SELECT 4, {_literal(HIGH_CRITICAL_SPEND)}
FROM return_on_cost WHERE critical_value > 0.3 * total_reorder_value
UNION ALL SELECT 5, {_text(TOP_CATEGORY)}
FROM (SELECT item_category FROM queue GROUP BY item_category
  ORDER BY sum(estimated_order_value) DESC, item_category LIMIT 1)"""
    sql["stock_projection"] = """
SELECT location_code, item_code, CAST(day AS INTEGER) AS day,
  greatest(0, closing_stock - avg_daily_issue * day) AS projected_stock,
  CASE WHEN avg_daily_issue > 0
    THEN CAST(trunc(closing_stock / avg_daily_issue) AS BIGINT) ELSE 999 END AS stockout_day
FROM health, range(0, 31) AS days(day)"""
    sql["scenario_summary"] = f"""
SELECT demand AS demand_change_pct, lead AS lead_time_change_pct, budget AS budget_pct,
  base AS base_critical, CAST(critical AS BIGINT) AS projected_critical,
  CAST(critical AS BIGINT) - base AS critical_change,
  CAST(trunc(critical * (1 + lead / 100)) AS BIGINT) AS potential_stockouts,
  CAST(trunc(critical * (1 + lead / 100)) AS BIGINT) - base AS stockout_change,
  round(budget / 100 * (SELECT total_reorder_value FROM queue_cost), 4) AS budget_required
FROM (SELECT *, trunc(base * (1 + demand / 100)) AS critical
  FROM (VALUES {scenario_rows}) AS cases(demand, lead, budget),
    (SELECT {_class_count("CRITICAL", "OUT_OF_STOCK")} AS base FROM health))"""
    sql["location_parameters"] = """
SELECT location_code, item_code,
  CAST(default_lead_time_days + CASE WHEN region IN ('North', 'Central') THEN 2 ELSE 0 END
    AS INTEGER) AS custom_lead_time_days,
  safety_stock * 1.5 AS custom_reorder_point, safety_stock AS custom_safety_stock,
  true AS is_stocked
FROM locations, items
WHERE is_active AND (location_type IN ('WAREHOUSE', 'NGO_CENTER')
  OR (location_type = 'HOSPITAL'
    AND (item_category LIKE 'MEDICINE%' OR item_category LIKE 'MEDICAL%')))
ORDER BY location_code, item_code LIMIT 50"""
    sql["demand_forecast"] = f"""
SELECT location_code, item_code, {AS_OF} + CAST(ahead AS INTEGER) AS forecast_date,
  round(mean, 6) AS forecast_daily_issue, round(mean * ahead, 6) AS forecast_cumulative_issue
FROM (SELECT location_code, item_code, avg(issues) AS mean
    FROM (SELECT * FROM daily WHERE record_date <= {AS_OF}
      QUALIFY row_number() OVER (PARTITION BY location_code, item_code
        ORDER BY record_date DESC) <= 14)
    GROUP BY location_code, item_code),
  range(1, 8) AS days(ahead)"""
    sql["transfer_suggestions"] = """
SELECT item_name, from_location, to_location, quantity, priority FROM (
  SELECT s.item_name, s.location_name AS from_location, t.location_name AS to_location,
    round_even(least(s.closing_stock * 0.3, t.avg_daily_issue * 14), 0) AS quantity,
    CASE WHEN t.risk_classification = 'OUT_OF_STOCK' THEN 'High' ELSE 'Medium' END AS priority,
    row_number() OVER (ORDER BY s.item_name, s.stock_health_score, s.location_name,
      t.stock_health_score, t.location_name) AS n
  FROM health s JOIN health t USING (item_name)
  WHERE s.risk_classification = 'OVERSTOCK'
    AND t.risk_classification IN ('CRITICAL', 'OUT_OF_STOCK')
    AND least(s.closing_stock * 0.3, t.avg_daily_issue * 14) > 0)
WHERE n <= 10"""

    sql["location_risk_summary"] = _LOCATION_SUMMARY
    sql["item_risk_summary"] = f"""
SELECT item_code, item_name, item_category, is_critical_item, count(*) AS total_locations,
  {_class_count("OUT_OF_STOCK")} AS out_of_stock_locations,
  {_class_count("CRITICAL", "HIGH_RISK")} AS at_risk_locations,
  {_class_count("HEALTHY")} AS healthy_locations,
  sum(closing_stock) AS total_stock_all_locations,
  round(sum(avg_daily_issue), 6) AS total_daily_consumption,
  round(avg(stock_health_score), 2) AS avg_stock_health_score,
  round(avg(days_of_cover), 2) AS avg_days_of_cover,
  round(sum({RISK_WEIGHT}) / count(*), 2) AS item_risk_score,
  max(latest_date) AS data_as_of_date
FROM health GROUP BY item_code, item_name, item_category, is_critical_item"""
    sql["executive_summary"] = f"""
SELECT * FROM ({_EXECUTIVE}),
  (SELECT count(*) AS total_reorder_recommendations,
    round(sum(estimated_order_value), 4) AS total_estimated_order_value FROM recommendations)"""
    sql["location_comparison"] = f"""
SELECT location_name, count(*) AS total_items, round(avg(stock_health_score), 6) AS avg_health,
  count(*) FILTER (WHERE requires_attention) AS at_risk,
  count(*) FILTER (WHERE is_critical_item) AS critical_items,
  round(avg(days_of_cover), 6) AS avg_days_cover
FROM health WHERE location_name IN ({compared}) GROUP BY location_name"""
    sql["risk_counts"] = """
SELECT risk_classification, count(*) AS items FROM health GROUP BY risk_classification"""
    sql["location_risk_counts"] = """
SELECT location_name, risk_classification, count(*) AS items
FROM health GROUP BY location_name, risk_classification"""
    class_columns = ", ".join(
        f"{_class_count(name)} AS {name.lower()}" for name in RISK_CLASSES
    )
    sql["location_risk_matrix"] = f"""
SELECT location_name, {class_columns} FROM health GROUP BY location_name"""
    sql["location_item_matrix"] = """
SELECT location_name, item_name, max(risk_color) AS risk_color FROM health
WHERE item_name IS NOT NULL GROUP BY 1, 2"""
    sql["category_performance"] = _performance(
        "item_category", "round(avg(stock_health_score), 6)"
    )
    sql["location_performance"] = _performance(
        "location_name", "round_even(avg(stock_health_score), 2)"
    )
    rounded = ", ".join(
        f"round_even({name}, 2) AS {name}"
        for name in ("closing_stock", "safety_stock", "reorder_point", "max_stock_level",
                     "avg_daily_issue", "total_issues_7d", "total_issues_14d",
                     "total_issues_30d", "days_of_cover", "stock_health_score")
    )
    sql["critical_items_report"] = f"""
SELECT * REPLACE ({rounded}) FROM health
WHERE risk_classification IN ('CRITICAL', 'OUT_OF_STOCK')"""
    sql["health_histogram"] = """
SELECT CAST(floor(stock_health_score / 5) * 5 AS BIGINT) AS score_from, count(*) AS items
FROM health GROUP BY 1"""
    sql["list_summary"] = """
SELECT count(*) AS items_displayed, round(avg(stock_health_score), 6) AS avg_health,
  count(*) FILTER (WHERE requires_attention) AS at_risk,
  count(*) FILTER (WHERE is_critical_item) AS critical FROM health"""
    sql["overall_performance"] = f"""
SELECT round({_class_count("HEALTHY")} / count(*) * 100, 6) AS healthy_pct,
  round({_class_count("CRITICAL", "OUT_OF_STOCK")} / count(*) * 100, 6) AS critical_pct,
  round(avg(days_of_cover), 6) AS avg_coverage_days,
  count(DISTINCT location_name) AS active_locations FROM health"""
    sql["filter_values"] = """
SELECT DISTINCT 'location' AS filter, location_name AS value FROM health
UNION ALL SELECT DISTINCT 'category', item_category FROM health
UNION ALL SELECT DISTINCT 'risk', risk_classification FROM health"""
    advice_sources = {
        "critical": f"SELECT {_class_count('CRITICAL', 'OUT_OF_STOCK')} / count(*) AS rate "
        "FROM health HAVING rate > 0.15",
        "overstock": f"SELECT {_class_count('OVERSTOCK')} / count(*) AS rate "
        "FROM health HAVING rate > 0.2",
        "slow": "SELECT count(*) AS n FROM health WHERE avg_daily_issue < 0.5 HAVING n > 10",
        "worst": f"SELECT * FROM (SELECT * FROM ({_MEANS}) ORDER BY stock_health_score, "
        "location_name LIMIT 1) WHERE stock_health_score < 60",
        "best": f"SELECT * FROM ({_MEANS}) ORDER BY stock_health_score DESC, location_name "
        "LIMIT 1",
    }
    sql["smart_recommendations"] = "\nUNION ALL\n".join(
        f"SELECT CAST({number} AS INTEGER) AS rule_no, {_text(priority)} AS priority, "
        f"{_text(action)} AS action, {_text(reason)} AS reason, {_text(impact)} AS impact "
        f"FROM ({advice_sources[rule]})"
        for number, (rule, (priority, action, reason, impact)) in enumerate(
            ADVICE.items(), 1
        )
    )
    share = "e.critical_items_at_risk / e.total_items"
    sql["summary_kpis"] = f"""
SELECT avg_stock_health_score,
  {_band(SUMMARY_BADGES, LOWEST_BADGE, "avg_stock_health_score")}
    AS health_badge,
  out_of_stock_count + critical_count + high_risk_count AS attention_count,
  round(least(pct_requiring_attention / 100, 1), 4) AS attention_progress,
  critical_items_at_risk, round({share} * 100, 4) AS critical_item_pct,
  round(least({share}, 1), 4) AS critical_progress,
  round(q.total_reorder_value, 4) AS reorder_value, q.orders AS reorder_count,
  round(least(avg_days_of_cover / 30, 1), 4) AS cover_progress
FROM ({_EXECUTIVE}) e, queue_cost q"""
    sql["parent_category_rollup"] = f"""
SELECT coalesce(parent, item_category) AS parent_category, count(*) AS total_items,
  round(avg(stock_health_score), 6) AS avg_health_score, sum(closing_stock) AS total_stock,
  count(*) FILTER (WHERE requires_attention) AS items_at_risk,
  {_class_count("CRITICAL", "OUT_OF_STOCK")} AS critical_items
FROM health LEFT JOIN (VALUES {categories}) AS c(code, parent) ON code = item_category
GROUP BY 1"""
    sql["location_ranking"] = f"""
SELECT rank() OVER (ORDER BY location_risk_score DESC) AS risk_rank, location_code,
  location_name, location_risk_score, location_risk_classification
FROM ({_LOCATION_SUMMARY})"""

    sql["stock_ledger"] = """
SELECT record_date, location_code, item_code, opening_stock, receipts, issues, closing_stock
FROM daily"""
    sql["dense_calendar"] = f"""
SELECT p.location_code, p.item_code, c.record_date, coalesce(d.receipts, 0) AS receipts,
  coalesce(d.issues, 0) AS issues, d.issues IS NOT NULL AS has_record,
  CAST(c.record_date - {calendar_start} + 1 AS INTEGER) AS day_num
FROM (SELECT DISTINCT location_code, item_code FROM daily) p
CROSS JOIN (SELECT {calendar_start} + CAST(n AS INTEGER) AS record_date
  FROM range(0, {CALENDAR_DAYS}) AS days(n)) c
LEFT JOIN daily d ON d.location_code = p.location_code AND d.item_code = p.item_code
  AND d.record_date = c.record_date"""
    sql["corrected_records"] = "SELECT * FROM corrected"

    sql["health_list"] = "SELECT * FROM listed"
    sql["bottom_list"] = """
SELECT * FROM listed ORDER BY days_until_stockout DESC, stock_health_score DESC,
  location_name DESC, item_name DESC LIMIT 50"""
    sql["text_search"] = f"""
SELECT * FROM listed
WHERE contains(lower(concat_ws(' ', location_name, item_name, item_category,
  risk_classification)), lower('{SEARCH_TEXT}'))"""
    sql["advanced_search"] = """
SELECT * FROM listed
WHERE current_stock BETWEEN 50 AND 900 AND stock_health_score >= 40
  AND (lower(item_name) LIKE 'item 1%' OR lower(location_name) LIKE 'item 1%')
  AND risk_classification <> 'HEALTHY'"""
    sql["low_stock_today"] = f"""
SELECT location_name, item_name, closing_stock, record_date FROM daily
WHERE record_date = {AS_OF} AND closing_stock < 100
ORDER BY closing_stock, location_code, item_code LIMIT 20"""
    sql["recent_records"] = f"""
SELECT location_name, item_name, record_date, closing_stock, issues FROM daily
WHERE record_date >= {AS_OF} - 7
ORDER BY location_code, item_code, record_date DESC LIMIT 50"""
    sql["top_bottom_performers"] = "\nUNION ALL\n".join(
        f"SELECT * FROM ({_top(*top)})" for top in _TOPS
    )

    sql["stock_alerts"] = "SELECT * EXCLUDE (stock_health_score, days_of_cover) FROM alerts"
    sql["stream_alerts"] = f"""
SELECT * EXCLUDE (alert_id, stock_health_score, days_of_cover), {AS_OF} AS alert_date
FROM alerts"""
    sql["active_alerts"] = "SELECT * FROM active"
    sql["unacknowledged_alerts"] = """
SELECT * FROM active WHERE NOT coalesce(is_critical_item, false)"""
    sql["alert_counts"] = """
SELECT count(*) FILTER (WHERE NOT coalesce(is_critical_item, false)) AS total_alerts,
  count(*) FILTER (WHERE NOT coalesce(is_critical_item, false)
    AND severity IN ('OUT_OF_STOCK', 'CRITICAL')) AS critical_alerts,
  count(*) FILTER (WHERE is_critical_item) AS acknowledged_alerts
FROM active"""
    left = "CASE WHEN closing_stock <= 0 THEN 0 ELSE days_until_stockout END"
    sql["configured_alerts"] = f"""
SELECT alert_name, alert_type, c.severity, location_code, item_code, location_name, item_name,
  item_category, closing_stock AS current_stock,
  CASE WHEN alert_type = 'OVERSTOCK' THEN CAST(days_since_last_movement AS BIGINT)
    ELSE {left} END AS measured_days,
  threshold_days
FROM health
JOIN (VALUES {_rows(ALERT_ROWS)}) AS c(alert_name, alert_type, threshold_days, severity)
  ON CASE WHEN alert_type = 'OVERSTOCK' THEN days_since_last_movement > threshold_days
    ELSE alert_type <> 'EXPIRY_WARNING' AND {left} <= threshold_days END"""
    sql["custom_item_alerts"] = f"""
SELECT * FROM (
  SELECT location_code, item_code, location_name, item_name, days_until_stockout,
    coalesce(own, 7) AS threshold_days, risk_classification
  FROM health LEFT JOIN (VALUES {_rows(CUSTOM_THRESHOLDS)}) AS t(item_name, own)
    USING (item_name))
WHERE days_until_stockout <= threshold_days"""
    sql["alert_history"] = f"""
SELECT {AS_OF} AS alert_date, location_code, item_code, alert_type, severity,
  stock_health_score, days_of_cover FROM alerts"""

    nulls = "\n".join(
        f"UNION ALL SELECT 'null_{name}', 'WARNING', count(*) FILTER (WHERE {name} IS NULL)"
        " FROM daily"
        for name in ("opening_stock", "receipts", "issues", "closing_stock")
    )
    sql["quality_verdict"] = f"""
SELECT 'negative_stock' AS "check", 'ISSUE' AS level,
  count(*) FILTER (WHERE closing_stock < 0) AS findings FROM daily
UNION ALL SELECT 'balance_mismatch', 'ISSUE', count(*) FILTER (WHERE difference > 0.01)
FROM checked
UNION ALL SELECT 'future_date', 'ISSUE', count(*) FILTER (WHERE record_date > {AS_OF})
FROM daily
UNION ALL SELECT 'duplicate_records', 'ISSUE', coalesce(CAST(sum(n) AS BIGINT), 0)
FROM (SELECT count(*) AS n FROM daily GROUP BY record_date, location_code, item_code
  HAVING count(*) > 1)
UNION ALL SELECT 'missing_location_code', 'WARNING',
  count(*) FILTER (WHERE location_code IS NULL OR location_code = '') FROM daily
UNION ALL SELECT 'missing_item_code', 'WARNING',
  count(*) FILTER (WHERE item_code IS NULL OR item_code = '') FROM daily
UNION ALL SELECT 'date_gaps', 'WARNING', count(*) FROM gaps
{nulls}
UNION ALL SELECT 'large_opening_stock', 'WARNING',
  CASE WHEN max(opening_stock) > 1000000 THEN 1 ELSE 0 END FROM daily
UNION ALL SELECT 'large_issues', 'WARNING',
  CASE WHEN max(issues) > 10000 THEN 1 ELSE 0 END FROM daily"""
    sql["date_gaps"] = "SELECT * FROM gaps"
    sql["duplicate_records"] = """
SELECT record_date, 'LOC' || lpad(CAST(nation AS VARCHAR), 3, '0') AS location_code,
  'Brand#' || CAST(brand AS VARCHAR) AS item_code, count(*) AS copies
FROM shipments GROUP BY record_date, nation, brand HAVING count(*) > 1"""
    sql["data_profile"] = """
SELECT count(*) AS total_records, count(DISTINCT location_code) AS unique_locations,
  count(DISTINCT item_code) AS unique_items, min(record_date) AS date_range_start,
  max(record_date) AS date_range_end, max(record_date) - min(record_date) AS days_covered,
  count(*) FILTER (WHERE opening_stock IS NULL) AS null_opening_stock,
  count(*) FILTER (WHERE receipts IS NULL) AS null_receipts,
  count(*) FILTER (WHERE issues IS NULL) AS null_issues,
  count(*) FILTER (WHERE closing_stock IS NULL) AS null_closing_stock,
  max(opening_stock) AS largest_opening_stock, max(issues) AS largest_issues,
  max(difference) FILTER (WHERE difference > 0.01) AS max_balance_difference
FROM checked"""
    sql["master_checks"] = """
SELECT 'duplicate_locations' AS "check", 'ISSUE' AS level,
  (SELECT coalesce(CAST(sum(n) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM locations
    GROUP BY location_code HAVING count(*) > 1)) AS findings
UNION ALL SELECT 'missing_location_names', 'WARNING', count(*) FROM locations
WHERE location_name IS NULL
UNION ALL SELECT 'duplicate_items', 'ISSUE', (SELECT coalesce(CAST(sum(n) AS BIGINT), 0)
  FROM (SELECT count(*) AS n FROM items GROUP BY item_code HAVING count(*) > 1))
UNION ALL SELECT 'missing_item_names', 'WARNING', count(*) FROM items WHERE item_name IS NULL
UNION ALL SELECT 'unusual_lead_times', 'WARNING', count(*) FROM items
WHERE default_lead_time_days NOT BETWEEN 1 AND 90
UNION ALL SELECT 'location_count', 'METRIC', count(*) FROM locations
UNION ALL SELECT 'item_count', 'METRIC', count(*) FROM items"""
    sql["rule_violations"] = f"""
SELECT 'Negative Closing Stock' AS rule_name, 'NEGATIVE_STOCK' AS rule_type,
  'HIGH' AS severity, count(*) AS violations FROM daily WHERE closing_stock < 0
UNION ALL SELECT 'Missing Location Name', 'MISSING_DATA', 'MEDIUM', count(*) FROM daily
WHERE coalesce(location_name, '') = ''
UNION ALL SELECT 'Missing Item Name', 'MISSING_DATA', 'MEDIUM', count(*) FROM daily
WHERE coalesce(item_name, '') = ''
UNION ALL SELECT 'Stock Mismatch', 'ANOMALY', 'HIGH', count(*) FROM checked WHERE difference > 0
UNION ALL SELECT 'Future Date', 'ANOMALY', 'CRITICAL', count(*) FROM daily
WHERE record_date > {AS_OF}"""
    sql["table_summary"] = """
SELECT 'Daily Stock Records' AS data_type, count(*) AS record_count,
  min(record_date) AS earliest_date, max(record_date) AS latest_date FROM daily
UNION ALL SELECT 'Locations', count(*), NULL, NULL FROM locations
UNION ALL SELECT 'Items', count(*), NULL, NULL FROM items"""

    sql["csv_round_trip"] = """
SELECT record_date, location_code, location_name, item_code, item_name, opening_stock,
  receipts, issues, closing_stock, unit_of_measure FROM daily"""
    sql["archived_records"] = f"""
SELECT record_date, location_code, item_code, issues, closing_stock FROM daily
WHERE record_date < {AS_OF} - {RETENTION_DAYS}"""
    sql["procurement_actions"] = f"""
SELECT {AS_OF} AS action_date, location_code, item_code, 'REORDER_CREATED' AS action_type,
  suggested_reorder_quantity AS recommended_quantity, supplier_code,
  recommended_action_date + lead_time_days AS expected_delivery_date, 'PENDING' AS status
FROM recommendations"""
    columns = "record_date, location_code, item_code, receipts, issues, closing_stock"
    sql["change_captured"] = f"""
SELECT {columns}, CASE WHEN both_sides THEN 'UPDATE' ELSE action END AS change_type, action,
  CAST(1 AS BIGINT) AS copies
FROM (SELECT *, count(DISTINCT action) OVER (PARTITION BY record_date, location_code,
    item_code) > 1 AS both_sides
  FROM (
    (SELECT {columns}, 'DELETE' AS action FROM daily WHERE record_date < {AS_OF} - 7
     EXCEPT SELECT {columns}, 'DELETE' FROM corrected
       WHERE record_date >= {AS_OF} - {RETENTION_DAYS})
    UNION ALL
    (SELECT {columns}, 'INSERT' FROM corrected
       WHERE record_date >= {AS_OF} - {RETENTION_DAYS}
     EXCEPT SELECT {columns}, 'INSERT' FROM daily WHERE record_date < {AS_OF} - 7)))"""
    sql["stream_refresh"] = "SELECT * FROM health"
    sql["stream_changes"] = "SELECT *, CAST(1 AS BIGINT) AS copies FROM health"
    sql["refreshed_consumption"] = sql["consumption_metrics"]
    sql["published_rollup"] = sql["location_risk_summary"]
    sql["stream_consumption"] = """
SELECT day - CAST(back AS INTEGER) AS window_start, day - CAST(back AS INTEGER) + 7 AS window_end,
  location_code, item_code, round(sum(issues), 4) AS issues,
  CAST(sum(movements) AS BIGINT) AS movements
FROM (SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS location_code,
    event_type AS item_code, sum(value) AS issues, count(*) AS movements
  FROM events GROUP BY 1, 2, 3), range(0, 7) AS days(back)
GROUP BY 1, 2, 3, 4"""
    sql["stream_late_rows"] = sql["stream_consumption"]
    sql["stored_alerts"] = sql["stock_alerts"]
    sql["bucketed_health"] = "SELECT * FROM health"
    sql["json_round_trip"] = sql["folder_round_trip"] = sql["csv_round_trip"]
    sql["json_array_round_trip"] = sql["csv_round_trip"]
    sql["defaults_on_load"] = """
SELECT record_date, location_code, location_name, item_code, item_name, opening_stock, receipts,
  issues, CAST(0 AS DOUBLE) AS closing_stock, 'UNITS' AS unit_of_measure, 7 AS lead_time_days
FROM daily"""
    sql["footer_summary"] = """
SELECT count(*) AS record_count, min(record_date) AS earliest_date, max(record_date) AS latest_date
FROM daily"""
    sql["archived_partitions"] = f"""
SELECT CASE WHEN record_date < {AS_OF} - {RETENTION_DAYS} THEN 'archived' ELSE 'kept' END AS part,
  count(*) AS records, sum(issues) AS issues, min(record_date) AS first_date,
  max(record_date) AS last_date
FROM daily GROUP BY 1"""
    sql["missing_columns_verdict"] = """
SELECT 'missing_required_columns' AS "check", 'ISSUE' AS level, CAST(2 AS BIGINT) AS findings"""
    sql["low_stock_wide"] = sql["low_stock_today"].replace("< 100", "< 1000")
    sql["filtered_health_list"] = f"""
SELECT * FROM listed WHERE location_name = 'NATION_9' AND risk_classification = 'HEALTHY'
  AND item_category = 'MEDICINE_ANTIBIOTIC'"""
    sql["text_numbers"] = """
SELECT p_partkey, coalesce(try_cast(p_brand AS DOUBLE), 0) AS of_brand,
  coalesce(try_cast(substr(p_brand, 7) AS DOUBLE), 0) AS of_number FROM part"""
    sql["archive_written"] = f"""
SELECT 'archived' AS part, count(*) AS records FROM daily WHERE record_date < {AS_OF} - 365
UNION ALL SELECT 'kept', count(*) FROM daily WHERE record_date >= {AS_OF} - 365"""
    sql["audit_log"] = """
SELECT 'STATUS' AS event_type, 'class' AS event_description, 'job' AS user_name,
  location_code, item_code, '{"item_name":"' || item_name || '"}' AS old_value,
  '{"risk_classification":"' || risk_classification || '"}' AS new_value
FROM health WHERE requires_attention"""
    sql["acknowledged_alerts"] = "SELECT alert_id FROM active WHERE is_critical_item"
    sql["action_status"] = """
SELECT 'L' || CAST(l_suppkey % 10 AS VARCHAR) AS location_code,
  'I' || CAST(l_partkey % 20 AS VARCHAR) AS item_code,
  CASE WHEN l_orderkey % 3 > 0 THEN 'PO' || CAST(l_orderkey % 50 AS VARCHAR) END
    AS order_reference,
  CAST(l_shipdate AS DATE) AS action_date, l_orderkey * 8 + l_linenumber AS action_id,
  l_linestatus AS status
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY 1, 2, 3
  ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey * 8 + l_linenumber DESC) = 1"""
    sql["action_status"] = sql["action_status"].replace(
        "PARTITION BY 1, 2, 3", "PARTITION BY l_suppkey % 10, l_partkey % 20, order_reference"
    )
    sql["latest_of_tied_records"] = """
SELECT 'LOC' || lpad(CAST(nation AS VARCHAR), 3, '0') AS location_code,
  'Brand#' || CAST(brand AS VARCHAR) AS item_code, record_date AS latest_date,
  max(issues) AS closing_stock
FROM shipments
WHERE (nation, brand, record_date) IN
  (SELECT (nation, brand, max(record_date)) FROM shipments GROUP BY nation, brand)
GROUP BY 1, 2, 3"""
    messy = {
        f"messy_{name}": _messy(sql[name])
        for name in ("quality_verdict", "data_profile", "rule_violations", "master_checks")
    }
    messy["messy_validation_report"] = _messy(_report(sql["quality_verdict"]))
    messy["messy_duplicate_rows"] = _messy("""
SELECT record_date, location_code, item_code, closing_stock FROM daily
QUALIFY count(*) OVER (PARTITION BY record_date, location_code, item_code) > 1""")
    messy["messy_verdict_flag"] = _messy("SELECT false AS is_valid")
    return {name: PRELUDE + text for name, text in sql.items()} | messy


_MESSY_DAILY = """), daily AS (
  SELECT record_date,
    CASE WHEN k % 67 = 8 THEN NULL WHEN k % 61 = 9 THEN '' ELSE location_code END
      AS location_code,
    CASE WHEN k % 47 <> 12 THEN location_name END AS location_name,
    CASE WHEN k % 59 = 10 THEN NULL WHEN k % 53 = 11 THEN '' ELSE item_code END AS item_code,
    CASE WHEN k % 43 = 13 THEN '' ELSE item_name END AS item_name,
    item_category,
    CASE WHEN k % 79 = 3 THEN NULL WHEN k % 101 = 4 THEN 2000000 ELSE opening_stock END
      AS opening_stock,
    CASE WHEN k % 73 <> 5 THEN receipts END AS receipts,
    CASE WHEN k % 71 = 6 THEN NULL WHEN k % 103 = 7 THEN 20000 ELSE issues END AS issues,
    CASE WHEN k % 97 = 0 THEN -5 WHEN k % 89 = 1 THEN closing_stock + 1
      WHEN k % 83 = 2 THEN NULL ELSE closing_stock END AS closing_stock,
    unit_of_measure, lead_time_days
  FROM (SELECT *, record_date - DATE '1970-01-01' + 5 * CAST(substr(location_code, 4) AS INTEGER)
      + 3 * CAST(substr(item_code, 7) AS INTEGER) AS k FROM clean),
    LATERAL (SELECT unnest(range(CASE WHEN k % 41 = 14 THEN 2 ELSE 1 END)) AS copy)
), brands AS ("""
_MESSY_MASTERS = """), items AS (
  SELECT * REPLACE (CASE WHEN brand % 6 <> 0 THEN item_name END AS item_name,
    CASE WHEN brand % 8 = 1 THEN 0 WHEN brand % 8 = 2 THEN 91 ELSE default_lead_time_days END
      AS default_lead_time_days,
    CASE WHEN brand % 9 = 1 THEN 'Brand#1' ELSE item_code END AS item_code)
  FROM clean_items
), locations AS (
  SELECT * REPLACE (CASE WHEN nation % 5 <> 0 THEN location_name END AS location_name,
    CASE WHEN nation % 7 = 1 THEN 'LOC001' ELSE location_code END AS location_code)
  FROM clean_locations
), params AS ("""


def _messy(text: str) -> str:
    """A query over the flawed records and masters, as of ten days before the last record."""
    prelude = PRELUDE.replace("), daily AS (", "), clean AS (")
    prelude = prelude.replace("), brands AS (", _MESSY_DAILY)
    prelude = prelude.replace("), items AS (", "), clean_items AS (")
    prelude = prelude.replace("), locations AS (", "), clean_locations AS (")
    prelude = prelude.replace("), params AS (", _MESSY_MASTERS)
    return prelude + text.replace(f"record_date > {AS_OF}", f"record_date > {AS_OF} - 10")


def oracle_queries() -> dict[str, str]:
    return _oracle()
