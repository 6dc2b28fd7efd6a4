"""Names and values that every module shares.

The blocks marked "fixed values" are part of the data contract: results are
only right when they hold exactly these values.
"""

# The SKU key and the windowed aggregate's metrics.
SKU = ("store_id", "product_id")
WINDOW = ("window_start", "window_end")
METRICS = (
    "total_units_sold",
    "total_revenue",
    "avg_units_per_minute",
    "transaction_count",
)
FEATURES = METRICS
LABEL = "total_units_sold"

# Risk tiers, actions and statuses.
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
AT_RISK = ("HIGH", "CRITICAL")
ACTIONS = ("REORDER", "MONITOR", "NO_ACTION")
IDLE, RUNNING, SUCCESS, FAILED = ("idle", "running", "success", "failed")
ALL = "ALL"

# Product-number range -> category, and the highest base price of each.
CATEGORY_RANGES = (
    (1, 10, "Rice"),
    (11, 20, "Snacks"),
    (21, 30, "Beverages"),
    (31, 40, "Dairy"),
    (41, 50, "Personal Care"),
)
OTHER_CATEGORY = "General"
PRICE_CEILINGS = {
    "Rice": 120.0,
    "Snacks": 60.0,
    "Beverages": 80.0,
    "Dairy": 90.0,
    "Personal Care": 150.0,
}
OTHER_PRICE_CEILING = 100.0
ANOMALY_PRICE_FACTOR = 2.0
ANOMALY_QUANTITY = 10

# Reorder list and demand rows.
SELLER_NAME_UNMAPPED = "Seller Not Mapped"
SELLER_CONTACT_UNMAPPED = "NA"
DRAFT_ORDER = "CREATE_DRAFT_PO"
REORDER_PENDING = "pending"
CONFIDENCE = 0.85
NEW_SKU_LEAD_TIME = 3

# Report sizes and bounds.
TOP_AT_RISK = 5
TOP_STORES = 5
TOP_PRODUCTS = 10
TOP_MOVERS = 10
DEMAND_ROWS = 200
DEMAND_ROWS_MAX = 2000
PAGE_SIZE = 20
TREND_DAYS = (3, 30)

# Trend scaffold day factor, KPI price, run log.
TREND_BASE = 0.88
TREND_STEP = 0.02
KPI_UNIT_PRICE = 42.0
MODEL_NAME = "demand_rf_model"
MODEL_CURRENT = "demand_rf_model_current"
