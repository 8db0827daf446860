"""Column registries, segment domains, thresholds and store schemas.

Everything a result depends on is declared here once, so the operators and
the SQL oracles read the same constants.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference workflow's for equal results.
# ---------------------------------------------------------------------------
AGE_BUCKETS = ["18-24", "25-34", "35-44", "45-54", "55+"]
TRAFFIC_SOURCES = ["Email", "Facebook", "Adwords", "Organic", "YouTube"]
RISK_TIERS = ["High", "Medium", "Low"]
HIGH_THRESHOLD = 0.70
MEDIUM_THRESHOLD = 0.40
CHURN_WINDOW_DAYS = 90
BUYER_MIN_ORDERS = 1
CAP_QUANTILE = 0.99
CAP_COLUMNS = ["total_revenue", "total_events", "approx_sessions", "customer_tenure_days"]
NUMERIC_BASE_COLUMNS = [
    "total_orders", "total_revenue", "avg_order_value", "revenue_per_order",
    "customer_tenure_days", "orders_per_month", "return_rate",
    "returned_orders", "cancelled_orders", "distinct_categories",
    "total_events", "cart_events", "purchase_events", "approx_sessions",
    "cart_to_purchase_ratio", "revenue_per_session",
]
LEAKAGE_COLUMNS = [
    "days_since_last_order", "rfm_recency_score", "rfm_total",
    "purchase_events", "total_events", "approx_sessions",
    "revenue_per_session", "cart_to_purchase_ratio",
]
META_COLUMNS = ["user_id", "city", "state", "top_category", "is_us_customer", "churned"]
EDA_ONLY_COLUMNS = ["rev_per_day_bucket"]
LEAK_CORRELATION_THRESHOLD = 0.6
LEAK_TOP_N = 10
EDA_CORR_TOP_N = 8
STATE_MIN_CUSTOMERS = 30
STATE_TOP_N = 15
HIST_ORDERS_MONTH_CLIP, HIST_ORDERS_MONTH_BINS = 5.0, 30
HIST_REVENUE_CLIP, HIST_REVENUE_BINS = 1500.0, 40
HIGH_RETURN_RATE = 0.5
TOP_SEGMENTS_LIMIT = 20
TOP_AT_RISK_LIMIT = 5
RECENT_TURNS = 6
SPLIT_TEST_SHARE = 0.2
RANDOM_SEED = 42
TOP_IMPORTANCES = 15
TOP_DRIVERS = 3
CLASS_COMPARE_COLUMNS = [
    "total_orders", "orders_per_month", "total_revenue",
    "customer_tenure_days", "return_rate", "distinct_categories",
]
CORR_MATRIX_COLUMNS = [
    "total_orders", "total_revenue", "orders_per_month",
    "customer_tenure_days", "return_rate", "avg_order_value",
    "cart_events", "cancelled_orders", "distinct_categories", "churned",
]
LEAKAGE_REASONS = [
    ("days_since_last_order", "churn label is defined from it"),
    ("rfm_recency_score", "quintile of days_since_last_order"),
    ("rfm_total", "contains rfm_recency_score"),
    ("purchase_events", "event activity measured after the label window"),
    ("total_events", "event activity measured after the label window"),
    ("approx_sessions", "event activity measured after the label window"),
    ("revenue_per_session", "built from session counts"),
    ("cart_to_purchase_ratio", "built from purchase events"),
]
# Question parsing: source words, comparison words, age patterns, customer words.
SOURCE_PATTERNS = [
    ("email", "Email"), ("facebook", "Facebook"), ("adwords", "Adwords"),
    ("organic", "Organic"), ("youtube", "YouTube"),
]
COMPARISON_PATTERN = "compar|vs|versus"
AGE_PATTERNS = [
    ("18.?24", "18-24"), ("25.?34", "25-34"), ("35.?44", "35-44"),
    ("45.?54", "45-54"), ("55\\+", "55+"),
]
CUSTOMER_PATTERN = "customer|user|who|top"
SEGMENT_LINE_HEADER = (
    "Risk Tier | Age | Gender | Source | Count | Avg Churn Prob | Revenue at Risk"
    " | Avg Orders/Mo | Return Rate | One-Time Buyers"
)
SEGMENT_LINE_DIVIDER_WIDTH = 120
# Store precisions: NUMERIC(p, s) of the served tables.
CUSTOMER_DECIMALS = {
    "total_revenue": (10, 2), "avg_order_value": (10, 2),
    "orders_per_month": (8, 3), "return_rate": (5, 3),
}
SCORE_DECIMALS = {"churn_probability": (6, 4)}

# ---------------------------------------------------------------------------
# Decisions for the test data (the reference's feature SQL is not published).
# ---------------------------------------------------------------------------
# customer market segment -> acquisition channel
SEGMENT_TO_SOURCE = [
    ("AUTOMOBILE", "Adwords"), ("BUILDING", "Email"), ("FURNITURE", "Facebook"),
    ("HOUSEHOLD", "Organic"), ("MACHINERY", "YouTube"),
]
US_REGION = "AMERICA"
STATUS_COMPLETE, STATUS_CANCELLED = "F", "P"
RETURN_FLAG = "R"
CART_EVENT, PURCHASE_EVENT = "click", "purchase"
AGE_BASE, AGE_SPAN = 18, 50
# Deterministic score used where a trained model would make results
# engine-dependent: 1 / (1 + exp(-(b0 + b1*opm + b2*one_time + b3*monetary + b4*return_rate)))
BASE_SCORE_COEF = {
    "intercept": 2.0, "orders_per_month": -35.0, "one_time_buyer": 0.5,
    "rfm_monetary_score": -0.1, "return_rate": 1.0,
}
BASE_TOP_FEATURES = ["rfm_frequency_score", "orders_per_month", "revenue_per_day"]

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
FEATURE_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("age_bucket", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("traffic_source", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("top_category", T.StringType()),
    T.StructField("is_us_customer", T.BooleanType()),
    T.StructField("total_orders", T.LongType()),
    T.StructField("total_revenue", T.DecimalType(18, 2)),
    T.StructField("avg_order_value", T.DoubleType()),
    T.StructField("revenue_per_order", T.DoubleType()),
    T.StructField("customer_tenure_days", T.DoubleType()),
    T.StructField("orders_per_month", T.DoubleType()),
    T.StructField("return_rate", T.DoubleType()),
    T.StructField("returned_orders", T.LongType()),
    T.StructField("cancelled_orders", T.LongType()),
    T.StructField("distinct_categories", T.LongType()),
    T.StructField("total_events", T.LongType()),
    T.StructField("cart_events", T.LongType()),
    T.StructField("purchase_events", T.LongType()),
    T.StructField("approx_sessions", T.LongType()),
    T.StructField("cart_to_purchase_ratio", T.DoubleType()),
    T.StructField("revenue_per_session", T.DoubleType()),
    T.StructField("days_since_last_order", T.IntegerType()),
    T.StructField("churned", T.IntegerType()),
])

PREDICTION_COLUMNS = [
    "user_id", "churn_probability", "risk_tier", "actual_churned", "total_orders",
    "total_revenue", "orders_per_month", "customer_tenure_days", "return_rate",
    "one_time_buyer", "rfm_frequency_score", "rfm_monetary_score", "age_bucket",
    "gender", "traffic_source", "top_feature_1", "top_feature_2", "top_feature_3",
]

PREDICTION_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("churn_probability", T.DoubleType()),
    T.StructField("risk_tier", T.StringType()),
    T.StructField("actual_churned", T.IntegerType()),
    T.StructField("total_orders", T.LongType()),
    T.StructField("total_revenue", T.DoubleType()),
    T.StructField("orders_per_month", T.DoubleType()),
    T.StructField("customer_tenure_days", T.DoubleType()),
    T.StructField("return_rate", T.DoubleType()),
    T.StructField("one_time_buyer", T.IntegerType()),
    T.StructField("rfm_frequency_score", T.IntegerType()),
    T.StructField("rfm_monetary_score", T.IntegerType()),
    T.StructField("age_bucket", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("traffic_source", T.StringType()),
    T.StructField("top_feature_1", T.StringType()),
    T.StructField("top_feature_2", T.StringType()),
    T.StructField("top_feature_3", T.StringType()),
])

CUSTOMERS_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("age_bucket", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("traffic_source", T.StringType()),
    T.StructField("total_orders", T.IntegerType()),
    T.StructField("total_revenue", T.DecimalType(10, 2)),
    T.StructField("avg_order_value", T.DecimalType(10, 2)),
    T.StructField("orders_per_month", T.DecimalType(8, 3)),
    T.StructField("customer_tenure_days", T.IntegerType()),
    T.StructField("return_rate", T.DecimalType(5, 3)),
    T.StructField("one_time_buyer", T.BooleanType()),
    T.StructField("rfm_frequency_score", T.ShortType()),
    T.StructField("rfm_monetary_score", T.ShortType()),
    T.StructField("created_at", T.TimestampType()),
])

RISK_SCORES_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("churn_probability", T.DecimalType(6, 4)),
    T.StructField("risk_tier", T.StringType()),
    T.StructField("actual_churned", T.BooleanType()),
    T.StructField("top_feature_1", T.StringType()),
    T.StructField("top_feature_2", T.StringType()),
    T.StructField("top_feature_3", T.StringType()),
    T.StructField("scored_at", T.TimestampType()),
])

CUSTOMER_PAYLOAD = [f.name for f in CUSTOMERS_SCHEMA.fields if f.name != "created_at"]
SCORE_PAYLOAD = [f.name for f in RISK_SCORES_SCHEMA.fields if f.name not in ("id", "scored_at")]


def model_feature_columns(columns: list[str]) -> list[str]:
    """Every column that is neither leaky, meta nor EDA-only, in input order."""
    drop = set(LEAKAGE_COLUMNS) | set(META_COLUMNS) | set(EDA_ONLY_COLUMNS)
    return [c for c in columns if c not in drop]
