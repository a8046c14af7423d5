"""Fixed values that must equal the reference application's for equal
results: column vocabulary, defaults, synonym lists, segment names, the
segment profile and persona tables, and thresholds.

FIXED VALUES — keep in this natural order; do not edit to tune results.
"""

from __future__ import annotations

# ---- FIXED VALUES: standard column vocabulary --------------------------------
REQUIRED_COLUMNS = [
    "customer_id",
    "last_purchase_date",
    "total_orders",
    "total_spend",
    "days_since_last_purchase",
]

OPTIONAL_COLUMNS = [
    "age",
    "gender",
    "country",
    "city",
    "satisfaction_score",
    "churn_flag",
    "avg_order_value",
    "channel",
    "loyalty_points",
    "support_tickets_raised",
    "referral_count",
]

STANDARD_COLUMNS = REQUIRED_COLUMNS + OPTIONAL_COLUMNS

# ---- FIXED VALUES: defaults for absent optional columns ----------------------
DEFAULT_VALUES = {
    "age": 35,
    "gender": "Unknown",
    "country": "Unknown",
    "city": "Unknown",
    "satisfaction_score": 7.0,
    "churn_flag": 0,
    "avg_order_value": 0.0,
    "channel": "web",
    "loyalty_points": 0,
    "support_tickets_raised": 0,
    "referral_count": 0,
}

# ---- FIXED VALUES: column-name synonyms (dict order is the tie-break order) ---
SYNONYMS = {
    "last_purchase_date": [
        "lastpurchase", "lastorder", "purchase_date", "orderdate", "last_order_date",
        "last_purchase", "last_order", "purchase", "date",
    ],
    "total_orders": ["totalorders", "ordercount", "numorders", "orders", "purchases", "transactions"],
    "total_spend": ["totalspend", "totalsales", "revenue", "amount", "total", "spend", "sales"],
    "customer_id": ["customerid", "custid", "userid", "clientid", "customer", "user", "id"],
    "days_since_last_purchase": [
        "dayssincelastpurchase", "dayssincepurchase", "dayssince", "recency", "dayslastpurchase",
    ],
    "avg_order_value": ["avgordervalue", "averageordervalue", "aov", "avgspend"],
    "satisfaction_score": ["satisfactionscore", "satisfaction", "csat", "rating", "score"],
    "churn_flag": ["churnflag", "churn", "churned", "attrition"],
    "loyalty_points": ["loyaltypoints", "rewardpoints", "points"],
    "support_tickets_raised": ["supporttickets", "tickets", "cases"],
    "channel": ["channel", "platform", "source"],
    "country": ["country", "nation"],
    "city": ["city", "town"],
    "gender": ["gender", "sex"],
    "age": ["age", "years"],
}

SKIP_OPTION = "Skip"

# ---- FIXED VALUES: validation thresholds --------------------------------------
DATE_ISSUE_SHARE = 0.4
INT_ISSUE_COLUMNS = ["total_orders", "days_since_last_purchase", "age", "loyalty_points", "support_tickets_raised"]
INT_ISSUE_SHARE = 0.4
CURRENCY_COLUMNS = ["total_spend", "avg_order_value"]
CURRENCY_ISSUE_SHARE = 0.4
SCORE_ISSUE_COLUMNS = ["churn_flag", "satisfaction_score"]
SCORE_ISSUE_SHARE = 0.6
DAYFIRST_RETRY_SHARE = 0.3
MIN_ROWS = 3

# columns coerced with to-numeric semantics during enrichment (in this order)
NUMERIC_COERCE_COLUMNS = [
    "age", "satisfaction_score", "loyalty_points", "support_tickets_raised", "churn_flag", "referral_count",
]

CHURN_DAYS = 180

# ---- FIXED VALUES: RFM segments, rule order and names -------------------------
SEGMENTS = [
    "Champions",
    "Loyal Customers",
    "Potential Loyalists",
    "New Customers",
    "At Risk",
    "Can't Lose Them",
    "Hibernating",
    "Lost Customers",
]
HEALTHY_SEGMENTS = ["Champions", "Loyal Customers"]
FALLBACK_SEGMENT = "New Customers"

# ---- FIXED VALUES: segment profile table (channel, offer, tone, rate, budget) --
SEGMENT_PROFILES = {
    "Champions": {"channel": "email", "offer": "exclusive access", "tone": "premium", "response_rate": 0.32, "budget_pct": 16},
    "Loyal Customers": {"channel": "email", "offer": "loyalty points", "tone": "nurturing", "response_rate": 0.27, "budget_pct": 14},
    "Potential Loyalists": {"channel": "push", "offer": "loyalty points", "tone": "nurturing", "response_rate": 0.22, "budget_pct": 13},
    "New Customers": {"channel": "email", "offer": "discount", "tone": "nurturing", "response_rate": 0.18, "budget_pct": 10},
    "At Risk": {"channel": "sms", "offer": "discount", "tone": "urgent", "response_rate": 0.15, "budget_pct": 18},
    "Can't Lose Them": {"channel": "email", "offer": "exclusive access", "tone": "urgent", "response_rate": 0.21, "budget_pct": 17},
    "Hibernating": {"channel": "sms", "offer": "win-back", "tone": "reactivation", "response_rate": 0.1, "budget_pct": 8},
    "Lost Customers": {"channel": "sms", "offer": "win-back", "tone": "reactivation", "response_rate": 0.06, "budget_pct": 4},
}

# ---- FIXED VALUES: persona table (description, health) ------------------------
PERSONAS = {
    "Champions": {"icon": "&#x1F3C6;", "description": "High spenders with recent, frequent purchases. They love exclusivity.", "health": "green"},
    "Loyal Customers": {"icon": "&#x1F4AA;", "description": "Consistent and engaged. They respond well to loyalty perks.", "health": "green"},
    "Potential Loyalists": {"icon": "&#x1F680;", "description": "Rising engagement with growing value. Nurture to unlock loyalty.", "health": "yellow"},
    "New Customers": {"icon": "&#x1F389;", "description": "Recently acquired with limited history. Focus on onboarding journeys.", "health": "yellow"},
    "At Risk": {"icon": "&#x26A0;", "description": "High value but cooling off. Prioritize win-back and care outreach.", "health": "red"},
    "Can't Lose Them": {"icon": "&#x1F6A8;", "description": "Valuable yet disengaging quickly. Immediate action needed.", "health": "red"},
    "Hibernating": {"icon": "&#x1F6D1;", "description": "Low engagement and low spend. Re-activate with targeted offers.", "health": "yellow"},
    "Lost Customers": {"icon": "&#x1F480;", "description": "Lapsed and inactive. Consider reactivation or list hygiene.", "health": "red"},
}

# ---- FIXED VALUES: strategy overrides ------------------------------------------
PREMIUM_OFFER = "exclusive access"
PREMIUM_TONE = "premium"
PREMIUM_BUDGET_BONUS = 2
URGENT_CHANNEL = "sms"
URGENT_TONE = "urgent"
NURTURE_TONE = "nurturing"
LIFT_BASE = 0.6
LIFT_BUDGET_SCALE = 100000.0
LIFT_CAP = 2.0

# ---- FIXED VALUES: CLV tiers and churn risk bands ------------------------------
CLV_TIER_PROBS = [0.1, 0.3, 0.6]
CLV_TIERS = ["Bronze", "Silver", "Gold", "Platinum"]
CLV_NOISE_MEAN = 1.05
CLV_NOISE_SD = 0.12
RISK_BANDS = [(0.3, "green"), (0.6, "yellow")]
RISK_BAND_ELSE = "red"
HIGH_RISK_PROBABILITY = 0.7
GAUGE_STEPS = [30, 60]

# ---- FIXED VALUES: feature lists -------------------------------------------------
CLUSTER_NUMERIC_FEATURES = [
    "age", "total_orders", "total_spend", "avg_order_value", "loyalty_points",
    "support_tickets_raised", "satisfaction_score", "referral_count", "days_since_last_purchase",
]
CLUSTER_OPTIONAL_NUMERIC = ["recency", "frequency", "monetary", "rfm_score"]
CLUSTER_CATEGORICAL_FEATURES = [
    "gender", "country", "city", "product_category_preference", "channel",
    "payment_method", "discount_sensitivity", "rfm_segment",
]
CHURN_FEATURES = [
    "recency", "frequency", "monetary", "satisfaction_score",
    "support_tickets_raised", "days_since_last_purchase", "cluster_id",
]
CLV_FEATURES = [
    "recency", "frequency", "monetary", "total_orders", "avg_order_value",
    "satisfaction_score", "loyalty_points", "days_since_last_purchase", "cluster_id",
]
RADAR_FEATURES = ["total_spend", "frequency", "recency", "satisfaction_score", "clv_12m"]

# ---- FIXED VALUES: model and search settings -----------------------------------
SEED = 42
KMEANS_K_RANGE = list(range(2, 11))
KMEANS_RESTARTS = 10
KMEANS_WEIGHTS = {"silhouette": 0.45, "calinski_harabasz": 0.2, "davies_bouldin": 0.2, "inertia": 0.15}
COMPARISON_WEIGHTS = {"silhouette": 0.5, "davies_bouldin": 0.25, "calinski_harabasz": 0.25}
DBSCAN_MIN_SAMPLES = 5
EPS_PERCENTILES = [70, 75, 80, 85, 90, 92, 95]
WARD_K_RANGE = list(range(2, 11))
CHURN_TREES = 300
CHURN_DEPTH = 8
CHURN_MIN_LEAF = 2
CLV_ROUNDS = 300
CLV_DEPTH = 3
CLV_LEARNING_RATE = 0.05
TEST_FRACTION = 0.2
PROBABILITY_BINS = 30
MIGRATION_SHIFT_DAYS = 30
DEFAULT_BUDGET = 50000.0

# ---- FIXED VALUES: RFM segment rules, tested in this order ----------------------
# (segment, r range, f range, m range); a range is (min, max), None = open.
SEGMENT_RULES = [
    ("Champions", (4, None), (4, None), (4, None)),
    ("Loyal Customers", (3, None), (4, None), (3, None)),
    ("Potential Loyalists", (4, None), (2, None), (2, None)),
    ("New Customers", (4, None), (None, 2), (None, 2)),
    ("Can't Lose Them", (None, 2), (4, None), (4, None)),
    ("At Risk", (None, 2), (3, None), (3, None)),
    ("Hibernating", (None, 2), (None, 2), (None, 2)),
]
SEGMENT_ELSE = "Lost Customers"
SCORE_BINS = 5

# FIXED VALUES: texts that count as missing in a CSV column
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
