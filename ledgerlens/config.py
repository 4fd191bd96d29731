"""Fixed values that results depend on.

These are the values a user of the original pipeline relies on; they are
stated here as plain data, in their natural order.
"""

from __future__ import annotations

# ---- fixed values: data model -------------------------------------------
TARGET = "Class"
V_COLS = [f"V{i}" for i in range(1, 29)]
FEATURES = ["Time"] + V_COLS + ["Amount"]          # model input order
REQUIRED_UPLOAD = ["Time", "Amount"] + V_COLS      # upload column check order
SCALE_COLS = ["Amount", "Time"]

SEED = 42
TEST_SIZE = 0.2
TUNE_FRACTION = 0.15
CV_FOLDS = 5
N_TRIALS = 50

# ---- fixed values: verdict thresholds and labels --------------------------
FRAUD_THRESHOLD = 0.75
SUSPECT_THRESHOLD = 0.35
VERDICT_CODES = ["fraud", "suspect", "safe"]
VERDICT_LABELS = {"fraud": "Gian lận", "suspect": "Nghi ngờ", "safe": "An toàn"}

# ---- fixed values: validation ranges (form checks) -----------------------
TIME_RANGE = (0.0, 172800.0)
AMOUNT_RANGE = (0.0, 25000.0)
V_RANGE = (-100.0, 100.0)

# ---- fixed values: model names ---------------------------------------------
MODEL_NAMES = ["random_forest", "logistic_regression", "knn", "svm"]
DISPLAY_NAMES = {
    "random_forest": "Random Forest",
    "logistic_regression": "Logistic Regression",
    "knn": "K-Nearest Neighbors",
    "svm": "Support Vector Machine",
}
# production models exposed for scoring: id -> display name
SERVING_MODELS = {
    "random_forest_smote": "Random Forest",
    "logistic_regression_smote": "Logistic Regression",
    "knn_smote": "KNN",
    "svm_smote": "SVM",
}
DEFAULT_MODEL_ID = "random_forest_smote"
SAMPLING_STRATEGIES = ["none", "undersample", "smote"]

# ---- fixed values: statement sheets ----------------------------------------
STATEMENT_HEADER_MARKERS = ["ngày gd", "stt", "ngày"]
TECH_SHEET_HINTS = ["ky thuat", "du lieu", "technical"]
STATEMENT_SHEET_HINTS = ["sao ke", "giao dich", "statement"]
CUSTOMER_MARKERS = ["khách hàng", "kh:"]
BANK_MARKERS = ["ngân hàng", "nh:"]
VND_PER_USD = 25000
LOCAL_OFFSET_HOURS = 7

# ---- fixed values: synthetic demo rows -------------------------------------
SAFE_TIME_MAX = 50000
SAFE_AMOUNT = (10.0, 90.0)
SAFE_V_HALF_WIDTH = 0.4
FRAUD_TIME_MAX = 172000
FRAUD_AMOUNT = (50.0, 1050.0)
FRAUD_OTHER_V_HALF_WIDTH = 1.5
# driver feature centres of the demo fraud rows (value +/- 1)
FRAUD_DRIVERS = {
    "V14": -8.5, "V17": -12.0, "V12": -7.2, "V10": -5.5,
    "V4": 4.8, "V11": 4.1, "V1": -4.5, "V3": -5.0,
    "V7": -3.5, "V16": -4.0, "V18": -2.8,
}

# ---- alert rules: names, severities, times and limits are fixed values, the
# descriptions are our own ------------------------------------------------------
ALERT_RULES = [
    # name, severity, for (seconds), description template
    ("PodCrashLooping", "critical", 120,
     "Pod {pod} in namespace {namespace} restarted several times in 5 minutes."),
    ("NodeHighMemory", "warning", 300, "Node {instance} is using {value}% RAM."),
    ("NodeHighCPU", "warning", 300, "Node {instance} is using {value}% CPU."),
    ("PostgreSQLDown", "critical", 60, "PostgreSQL instance {instance} is not responding."),
    ("PostgreSQLHighConnections", "warning", 300,
     "PostgreSQL is using {value}% of its maximum connections."),
    ("WebappReplicasLow", "warning", 180, "Only {value}/2 replicas are running."),
]
MEMORY_PCT_LIMIT = 85.0
CPU_PCT_LIMIT = 85.0
CONNECTION_PCT_LIMIT = 80.0
MIN_REPLICAS = 2
ALERT_GROUP_BY = ["alertname", "namespace"]
ALERT_GROUP_WAIT_S = 30
ALERT_GROUP_INTERVAL_S = 300
ALERT_REPEAT_S = 4 * 3600
ALERT_ROUTE_SEVERITY = "warning|critical"
RETENTION_DAYS = 7
LOG_INDEX_FORMAT = "yyyy.MM.dd"
