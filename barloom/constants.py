"""Fixed values that must be equal for equal results."""

# Vocabulary.
STRATEGIES = ("trend", "correction")
ACTIONS = ("buy", "sell")
LABELS = ("high_delta", "low_delta", "high_stop", "low_stop")
TEST_VARIANTS = ("plain", "benchmark", "ml", "combined")

# Session and retention.
BARS_PER_DAY = 78
BARS_PER_PERIOD = 13
SESSION_PERIODS = 6
MINUTES_PER_DAY = 390
RETAINED_DAYS = 504
RANGE_BARS = 75
ILLIQUID_GAPS = 10

# Benchmark features.
RANGE_AVERAGE_BARS = 6
FAST_SMA, SLOW_SMA = 18, 204
FAST_EMA, SLOW_EMA = 126, 330

# Labels and the back-test gate.
STOP_RATIO = 1.0005
MARKET_SHARE = 0.5
MAX_BETA = 0.3

# Day ages.
FRESH_DAYS = 7
RELOAD_DAYS = 30
RETEST_DAYS = 30
RETEST_DAYS_REPORTS = 180
REPORT_STRATEGIES = ("reports", "eps-growth")
MONTHS_WITHOUT_DATA = 24

# Trading defaults.
DEFAULT_STOP_ROWS = 6
DEFAULT_LIMIT_ROWS = 3
ROWS_PER_POSITION = 3
DEFAULT_TRAIL = 2.0
DEFAULT_LIMIT_BUY, DEFAULT_LIMIT_SELL = 1.005, 0.995
DEFAULT_LIMIT_MINUTES = 60
EMERGENCY_TRAIL = 0.1
NEAR_LIMIT_SELL, NEAR_LIMIT_BUY = 1.001, 0.999
BALANCE_SHARE, TRADES_PER_MONTH = 0.1, 100
DEFAULT_STOP_BUY, DEFAULT_STOP_SELL = 0.98, 1.02
MIN_BALANCE = 30000
MARKET_ORDER_SECONDS = 60
OPEN_DELAY_SECONDS = 30

# Order types and broker status names.
MARKET, STOP, LIMIT = "MKT", "STOP LOSS", "TAKE PROFIT"
BROKER_STATUS = {
    "Filled": "filled",
    "Submitted": "submitted",
    "PreSubmitted": "pre-submitted",
    "PendingSubmit": "pending-submit",
    "PendingCancel": "pending-cancel",
    "ApiCancelled": "api-cancelled",
    "Cancelled": "cancelled",
    "Inactive": "inactive",
}

# Date formats of raw bars.
DAILY_FORMAT = "yyyyMMdd"
INTRADAY_FORMAT = "yyyyMMdd  HH:mm:ss"

# Classifier search.
TRAIN_RATIO = 0.75
LOGISTIC_ITERATIONS = 10
LOGISTIC_PENALTIES = (10.0, 1.0, 0.1, 0.01)
FOREST_TREES = 50
PERCEPTRON_LAYERS = (3, 6, 2)
PERCEPTRON_BLOCK = 128
PERCEPTRON_ITERATIONS = 100
