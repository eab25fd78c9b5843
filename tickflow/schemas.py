"""Schemas and vocabularies shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the application's vocabulary for results to
# line up (event names, statuses, step names, topic names, defaults).
# ---------------------------------------------------------------------------
ANALYSIS_REQUESTED = "AnalysisRequested"
ANALYSIS_STARTED = "AnalysisStarted"
DATA_FETCHED = "DataFetched"
LSTM_TRAINING_STARTED = "LSTMTrainingStarted"
LSTM_TRAINING_COMPLETED = "LSTMTrainingCompleted"
PREDICTION_STARTED = "PredictionStarted"
PREDICTION_COMPLETED = "PredictionCompleted"
ANALYSIS_COMPLETED = "AnalysisCompleted"
ANALYSIS_FAILED = "AnalysisFailed"

# The nine emitted event types, in workflow order.
EMITTED_EVENT_TYPES = [
    ANALYSIS_REQUESTED, ANALYSIS_STARTED, DATA_FETCHED, LSTM_TRAINING_STARTED,
    LSTM_TRAINING_COMPLETED, PREDICTION_STARTED, PREDICTION_COMPLETED,
    ANALYSIS_COMPLETED, ANALYSIS_FAILED,
]
# Events that go through the aggregate and bump its version.
VERSIONED_EVENT_TYPES = [
    ANALYSIS_REQUESTED, ANALYSIS_STARTED, DATA_FETCHED,
    LSTM_TRAINING_COMPLETED, PREDICTION_COMPLETED, ANALYSIS_COMPLETED,
]
# Events the read-model projections subscribe to.
READ_MODEL_EVENT_TYPES = [ANALYSIS_COMPLETED, ANALYSIS_STARTED, LSTM_TRAINING_COMPLETED]

AGGREGATE_TYPE = "StockAnalysis"
STATUS_IDLE, STATUS_REQUESTED, STATUS_RUNNING, STATUS_COMPLETED = (
    "idle", "requested", "running", "completed")
ACTIVE_STATUSES = [STATUS_RUNNING, STATUS_REQUESTED]

# Processing steps, in workflow order.
STEPS = ["request_received", "event_stored", "fetching_data", "training_lstm",
         "generating_predictions", "completing_analysis", "workflow_completed",
         "workflow_failed", "request_failed"]

# Topic names.
TOPICS = {
    "finnhub_trades": "finnhub-trades",
    "finnhub_ohlc": "finnhub-ohlc-1min",
    "finnhub_historical": "finnhub-historical",
    "finnhub_news": "finnhub-news",
    "finnhub_company_profiles": "finnhub-company-profiles",
    "model_predictions": "ml-predictions",
    "model_metrics": "ml-model-metrics",
    "model_training_status": "ml-training-status",
    "stock_data": "stock-current-data",
    "app_events": "app-events",
    "user_actions": "user-actions",
    "alerts": "price-alerts",
}

# Message type tags of the JSON envelopes.
MSG_PREDICTION_RESULTS = "prediction_results"
MSG_MODEL_METRICS = "model_metrics"
MSG_TRAINING_STATUS = "training_status"
MSG_CURRENT_STOCK_DATA = "current_stock_data"
MSG_USER_ACTION = "user_action"
MSG_PRICE_ALERT = "price_alert"
MSG_HISTORICAL = "historical"
MSG_OHLCV_1MIN = "ohlcv_1min"

# Messages, error texts and model labels.
MSG_NOT_READY = "Analysis for %s is still running"
MSG_NOT_FOUND = "No analysis results for %s"
ERR_FETCH = "Data fetching failed"
ERR_TRAIN = "LSTM training failed"
ERR_PREDICT = "Prediction generation failed"
MODEL_LABEL_METRICS = "LSTM"
MODEL_LABEL_PREDICTIONS = "Enhanced_LSTM"
DATA_SOURCE_PERFORMANCE = "lstm_only"

# Defaults.
FALLBACK_CURRENT_DATA = {"current_price": 100.0, "change": 0.0, "change_pct": 0.0,
                         "volume": 1000000, "source": "fallback"}
DEFAULT_REQUESTER = "system"
DATA_SOURCE_CURRENT = "hybrid_lstm_only"
MODEL_TYPE_RESULT = "immediate_event_driven_lstm"
ANNUALISATION_DAYS = 252
WINDOW_SIZE = 60
MIN_ROWS = 100
TRAIN_FRACTION = 0.8
VALIDATION_FRACTION = 0.2
NUM_SIMULATIONS = 10
DAYS_AHEAD = 30
NOISE_SD = 0.01
RING_BUFFER = 1000

# Supported symbol list: symbol, name.
SYMBOL_LIST = [
    ("AAPL", "Apple Inc."),
    ("GOOGL", "Alphabet Inc."),
    ("MSFT", "Microsoft Corporation"),
    ("AMZN", "Amazon.com Inc."),
    ("TSLA", "Tesla Inc."),
    ("META", "Meta Platforms Inc."),
    ("NFLX", "Netflix Inc."),
    ("NVDA", "NVIDIA Corporation"),
    ("IBM", "International Business Machines Corporation"),
    ("JPM", "JPMorgan Chase & Co."),
]
# ---------------------------------------------------------------------------

BAR_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]

BARS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
])

TICKS = T.StructType([
    T.StructField("trade_id", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("size", T.LongType()),
])

CANDLE_PAYLOAD = T.StructType([
    T.StructField("s", T.StringType()),
    T.StructField("t", T.ArrayType(T.LongType())),
    T.StructField("o", T.ArrayType(T.DoubleType())),
    T.StructField("h", T.ArrayType(T.DoubleType())),
    T.StructField("l", T.ArrayType(T.DoubleType())),
    T.StructField("c", T.ArrayType(T.DoubleType())),
    T.StructField("v", T.ArrayType(T.DoubleType())),
])

EVENT_LOG = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("aggregate_id", T.StringType()),
    T.StructField("aggregate_type", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("version", T.IntegerType()),
])

# Fields of the JSON ``data`` payload the fold reads.
EVENT_DATA = T.StructType([
    T.StructField("analysis_id", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("requester", T.StringType()),
    T.StructField("previous_status", T.StringType()),
    T.StructField("data_info", T.StringType()),
    T.StructField("predictions", T.StringType()),
    T.StructField("results", T.StringType()),
    T.StructField("completion_timestamp", T.StringType()),
    T.StructField("error", T.StringType()),
])

COMMANDS = T.StructType([
    T.StructField("command_id", T.StringType()),
    T.StructField("command_type", T.StringType()),
    T.StructField("aggregate_id", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("correlation_id", T.StringType()),
])

OHLCV_MESSAGE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
])

HISTORY_RECORD = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
])

HISTORY_MESSAGE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("data", T.ArrayType(HISTORY_RECORD)),
])


def require_columns(df, columns) -> None:
    """Fail with ``ValueError`` when a required column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
