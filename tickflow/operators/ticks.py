"""Trade-level operators, batch and streaming alike.

Each function is a DataFrame transformation that Spark can run on a batch
table or on a streaming DataFrame (where noted); the streaming module adds
the watermarks, output modes and sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickflow import schemas as S


def ohlcv(ticks: DataFrame, every: str = "1 minute") -> DataFrame:
    """Trades -> tumbling-window OHLCV bars per symbol (stream-safe).

    open / close by (ts, trade_id); volume = summed size.  A hot symbol
    spreads over its windows and partial aggregation runs per task first.
    """
    order = F.struct("ts", "trade_id")
    return (ticks.groupBy("symbol", F.window("ts", every).alias("w"))
            .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", order).alias("close"),
                 F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"))
            .select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("ts_end"),
                    "open", "high", "low", "close", "volume", "trades"))


def last_price(ticks: DataFrame) -> DataFrame:
    """Latest price per symbol (stream-safe, update mode)."""
    order = F.struct("ts", "trade_id")
    return ticks.groupBy("symbol").agg(F.max_by("price", order).alias("price"),
                                       F.max("ts").alias("ts"))


def price_alerts(ticks: DataFrame, rules: DataFrame) -> DataFrame:
    """T4: trades outside their symbol's [low, high] band (stream-static join)."""
    j = ticks.join(rules.select("symbol", "low", "high"), "symbol")
    cond = (F.when(F.col("price") > F.col("high"), F.lit("above_high"))
            .when(F.col("price") < F.col("low"), F.lit("below_low")))
    return (j.withColumn("alert_condition", cond)
            .filter(F.col("alert_condition").isNotNull())
            .select("symbol", "trade_id", "ts", F.col("price").alias("current_price"),
                    "alert_condition", "low", "high"))


def training_status_updates(log: DataFrame) -> DataFrame:
    """Training-status messages implied by the event log."""
    st = (F.when(F.col("event_type") == S.LSTM_TRAINING_STARTED, F.lit("started"))
          .when(F.col("event_type") == S.LSTM_TRAINING_COMPLETED, F.lit("completed"))
          .when(F.col("event_type") == S.PREDICTION_STARTED, F.lit("in_progress"))
          .when(F.col("event_type") == S.ANALYSIS_FAILED, F.lit("failed")))
    progress = (F.when(F.col("event_type") == S.LSTM_TRAINING_STARTED, F.lit(0))
                .when(F.col("event_type") == S.LSTM_TRAINING_COMPLETED, F.lit(100))
                .when(F.col("event_type") == S.PREDICTION_STARTED, F.lit(50)))
    return (log.select(F.col("aggregate_id").alias("symbol"), st.alias("status"),
                       progress.alias("progress"), F.col("timestamp").alias("ts"), "seq")
            .filter(F.col("status").isNotNull()))


def latest_training_status(updates: DataFrame) -> DataFrame:
    """T5: newest training status per symbol (stream-safe, update mode)."""
    return (updates.groupBy("symbol")
            .agg(F.max_by(F.struct("status", "progress", "ts"), F.struct("ts", "seq")).alias("s"))
            .select("symbol", "s.status", "s.progress", "s.ts"))


def last_n(ticks: DataFrame, n: int = S.RING_BUFFER) -> DataFrame:
    """The last ``n`` trades per symbol (ring buffer).  A window group
    limit: each task keeps its newest ``n`` per symbol before the shuffle."""
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc(), F.col("trade_id").desc())
    return ticks.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n) \
        .drop("_rn")


def merge_bars(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert live bars into a bar table: a live bar replaces the stored
    bar with the same (symbol, ts), new keys are added."""
    cols = S.BAR_COLUMNS
    u = base.select(*cols, F.lit(0).alias("_v")).unionByName(
        updates.select(*cols, F.lit(1).alias("_v")))
    return (u.groupBy("symbol", "ts")
            .agg(F.max_by(F.struct(*[c for c in cols if c not in ("symbol", "ts")]), "_v")
                 .alias("b"))
            .select("symbol", "ts", "b.*"))


def dedup_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """T10 batch twin: one row per event id (redeliveries are identical)."""
    return events.dropDuplicates([key])


def user_action_counts(actions: DataFrame, every: str = "1 hour") -> DataFrame:
    """Actions per tumbling window and action (stream-safe)."""
    return (actions.groupBy(F.window("ts", every).alias("w"), "action")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "action", "n"))
