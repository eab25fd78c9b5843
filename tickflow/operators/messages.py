"""Keyed JSON messages: envelopes, sink, decoding (S4, S5a-f, S6).

A message is ``(topic, key, value)`` with ``value`` a JSON object carrying a
``type`` tag.  Envelopes are built with ``to_json(struct(...))`` on the
executors; timestamps are written with an explicit microsecond pattern
(``to_json``'s default cuts to milliseconds) and come from the data, not the
wall clock, so a replay writes the same bytes.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow import schemas as S

ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
JSON_OPTIONS = {"timestampFormat": ISO_PATTERN, "timestampNTZFormat": ISO_PATTERN}


def iso(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, ISO_PATTERN)


def envelope(df: DataFrame, topic: str, key: Column, fields: list[Column]) -> DataFrame:
    """``(topic, key, value)`` rows; ``value`` is the JSON of ``fields``."""
    return df.select(F.lit(topic).alias("topic"), key.cast("string").alias("key"),
                     F.to_json(F.struct(*fields), JSON_OPTIONS).alias("value"))


def prediction_results(doc: DataFrame, model_type: str = S.MODEL_LABEL_PREDICTIONS) -> DataFrame:
    """One message per symbol holding its forecast document.

    ``doc``: symbol, dates, prices, lower_bound, upper_bound, last_actual_price,
    ts (the forecast's as-of time).
    """
    preds = F.struct(
        F.lit(model_type).alias("model_type"), F.col("symbol"),
        F.size("dates").alias("days_ahead"),
        F.struct("dates", "prices", "lower_bound", "upper_bound").alias("predictions"),
        F.col("last_actual_price"), iso("ts").alias("prediction_timestamp"))
    return envelope(doc, S.TOPICS["model_predictions"], F.col("symbol"),
                    [F.col("symbol"), iso("ts").alias("timestamp"),
                     F.lit(S.MSG_PREDICTION_RESULTS).alias("type"), preds.alias("predictions")])


def model_metrics(metrics: DataFrame, model_type: str = S.MODEL_LABEL_METRICS) -> DataFrame:
    """Key ``<model_type>-<symbol>``; ``metrics`` has symbol, ts and the
    metric columns."""
    cols = [c for c in metrics.columns if c not in ("symbol", "ts")]
    return envelope(metrics, S.TOPICS["model_metrics"],
                    F.concat_ws("-", F.lit(model_type), F.col("symbol")),
                    [F.lit(model_type).alias("model_type"), F.col("symbol"),
                     iso("ts").alias("timestamp"), F.struct(*cols).alias("metrics"),
                     F.lit(S.MSG_MODEL_METRICS).alias("type")])


def training_status(status: DataFrame) -> DataFrame:
    """Symbol, status (started / in_progress / completed / failed), progress."""
    return envelope(status, S.TOPICS["model_training_status"], F.col("symbol"),
                    [F.col("symbol"), F.col("status"), F.col("progress"),
                     iso("ts").alias("timestamp"),
                     F.lit(S.MSG_TRAINING_STATUS).alias("type")])


def stock_data(current: DataFrame) -> DataFrame:
    """S5d: current-data rows; key is the symbol or ``unknown``."""
    data_cols = [c for c in current.columns if c != "ts"]
    return envelope(current, S.TOPICS["stock_data"],
                    F.coalesce(F.col("symbol"), F.lit("unknown")),
                    [iso("ts").alias("timestamp"), F.struct(*data_cols).alias("data"),
                     F.lit(S.MSG_CURRENT_STOCK_DATA).alias("type")])


def user_actions(actions: DataFrame) -> DataFrame:
    """S5e: ``actions`` has action, ts and detail columns; key = action."""
    detail_cols = [c for c in actions.columns if c not in ("action", "ts")]
    return envelope(actions, S.TOPICS["user_actions"], F.col("action"),
                    [F.col("action"), F.struct(*detail_cols).alias("details"),
                     iso("ts").alias("timestamp"), F.lit(S.MSG_USER_ACTION).alias("type")])


def price_alerts(alerts: DataFrame) -> DataFrame:
    """S5f: alert rows (symbol, current_price, alert_condition, ts)."""
    return envelope(alerts, S.TOPICS["alerts"], F.col("symbol"),
                    [F.col("symbol"), F.col("current_price"), F.col("alert_condition"),
                     iso("ts").alias("timestamp"), F.lit(S.MSG_PRICE_ALERT).alias("type")])


def ohlcv_messages(bars: DataFrame) -> DataFrame:
    """1-minute bars as ``ohlcv_1min`` messages on the OHLC topic."""
    return envelope(bars, S.TOPICS["finnhub_ohlc"], F.col("symbol"),
                    [F.col("symbol"), F.lit(S.MSG_OHLCV_1MIN).alias("type"),
                     iso("ts").alias("timestamp"), "open", "high", "low", "close", "volume"])


def message_type(value: str | Column = "value") -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.get_json_object(v, "$.type")


def write_records(records: DataFrame, fmt: str = "kafka", **options) -> bool:
    """Write ``(topic, key, value)`` records; whether the write was acknowledged.

    ``fmt='kafka'`` needs the Kafka connector on the cluster (options
    ``kafka.bootstrap.servers``, ``kafka.acks=all``, ...); any file format
    works for tests, partitioned by topic.  A failed write is logged and
    returns False: the caller decides what that ends.
    """
    try:
        w = records.select("topic", "key", "value").write
        if fmt == "kafka":
            w.format("kafka").options(**options).save()
        else:
            path = options.pop("path")
            w.mode(options.pop("mode", "append")).partitionBy("topic").format(fmt) \
                .options(**options).save(path)
    except Exception:  # noqa: BLE001
        logging.getLogger(__name__).exception("records were not written")
        return False
    return True


def decode(messages: DataFrame, schema, types: list[str] | None = None) -> DataFrame:
    """Parse message values with a declared schema, keep the given types."""
    out = messages.withColumn("msg", F.from_json("value", schema))
    if types:
        out = out.filter(F.col("msg.type").isin(types))
    return out
