"""Registered queries for messages and trade-level operators (batch twins of
the streaming operators): S4-S6, S5a-f, S9, T2-T5, T7, T9, T10, A12."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.operators import forecast as fc
from tickflow.operators import indicators as ind
from tickflow.operators import messages as msg
from tickflow.operators import ticks as tk
from tickflow.plans.event_queries import log
from tickflow.plans.forecast_queries import DOCUMENT_SQL, FC_EXTRA, SCORES_SQL, SEED, _TR_EXTRA, _paths_with_ctes
from tickflow.plans.market_queries import bars
from tickflow.plans.oracle import with_fixtures
from tickflow.plans.registry import register
from tickflow.sources import fixtures as fx
from tickflow.session import materialize
from tickflow.sources.tables import Tables
from tickflow.streaming import live

ISO_SQL = "'%Y-%m-%dT%H:%M:%S.%f'"
ORD_T = "{'t': ts, 'i': trade_id}"
CUT_BASE, CUT_LIVE = "2024-01-20 00:00:00", "2024-01-19 00:00:00"


def ticks(spark, sf_dir):
    return fx.events_as_ticks(Tables(spark, sf_dir).events)


def field(name, typ="string"):
    return F.get_json_object("value", f"$.{name}").cast(typ).alias(name)


_OHLCV_SQL = f"""
    SELECT symbol, date_trunc('minute', ts) AS ts,
           date_trunc('minute', ts) + INTERVAL 1 MINUTE AS ts_end,
           arg_min(price, {ORD_T}) AS open, max(price) AS high, min(price) AS low,
           arg_max(price, {ORD_T}) AS close, CAST(sum(size) AS BIGINT) AS volume,
           count(*) AS trades
    FROM ticks GROUP BY symbol, date_trunc('minute', ts)"""


@register("ohlcv_1min", ids=("T2",), sql=with_fixtures(_OHLCV_SQL, "ticks"))
def q_ohlcv_1min(spark, sf_dir):
    return tk.ohlcv(ticks(spark, sf_dir), "1 minute")


@register("last_price", ids=("T3",), sql=with_fixtures(f"""
    SELECT symbol, arg_max(price, {ORD_T}) AS price, max(ts) AS ts
    FROM ticks GROUP BY symbol""", "ticks"))
def q_last_price(spark, sf_dir):
    return tk.last_price(ticks(spark, sf_dir))


_ALERTS_SQL = """
    SELECT t.symbol, t.trade_id, t.ts, t.price AS current_price,
           CASE WHEN t.price > r.high THEN 'above_high' ELSE 'below_low' END AS alert_condition,
           r.low, r.high
    FROM ticks t JOIN alert_rules r ON t.symbol = r.symbol
    WHERE t.price > r.high OR t.price < r.low"""


def _alerts(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return tk.price_alerts(t, fx.alert_rules(t))


@register("price_alerts", ids=("T4",), sql=with_fixtures("""
    SELECT symbol, trade_id, ts, current_price, alert_condition, round(low, 6) AS low,
           round(high, 6) AS high
    FROM al""", "alert_rules", extra=[("al", _ALERTS_SQL)]))
def q_price_alerts(spark, sf_dir):
    a = _alerts(spark, sf_dir)
    return a.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


_TS_UPDATES_SQL = """
    SELECT aggregate_id AS symbol,
           CASE event_type WHEN 'LSTMTrainingStarted' THEN 'started'
                           WHEN 'LSTMTrainingCompleted' THEN 'completed'
                           WHEN 'PredictionStarted' THEN 'in_progress'
                           WHEN 'AnalysisFailed' THEN 'failed' END AS status,
           CASE event_type WHEN 'LSTMTrainingStarted' THEN 0
                           WHEN 'LSTMTrainingCompleted' THEN 100
                           WHEN 'PredictionStarted' THEN 50 END AS progress,
           timestamp AS ts, seq
    FROM event_log
    WHERE event_type IN ('LSTMTrainingStarted', 'LSTMTrainingCompleted', 'PredictionStarted',
                         'AnalysisFailed')"""


@register("training_status", ids=("T5",), sql=with_fixtures("""
    SELECT symbol, status, progress, ts
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rn
          FROM upd) u WHERE rn = 1""", "event_log", extra=[("upd", _TS_UPDATES_SQL)]))
def q_training_status(spark, sf_dir):
    return tk.latest_training_status(tk.training_status_updates(log(spark, sf_dir)))


@register("last_1000", ids=("T7",), sql=with_fixtures("""
    SELECT trade_id, symbol, ts, price, size
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, trade_id DESC) AS rn
          FROM ticks) t WHERE rn <= 1000""", "ticks"))
def q_last_1000(spark, sf_dir):
    return tk.last_n(ticks(spark, sf_dir), 1000)


@register("live_bar_merge", ids=("T9",), sql=with_fixtures(f"""
    SELECT symbol, ts, arg_max(open, v) AS open, arg_max(high, v) AS high,
           arg_max(low, v) AS low, arg_max(close, v) AS close, arg_max(volume, v) AS volume
    FROM (SELECT *, 0 AS v FROM hb WHERE ts < TIMESTAMP '{CUT_BASE}'
          UNION ALL SELECT *, 1 FROM lb) u
    GROUP BY symbol, ts""", "ticks", extra=[
    ("hb", f"""SELECT symbol, date_trunc('hour', ts) AS ts,
                     arg_min(price, {ORD_T}) AS open, max(price) AS high, min(price) AS low,
                     arg_max(price, {ORD_T}) AS close, count(*) AS volume
              FROM ticks WHERE ts < TIMESTAMP '{CUT_BASE}' GROUP BY 1, 2"""),
    ("lb", f"""SELECT symbol, date_trunc('hour', ts) AS ts,
                     arg_min(price, {ORD_T}) AS open, max(price) AS high, min(price) AS low,
                     arg_max(price, {ORD_T}) AS close, count(*) AS volume
              FROM ticks WHERE ts >= TIMESTAMP '{CUT_LIVE}' GROUP BY 1, 2""")]))
def q_live_bar_merge(spark, sf_dir):
    """Stored hourly bars up to a cut, live bars recomputed from the day before
    it: the overlap is replaced, everything after is added."""
    t = ticks(spark, sf_dir)
    base = fx.bars_from_ticks(t.filter(F.col("ts") < F.lit(CUT_BASE).cast("timestamp_ntz")))
    live = fx.bars_from_ticks(t.filter(F.col("ts") >= F.lit(CUT_LIVE).cast("timestamp_ntz")))
    return tk.merge_bars(base, live)


@register("events_dedup", ids=("T10",), sql="""
    SELECT DISTINCT * FROM (SELECT * FROM events
                            UNION ALL SELECT * FROM events WHERE event_type = 'click') e""")
def q_events_dedup(spark, sf_dir):
    """Every click is delivered twice (at-least-once consumer); dedup restores the log."""
    ev = Tables(spark, sf_dir).events
    redelivered = ev.unionByName(ev.filter(F.col("event_type") == "click"))
    return tk.dedup_events(redelivered)


@register("user_action_counts", ids=("A12",), sql="""
    SELECT date_trunc('hour', ts) AS window_start, event_type AS action, count(*) AS n
    FROM events GROUP BY 1, 2""")
def q_user_action_counts(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select(F.col("event_type").alias("action"), "ts")
    return tk.user_action_counts(ev, "1 hour")


# -- messages -----------------------------------------------------------------------

def _metrics_frame(spark, sf_dir):
    ts = fc.training_set(bars(spark, sf_dir))
    sc = fc.score_windows(ts, fc.fixed_model())
    m = fc.forecast_metrics(sc)
    last = ts.groupBy("symbol").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    piv = m.groupBy("symbol").agg(
        *[F.max(F.when(F.col("split") == s, F.round(c, 4))).alias(f"{s}_{c}")
          for s in ("train", "test") for c in ("mae", "rmse")])
    return piv.join(last, "symbol").withColumnRenamed("n", "data_points")


@register("msg_metrics", ids=("S5b",), sql=with_fixtures(f"""
    SELECT 'ml-model-metrics' AS topic, 'LSTM-' || m.symbol AS key, 'model_metrics' AS type,
           train_mae, test_mae, train_rmse, test_rmse, data_points,
           strftime(ts, {ISO_SQL}) AS timestamp
    FROM (SELECT symbol,
                 max(CASE WHEN split = 'train' THEN mae END) AS train_mae,
                 max(CASE WHEN split = 'test' THEN mae END) AS test_mae,
                 max(CASE WHEN split = 'train' THEN rmse END) AS train_rmse,
                 max(CASE WHEN split = 'test' THEN rmse END) AS test_rmse
          FROM (SELECT symbol, split, round(avg(abs(actual - prediction)), 4) AS mae,
                       round(sqrt(avg((actual - prediction) * (actual - prediction))), 4) AS rmse
                FROM sco GROUP BY 1, 2) x GROUP BY symbol) m
    JOIN (SELECT symbol, max(ts) AS ts, count(*) AS data_points FROM tr GROUP BY symbol) l
      ON m.symbol = l.symbol""", "bars", extra=_TR_EXTRA + [("sco", SCORES_SQL)]))
def q_msg_metrics(spark, sf_dir):
    out = msg.model_metrics(_metrics_frame(spark, sf_dir))
    return out.select("topic", "key", field("type"),
                      *[F.get_json_object("value", f"$.metrics.{c}").cast("double").alias(c)
                        for c in ("train_mae", "test_mae", "train_rmse", "test_rmse")],
                      F.get_json_object("value", "$.metrics.data_points").cast("bigint")
                      .alias("data_points"),
                      field("timestamp"))


@register("msg_training_status", ids=("S5c",), sql=with_fixtures(f"""
    SELECT 'ml-training-status' AS topic, symbol AS key, 'training_status' AS type, status,
           progress, strftime(ts, {ISO_SQL}) AS timestamp
    FROM upd""", "event_log", extra=[("upd", _TS_UPDATES_SQL)]))
def q_msg_training_status(spark, sf_dir):
    out = msg.training_status(tk.training_status_updates(log(spark, sf_dir)))
    return out.select("topic", "key", field("type"), field("status"),
                      field("progress", "int"), field("timestamp"))


@register("msg_stock_data", ids=("S5d",), sql=with_fixtures(f"""
    SELECT 'stock-current-data' AS topic, symbol AS key, 'current_stock_data' AS type,
           round(close, 6) AS close, round(close - prev_close, 6) AS change,
           strftime(ts, {ISO_SQL}) AS timestamp
    FROM (SELECT symbol, ts, close,
                 coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), close) AS prev_close,
                 row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn
          FROM bars) b WHERE rn = 1""", "bars"))
def q_msg_stock_data(spark, sf_dir):
    lc = ind.last_change(bars(spark, sf_dir))
    cur = lc.select("symbol", "ts", F.round("close", 6).alias("close"),
                    F.round("change", 6).alias("change"))
    out = msg.stock_data(cur)
    return out.select("topic", "key", field("type"),
                      F.get_json_object("value", "$.data.close").cast("double").alias("close"),
                      F.get_json_object("value", "$.data.change").cast("double").alias("change"),
                      field("timestamp"))


@register("msg_user_action", ids=("S5e",), sql=f"""
    SELECT 'user-actions' AS topic, event_type AS key, 'user_action' AS type,
           user_id, value, strftime(ts, {ISO_SQL}) AS timestamp
    FROM events""")
def q_msg_user_action(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select(F.col("event_type").alias("action"), "ts",
                                             "user_id", "value", "props")
    out = msg.user_actions(ev)
    return out.select("topic", "key", field("type"),
                      F.get_json_object("value", "$.details.user_id").cast("bigint")
                      .alias("user_id"),
                      F.get_json_object("value", "$.details.value").cast("double").alias("value"),
                      field("timestamp"))


@register("msg_price_alert", ids=("S5f",), sql=with_fixtures(f"""
    SELECT 'price-alerts' AS topic, symbol AS key, 'price_alert' AS type, current_price,
           alert_condition, strftime(ts, {ISO_SQL}) AS timestamp
    FROM al""", "alert_rules", extra=[("al", _ALERTS_SQL)]))
def q_msg_price_alert(spark, sf_dir):
    return alert_fields(msg.price_alerts(_alerts(spark, sf_dir)))


def alert_fields(records):
    """Price-alert records by their fields."""
    return records.select("topic", "key", field("type"), field("current_price", "double"),
                          field("alert_condition"), field("timestamp"))


@register("msg_predictions", ids=("S5a",), sql=_paths_with_ctes(f"""
    SELECT 'ml-predictions' AS topic, d.symbol AS key, '{S.MSG_PREDICTION_RESULTS}' AS type,
           '{S.MODEL_LABEL_PREDICTIONS}' AS model_type, d.n_days AS days_ahead, d.first_date, d.last_date, d.prices_sum,
           d.lower_sum, d.upper_sum, b.close AS last_actual_price, strftime(b.ts, {ISO_SQL}) AS timestamp
    FROM ({DOCUMENT_SQL}) d
    JOIN (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) b
      ON b.symbol = d.symbol AND b.rn = 1""", FC_EXTRA))
def q_msg_predictions(spark, sf_dir):
    """The messages by the fields of their documents, arrays by length, ends and sums."""
    b = materialize(bars(spark, sf_dir))  # read by four branches
    doc = fc.prediction_document(fc.forecast(b, fc.fixed_model(), seed=SEED))
    last = ind.latest_bar(b).select("symbol", "ts", F.col("close").alias("last_actual_price"))
    out = msg.prediction_results(doc.join(last, "symbol"))
    m = F.from_json("value", """timestamp string, type string, predictions struct<model_type:string, days_ahead:bigint,
        predictions:struct<dates:array<string>, prices:array<double>, lower_bound:array<double>, upper_bound:array<double>>,
        last_actual_price:double>""")
    p = "m.predictions.predictions"
    total = lambda c: F.round(F.aggregate(F.col(f"{p}.{c}"), F.lit(0.0), lambda a, x: a + x), 2)
    return out.withColumn("m", m).select(
        "topic", "key", "m.type", "m.predictions.model_type", "m.predictions.days_ahead",
        F.element_at(f"{p}.dates", 1).alias("first_date"), F.element_at(f"{p}.dates", -1).alias("last_date"),
        total("prices").alias("prices_sum"), total("lower_bound").alias("lower_sum"), total("upper_bound").alias("upper_sum"),
        "m.predictions.last_actual_price", "m.timestamp")


@register("kafka_records", ids=("S4",), sql=with_fixtures(f"""
    SELECT 'user-actions' AS topic, event_type AS key, 'user_action' AS type, value AS amount,
           strftime(ts, {ISO_SQL}) AS timestamp
    FROM events
    UNION ALL
    SELECT 'price-alerts', symbol, 'price_alert', current_price, strftime(ts, {ISO_SQL}) FROM al""",
    "alert_rules", extra=[("al", _ALERTS_SQL)]))
def q_kafka_records(spark, sf_dir):
    """Records of two topics, written to their topic folders and read back by topic, key and type."""
    ev = Tables(spark, sf_dir).events.select(F.col("event_type").alias("action"), "ts",
                                             "user_id", "value")
    records = msg.user_actions(ev).unionByName(msg.price_alerts(_alerts(spark, sf_dir)))
    path = live.scratch(spark, "records")
    if not msg.write_records(records, "json", path=path):
        raise RuntimeError("the topics were not written")
    back = spark.read.schema("topic string, key string, value string").json(path)
    amount = F.coalesce(F.get_json_object("value", "$.details.value"), F.get_json_object("value", "$.current_price"))
    return back.select("topic", "key", field("type"), amount.cast("double").alias("amount"), field("timestamp"))


ACTION = "action string, details struct<user_id:bigint,value:double>, timestamp string, type string"


@register("topic_source", ids=("S6",), sql=f"""
    SELECT event_type AS key, event_type AS action, 'user_action' AS type, user_id, value,
           strftime(ts, {ISO_SQL}) AS timestamp
    FROM events""")
def q_topic_source(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.select(F.col("event_type").alias("action"), "ts",
                                             "user_id", "value")
    records = msg.user_actions(ev)
    return msg.decode(records, ACTION, ["user_action"]).select(
        "key", "msg.action", "msg.type", "msg.details.user_id", "msg.details.value", "msg.timestamp")


@register("live_bars", ids=("S9", "P5"), sql=with_fixtures(f"""
    SELECT upper(symbol) AS symbol, strftime(ts, {ISO_SQL}) AS timestamp, close
    FROM ob""", "ticks", extra=[("ob", _OHLCV_SQL)]))
def q_live_bars(spark, sf_dir):
    """Bar messages for every subscribed symbol: type and upper-cased symbol match."""
    t = ticks(spark, sf_dir)
    records = msg.ohlcv_messages(tk.ohlcv(t, "1 minute"))
    subscribed = t.select(F.upper("symbol").alias("symbol")).distinct()
    m = records.select(field("symbol"), field("type"), field("timestamp"),
                       field("close", "double"))
    m = m.filter(F.col("type") == "ohlcv_1min").withColumn("symbol", F.upper("symbol"))
    return m.join(subscribed, "symbol", "left_semi").select("symbol", "timestamp", "close")
