"""Registered workflow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.operators import forecast as fc
from tickflow.operators import indicators as ind
from tickflow.operators import workflow as wf
from tickflow.plans.forecast_queries import FC_SQL, SCORES_SQL, _TR_EXTRA, _paths_with_ctes
from tickflow.plans.forecast_queries import BAND_SQL
from tickflow.plans.market_queries import _CURRENT_SQL, bars, order_quotes
from tickflow.plans.oracle import with_fixtures
from tickflow.plans.registry import register
from tickflow.sources import fixtures as fx
from tickflow.sources import history as hist
from tickflow.session import materialize
from tickflow.sources.tables import Tables

ASOF = "2001-08-02 00:00:00"
_LISTING = ", ".join(f"('{s}')" for s, _ in S.SYMBOL_LIST)


def workflow_inputs(spark, sf_dir, materialized: bool = False):
    """Requests: the order-priority symbols (enough daily bars), the event types
    (thirty daily bars: training fails) and the listing (no bars: fetch fails).
    ``materialized`` computes the bars once for a job with many branches."""
    t = Tables(spark, sf_dir)
    ob = fx.daily_bars(t.orders)
    eb = fx.bars_from_ticks(fx.events_as_ticks(t.events), "day") \
        .withColumn("symbol", F.upper("symbol"))
    all_bars = ob.unionByName(eb)
    if materialized:
        all_bars = materialize(all_bars)
    requests = (all_bars.select("symbol")
                .unionByName(hist.listing(spark).select("symbol")).distinct())
    return requests, all_bars


_FLAGS_SQL = f"""
    SELECT r.symbol, count(b.symbol) AS data_points
    FROM (SELECT o_orderpriority AS symbol FROM orders
          UNION SELECT upper(event_type) FROM events
          UNION SELECT * FROM (VALUES {_LISTING}) l(symbol)) r
    LEFT JOIN (SELECT o_orderpriority AS symbol FROM orders GROUP BY o_orderpriority, o_orderdate
               UNION ALL
               SELECT upper(event_type) FROM events GROUP BY upper(event_type), date_trunc('day', ts)) b
      ON r.symbol = b.symbol
    GROUP BY r.symbol"""

_STEPS = [(1, S.ANALYSIS_REQUESTED, "TRUE"), (2, S.ANALYSIS_STARTED, "TRUE"),
          (3, S.DATA_FETCHED, "d"), (4, S.LSTM_TRAINING_STARTED, "d"),
          (5, S.LSTM_TRAINING_COMPLETED, "d AND t"), (6, S.PREDICTION_STARTED, "d AND t"),
          (7, S.PREDICTION_COMPLETED, "d AND t AND p"), (8, S.ANALYSIS_COMPLETED, "d AND t AND p")]
_STEPS_SQL = "\n UNION ALL ".join(
    f"SELECT symbol, data_points, {k} AS k, '{e}' AS event_type, CAST(NULL AS VARCHAR) AS error "
    f"FROM fl WHERE {c}" for k, e, c in _STEPS) + f"""
 UNION ALL SELECT symbol, data_points, 9, '{S.ANALYSIS_FAILED}',
       CASE WHEN NOT d THEN '{wf.ERR_FETCH}' WHEN NOT t THEN '{wf.ERR_TRAIN}'
            ELSE '{wf.ERR_PREDICT}' END
 FROM fl WHERE NOT (d AND t AND p)"""


@register("workflow_events", ids=("C2", "C3"), sql=with_fixtures("""
    SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY k) AS seq, event_type,
           error, data_points
    FROM steps""", extra=[
    ("fl0", _FLAGS_SQL),
    ("fl", f"""SELECT symbol, data_points, data_points > 0 AS d,
                     data_points - {S.WINDOW_SIZE} >= {S.MIN_ROWS} AS t,
                     data_points - {S.WINDOW_SIZE} >= {S.MIN_ROWS}
                       AND data_points >= {S.WINDOW_SIZE} AS p FROM fl0"""),
    ("steps", _STEPS_SQL)]))
def q_workflow_events(spark, sf_dir):
    requests, all_bars = workflow_inputs(spark, sf_dir)
    plan = wf.event_plan(wf.outcomes(requests, all_bars))
    return plan.select("symbol", F.col("seq").cast("bigint").alias("seq"), "event_type",
                       "error", "data_points")


@register("workflow_event_log", ids=("C2", "C3", "M2", "S7"))
def q_workflow_event_log(spark, sf_dir):
    """The full run: fitted models, forecasts and documents in the payloads."""
    # bars and coefficients feed several branches: compute each once
    requests, all_bars = workflow_inputs(spark, sf_dir, materialized=True)
    training = fc.training_set(all_bars)
    coefs = materialize(fc.fit_linear(training))
    return wf.workflow_events(requests, all_bars, order_quotes(spark, sf_dir), coefs, ASOF,
                              training=training)


_C7_BODY = f"""
    SELECT d.symbol, substr(sha256('analysis|' || d.symbol || '|{ASOF}'), 1, 32) AS request_id,
           'completed' AS status, '{S.MODEL_TYPE_RESULT}' AS model_type,
           c.current_price, c.change, c.is_real_time,
           d.n_days, d.first_date, d.last_date, d.prices_sum, TRUE AS lstm_trained
    FROM (SELECT symbol, count(*) AS n_days, min(strftime(date, '%Y-%m-%d')) AS first_date,
                 max(strftime(date, '%Y-%m-%d')) AS last_date,
                 round(sum(round(prediction, 2)), 2) AS prices_sum
          FROM fc GROUP BY symbol) d
    JOIN ({_CURRENT_SQL}) c ON c.symbol = d.symbol"""
_FC_EXTRA = [("band", BAND_SQL.replace("FROM paths", "FROM paths_all")), ("fc", FC_SQL)]


@register("result_document", ids=("C7",), sql=_paths_with_ctes(_C7_BODY, _FC_EXTRA))
def q_result_document(spark, sf_dir):
    b = materialize(bars(spark, sf_dir))  # read by four branches
    doc = fc.prediction_document(fc.forecast(b, fc.fixed_model()))
    cur = ind.current_data(b, order_quotes(spark, sf_dir), digits=6)
    total = F.round(F.aggregate("prices", F.lit(0.0), lambda a, x: a + x), 2)
    j = doc.join(cur, "symbol")
    return j.select(
        "symbol", wf.analysis_id(F.col("symbol"), F.lit(ASOF)).alias("request_id"),
        F.lit("completed").alias("status"), F.lit(S.MODEL_TYPE_RESULT).alias("model_type"),
        "current_price", "change", "is_real_time",
        F.size("dates").cast("bigint").alias("n_days"),
        F.element_at("dates", 1).alias("first_date"),
        F.element_at("dates", -1).alias("last_date"),
        total.alias("prices_sum"), F.lit(True).alias("lstm_trained"))


@register("result_documents", ids=("C7", "M2", "P9"), sql=f"""
    WITH fl AS ({_FLAGS_SQL}), cur AS ({_CURRENT_SQL}),
    ends AS (SELECT o_orderpriority AS symbol, max(o_orderdate) AS last_ts FROM orders GROUP BY 1)
    SELECT fl.symbol, substr(sha256('analysis|' || fl.symbol || '|{ASOF}'), 1, 32) AS request_id, 'completed' AS status,
           '{S.MODEL_TYPE_RESULT}' AS model_type, c.current_price, c.change, c.change_pct, c.volume, 'hybrid_lstm_only' AS source,
           CAST({S.DAYS_AHEAD} AS BIGINT) AS n_days, strftime(e.last_ts + INTERVAL 1 DAY, '%Y-%m-%d') AS first_date,
           strftime(e.last_ts + INTERVAL {S.DAYS_AHEAD} DAY, '%Y-%m-%d') AS last_date, TRUE AS in_band,
           TRUE AS lstm_trained, FALSE AS prophet_trained
    FROM fl JOIN cur c ON c.symbol = fl.symbol JOIN ends e ON e.symbol = fl.symbol
    WHERE fl.data_points - {S.WINDOW_SIZE} >= {S.MIN_ROWS}""")
def q_result_documents(spark, sf_dir):
    """Documents of every analysis that completes, forecast by the fitted models:
    the fields that do not depend on the coefficients, and that the band holds its bounds."""
    requests, all_bars = workflow_inputs(spark, sf_dir, materialized=True)
    coefs = materialize(fc.fit_linear(fc.training_set(all_bars)))
    docs = wf.result_documents(requests, all_bars, order_quotes(spark, sf_dir), coefs, ASOF, digits=6)
    p, d = "document.predictions.lstm_predictions", "document.data"
    band = F.arrays_zip(F.col(f"{p}.lower_bound").alias("lo"), F.col(f"{p}.upper_bound").alias("hi"))
    return docs.select(
        "symbol", "document.request_id", "document.status", "document.model_type",
        *[F.col(f"{d}.{c}").alias(c) for c in ("current_price", "change", "change_pct", "volume", "source")],
        F.size(f"{p}.dates").cast("bigint").alias("n_days"), F.element_at(f"{p}.dates", 1).alias("first_date"),
        F.element_at(f"{p}.dates", -1).alias("last_date"), F.forall(band, lambda x: x["lo"] <= x["hi"]).alias("in_band"),
        F.col("document.models_trained.lstm").alias("lstm_trained"), F.col("document.models_trained.prophet").alias("prophet_trained"))


@register("chart_series", ids=("U1",), sql=_paths_with_ctes("""
    SELECT symbol, 'historical' AS series, CAST(ts AS DATE) AS date, round(close, 2) AS price,
           CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) h
    WHERE rn <= 200
    UNION ALL
    SELECT symbol, 'forecast', date, round(prediction, 6), round(lower, 6), round(upper, 6)
    FROM fc""", _FC_EXTRA))
def q_chart_series(spark, sf_dir):
    b = materialize(bars(spark, sf_dir))  # read by four branches
    f = fc.forecast(b, fc.fixed_model())
    f = f.select("symbol", "step", "date", *[F.round(c, 6).alias(c)
                                             for c in ("prediction", "lower", "upper")])
    return wf.chart_series(b, f, 200)


@register("model_performance", ids=("A10",), sql=with_fixtures("""
    SELECT i.symbol, TRUE AS lstm_trained, FALSE AS prophet_trained, i.data_points,
           m.train_mae, m.test_mae, m.train_rmse, m.test_rmse, 'lstm_only' AS data_source
    FROM (SELECT symbol, count(*) AS data_points FROM bars GROUP BY symbol) i
    JOIN (SELECT symbol,
                 round(avg(abs(actual - prediction)) FILTER (WHERE split = 'train'), 4) AS train_mae,
                 round(avg(abs(actual - prediction)) FILTER (WHERE split = 'test'), 4) AS test_mae,
                 round(sqrt(avg((actual - prediction) * (actual - prediction))
                            FILTER (WHERE split = 'train')), 4) AS train_rmse,
                 round(sqrt(avg((actual - prediction) * (actual - prediction))
                            FILTER (WHERE split = 'test')), 4) AS test_rmse
          FROM sco GROUP BY symbol) m ON i.symbol = m.symbol""",
    "bars", extra=_TR_EXTRA + [("sco", SCORES_SQL)]))
def q_model_performance(spark, sf_dir):
    b = bars(spark, sf_dir)
    ts = fc.training_set(b)
    coefs = fc.fixed_model()
    m = fc.forecast_metrics(fc.score_windows(ts, coefs))
    m = m.select("symbol", "split", *[F.round(c, 4).alias(c) for c in ("mae", "rmse")])
    return wf.model_performance(b, coefs, m)
