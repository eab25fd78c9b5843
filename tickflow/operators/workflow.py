"""The analysis workflow as one batch job for all requested symbols
(C2, C3, C7, U1, A10).

The application runs fetch -> train -> forecast -> complete one symbol at a
time and appends eight events per success.  Here the whole request set is
one plan: bars -> training set -> per-symbol fit -> scores and metrics ->
Monte-Carlo forecast -> documents, joined per symbol, and each symbol's
outcome selects its event sequence (the failure branch stops at the failing
stage and appends AnalysisFailed).  The shuffles are on ``symbol``; nothing
goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.operators import forecast as fc
from tickflow.operators import indicators as ind
from tickflow.operators.events import deterministic_id
from tickflow.operators.messages import JSON_OPTIONS, iso

ERR_FETCH, ERR_TRAIN, ERR_PREDICT = S.ERR_FETCH, S.ERR_TRAIN, S.ERR_PREDICT


def outcomes(requests: DataFrame, bars: DataFrame, window: int = S.WINDOW_SIZE,
             min_samples: int = S.MIN_ROWS) -> DataFrame:
    """Per requested symbol: bar count, date range and the stage flags."""
    info = (bars.groupBy("symbol")
            .agg(F.count(F.lit(1)).alias("data_points"), F.min("ts").alias("start"),
                 F.max("ts").alias("end")))
    j = requests.select("symbol").distinct().join(info, "symbol", "left")
    n = F.coalesce(F.col("data_points"), F.lit(0))
    return (j.withColumn("data_points", n)
            .withColumn("has_data", n > 0)
            .withColumn("trained", (n - window) >= min_samples)
            .withColumn("predicted", F.col("trained") & (n >= window)))


def _event(seq: int, event_type: str, keep: Column, error: Column | None = None) -> Column:
    return F.struct(F.lit(seq).alias("seq"), F.lit(event_type).alias("event_type"),
                    keep.alias("keep"),
                    (error if error is not None else F.lit(None).cast("string")).alias("error"))


def event_plan(out: DataFrame) -> DataFrame:
    """Outcome flags -> the ordered event types of each symbol's run.

    Success: Requested, Started, DataFetched, TrainingStarted,
    TrainingCompleted, PredictionStarted, PredictionCompleted, Completed.
    A failing stage ends the run with AnalysisFailed.
    """
    d, t, p = F.col("has_data"), F.col("trained"), F.col("predicted")
    yes = F.lit(True)
    steps = F.array(
        _event(1, S.ANALYSIS_REQUESTED, yes),
        _event(2, S.ANALYSIS_STARTED, yes),
        _event(3, S.DATA_FETCHED, d),
        _event(4, S.LSTM_TRAINING_STARTED, d),
        _event(5, S.LSTM_TRAINING_COMPLETED, d & t),
        _event(6, S.PREDICTION_STARTED, d & t),
        _event(7, S.PREDICTION_COMPLETED, d & t & p),
        _event(8, S.ANALYSIS_COMPLETED, d & t & p),
        _event(9, S.ANALYSIS_FAILED, ~(d & t & p),
               F.when(~d, F.lit(ERR_FETCH)).when(~t, F.lit(ERR_TRAIN))
               .otherwise(F.lit(ERR_PREDICT))))
    kept = F.filter(steps, lambda e: e["keep"])
    return (out.select("*", F.posexplode(kept).alias("pos", "e"))
            .select("*", (F.col("pos") + 1).alias("seq"), F.col("e.event_type").alias("event_type"),
                    F.col("e.error").alias("error"))
            .drop("pos", "e"))


def documents(bars: DataFrame, quotes: DataFrame | None, coefs: DataFrame,
              seed: int = 42, training: DataFrame | None = None) -> DataFrame:
    """Per symbol: current data, metrics, forecast document (JSON columns).
    ``training`` is the training set the coefficients were fitted on (built
    from ``bars`` when not given)."""
    ts = training if training is not None else fc.training_set(bars)
    metrics = fc.forecast_metrics(fc.score_windows(ts, coefs))
    mpiv = metrics.groupBy("symbol").agg(
        *[F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
          for s in ("train", "test") for c in ("mae", "rmse")],
        F.sum("samples").alias("data_points"))
    doc = fc.prediction_document(fc.forecast(bars, coefs, seed=seed))
    cur = ind.current_data(bars, quotes, digits=2)
    cur_json = cur.select("symbol", F.to_json(F.struct(*cur.columns), JSON_OPTIONS)
                          .alias("current_json"), F.col("last_updated"))
    preds = doc.select("symbol", F.to_json(F.struct(
        F.struct("dates", "prices", "lower_bound", "upper_bound").alias("lstm_predictions"),
        F.lit(None).cast("string").alias("prophet_predictions")), JSON_OPTIONS)
        .alias("predictions_json"))
    met = mpiv.select("symbol", F.to_json(F.struct(*[c for c in mpiv.columns if c != "symbol"]),
                                          JSON_OPTIONS).alias("metrics_json"))
    return cur_json.join(preds, "symbol", "left").join(met, "symbol", "left")


def analysis_id(symbol: Column, asof: Column) -> Column:
    """Replay-stable analysis id of a request (symbol, request time)."""
    return deterministic_id(F.lit("analysis"), symbol, asof.cast("string"))


def result_documents(requests: DataFrame, bars: DataFrame, quotes: DataFrame | None, coefs: DataFrame, asof: str,
                     seed: int = 42, digits: int = 2) -> DataFrame:
    """The result document (one struct per symbol) of every requested analysis that completes.

    Data and forecast are the symbol's own; the trained flag says whether the
    symbol has fitted coefficients.  A symbol without current data gets the
    fallback row, one without coefficients no forecast.
    """
    done = outcomes(requests, bars).filter("predicted").select("symbol")
    fitted = coefs.select("symbol").distinct().withColumn("_lstm", F.lit(True))
    doc = fc.prediction_document(fc.forecast(bars, coefs, seed=seed)).select(
        "symbol", F.struct("dates", "prices", "lower_bound", "upper_bound").alias("_lstm_predictions"))
    cur = ind.current_data(bars, quotes, digits=digits)
    data_fields = ["current_price", "change", "change_pct", "volume", F.col("data_source").alias("source")]
    cur = cur.select("symbol", F.struct("symbol", *data_fields).alias("_data"))
    default = S.FALLBACK_CURRENT_DATA | {"volume": F.lit(S.FALLBACK_CURRENT_DATA["volume"]).cast("bigint")}
    fallback = F.struct("symbol", *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in default.items()])
    j = done.join(cur, "symbol", "left").join(doc, "symbol", "left").join(fitted, "symbol", "left")
    at = F.lit(asof).cast("timestamp_ntz")
    return j.select("symbol", F.struct(
        analysis_id(F.col("symbol"), at).alias("request_id"), F.col("symbol"), F.lit("completed").alias("status"),
        iso(at).alias("timestamp"), F.lit(S.MODEL_TYPE_RESULT).alias("model_type"), F.coalesce("_data", fallback).alias("data"),
        F.struct(F.col("_lstm_predictions").alias("lstm_predictions"), F.lit(None).cast("string").alias("prophet_predictions")).alias("predictions"),
        F.struct(F.coalesce("_lstm", F.lit(False)).alias("lstm"), F.lit(False).alias("prophet")).alias("models_trained")).alias("document"))


def workflow_events(requests: DataFrame, bars: DataFrame, quotes: DataFrame | None,
                    coefs: DataFrame, asof: str,
                    training: DataFrame | None = None) -> DataFrame:
    """The event log of one analysis per requested symbol, all
    requested at ``asof`` (a timestamp literal: no wall clock)."""
    out = outcomes(requests, bars)
    plan = event_plan(out)
    docs = documents(bars, quotes, coefs, training=training)
    j = plan.join(docs, "symbol", "left")
    request_ts = F.lit(asof).cast("timestamp_ntz")
    aid = analysis_id(F.col("symbol"), request_ts)
    base = F.concat(F.lit('{"symbol":"'), F.col("symbol"), F.lit('","analysis_id":"'), aid,
                    F.lit('"'))
    data_info = F.to_json(F.struct(
        "data_points", F.struct(iso("start").alias("start"), iso("end").alias("end"))
        .alias("date_range"),
        F.array(*[F.lit(c) for c in ("Open", "High", "Low", "Close", "Volume")]).alias("columns")))
    et = F.col("event_type")
    results = F.concat(
        F.lit('{"request_id":"'), aid, F.lit('","symbol":"'), F.col("symbol"),
        F.lit('","status":"completed","model_type":"'), F.lit(S.MODEL_TYPE_RESULT),
        F.lit('","data":'), F.coalesce("current_json", F.lit("null")),
        F.lit(',"predictions":'), F.coalesce("predictions_json", F.lit("null")),
        F.lit(',"models_trained":{"lstm":true,"prophet":false}}'))
    extra = (F.when(et == S.ANALYSIS_REQUESTED,
                    F.lit(',"requester":"system","options":{},"previous_status":"idle"'))
             .when(et == S.DATA_FETCHED, F.concat(F.lit(',"data_info":'), data_info))
             .when(et == S.LSTM_TRAINING_COMPLETED,
                   F.concat(F.lit(',"metrics":'), F.coalesce("metrics_json", F.lit("{}"))))
             .when(et == S.PREDICTION_COMPLETED,
                   F.concat(F.lit(',"predictions":'), F.coalesce("predictions_json",
                                                                 F.lit("null"))))
             .when(et == S.ANALYSIS_COMPLETED,
                   F.concat(F.lit(',"results":'), results, F.lit(',"completion_timestamp":"'),
                            iso(request_ts), F.lit('"')))
             .when(et == S.ANALYSIS_FAILED,
                   F.concat(F.lit(',"error":"'), F.col("error"), F.lit('"')))
             .otherwise(F.lit("")))
    return j.select(
        deterministic_id(aid, F.col("seq").cast("string")).alias("event_id"),
        "event_type", F.col("symbol").alias("aggregate_id"),
        F.lit(S.AGGREGATE_TYPE).alias("aggregate_type"),
        F.concat(base, extra, F.lit("}")).alias("data"), F.lit("{}").alias("metadata"),
        request_ts.alias("timestamp"), F.lit(1).alias("version"), F.col("seq").cast("bigint"),
        "error", "data_points")


def chart_series(bars: DataFrame, fcst: DataFrame, history: int = 200) -> DataFrame:
    """Last ``history`` closes plus forecast and band as one series table."""
    hist = ind.tail_n(bars, history).select(
        "symbol", F.lit("historical").alias("series"), F.to_date("ts").alias("date"),
        F.round("close", 2).alias("price"))
    fut = fcst.select("symbol", F.lit("forecast").alias("series"), "date",
                      F.col("prediction").alias("price"), "lower", "upper")
    return hist.unionByName(fut, allowMissingColumns=True)


def model_performance(bars: DataFrame, coefs, metrics: DataFrame) -> DataFrame:
    """A10: per symbol, trained flag, data points and the latest metrics.
    A symbol counts as trained when it has coefficients (a fitted table) or,
    for a fixed model, when it had enough samples to be scored."""
    info = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("data_points"))
    m = metrics.groupBy("symbol").agg(
        *[F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
          for s in ("train", "test") for c in ("mae", "rmse")])
    fitted = coefs if isinstance(coefs, DataFrame) else metrics
    trained = fitted.select("symbol").distinct().withColumn("lstm_trained", F.lit(True))
    j = info.join(trained, "symbol", "left").join(m, "symbol", "left")
    return j.select("symbol", F.coalesce("lstm_trained", F.lit(False)).alias("lstm_trained"),
                    F.lit(False).alias("prophet_trained"), "data_points",
                    "train_mae", "test_mae", "train_rmse", "test_rmse",
                    F.lit(S.DATA_SOURCE_PERFORMANCE).alias("data_source"))
