"""Driver tables -> the application's logical tables.

Each mapping is a deterministic DataFrame transformation of a driver table,
so every derived table grows with its source and everything downstream runs
on Spark at the same scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.functions.timecols import epoch_seconds, floor_time


# -- bars --------------------------------------------------------------------

def daily_bars(orders: DataFrame) -> DataFrame:
    """``orders`` -> daily bars: one symbol per order priority.

    Partial aggregation runs before the shuffle on (symbol, day), so a hot
    symbol costs one partial row per task and day, not one row per order.
    """
    return (orders
            .groupBy(F.col("o_orderpriority").alias("symbol"),
                     F.col("o_orderdate").alias("ts"))
            .agg(F.min_by("o_totalprice", "o_orderkey").alias("open"),
                 F.max("o_totalprice").alias("high"),
                 F.min("o_totalprice").alias("low"),
                 F.max_by("o_totalprice", "o_orderkey").alias("close"),
                 F.count(F.lit(1)).alias("volume")))


def orders_as_ticks(orders: DataFrame) -> DataFrame:
    """Each order is a trade of its priority symbol."""
    return orders.select(F.col("o_orderkey").alias("trade_id"),
                         F.col("o_orderpriority").alias("symbol"),
                         F.col("o_orderdate").alias("ts"),
                         F.col("o_totalprice").alias("price"),
                         F.lit(1).cast("bigint").alias("size"))


def events_as_ticks(events: DataFrame) -> DataFrame:
    """``events`` -> trades: symbol = event type, price = value, size = props.k."""
    return events.select(F.col("event_id").alias("trade_id"),
                         F.col("event_type").alias("symbol"),
                         F.col("ts"),
                         F.col("value").alias("price"),
                         F.get_json_object("props", "$.k").cast("bigint").alias("size"))


def bars_from_ticks(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """Trades -> bars per symbol and truncated time ``unit``.

    open / close are the prices of the first / last trade by (ts, trade_id).
    """
    order = F.struct("ts", "trade_id")
    return (ticks
            .groupBy("symbol", floor_time("ts", unit).alias("ts"))
            .agg(F.min_by("price", order).alias("open"),
                 F.max("price").alias("high"),
                 F.min("price").alias("low"),
                 F.max_by("price", order).alias("close"),
                 F.count(F.lit(1)).alias("volume")))


def hourly_bars(events: DataFrame) -> DataFrame:
    return bars_from_ticks(events_as_ticks(events), "hour")


def daily_history_source(orders: DataFrame) -> DataFrame:
    """A vendor-style daily history: OHLCV plus an adjusted close.

    ``adj_close`` is the mean price of the day's finished (status F) orders,
    null on days without one, so the cleaning step has real nulls to drop.
    """
    return (orders
            .groupBy(F.col("o_orderpriority").alias("symbol"),
                     F.col("o_orderdate").alias("ts"))
            .agg(F.min_by("o_totalprice", "o_orderkey").alias("open"),
                 F.max("o_totalprice").alias("high"),
                 F.min("o_totalprice").alias("low"),
                 F.max_by("o_totalprice", "o_orderkey").alias("close"),
                 F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
                  .alias("adj_close"),
                 F.count(F.lit(1)).alias("volume")))


# -- quotes, candles, alert rules ---------------------------------------------

def quotes_from_ticks(ticks: DataFrame, zero_symbol: str | None = None,
                      drop_symbol: str | None = None) -> DataFrame:
    """Per symbol: c = last trade price, pc = the one before (or c), ts = last time.

    ``zero_symbol`` gets c = 0 and ``drop_symbol`` no quote at all, which is
    what a quote service returns for a halted and for an unknown symbol.
    The top-2 per symbol is a window group limit: each task keeps two rows
    per symbol before the shuffle, however many trades a symbol has.
    """
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc(), F.col("trade_id").desc())
    last2 = ticks.select("symbol", "ts", "price", F.row_number().over(w).alias("rn")) \
                 .filter("rn <= 2")
    last = F.max(F.when(F.col("rn") == 1, F.col("price")))
    prev = F.max(F.when(F.col("rn") == 2, F.col("price")))
    q = last2.groupBy("symbol").agg(last.alias("c"), F.coalesce(prev, last).alias("pc"),
                                    F.max("ts").alias("ts"))
    if zero_symbol is not None:
        q = q.withColumn("c", F.when(F.col("symbol") == zero_symbol, F.lit(0.0))
                         .otherwise(F.col("c")))
    if drop_symbol is not None:
        q = q.filter(F.col("symbol") != drop_symbol)
    return q


def candles(bars: DataFrame, no_data_symbol: str | None = None) -> DataFrame:
    """Bars -> candle responses: one row per symbol and calendar year (one
    request's date range), parallel arrays, ``s`` status.  A response is
    bounded by the calendar (at most 366 entries)."""
    rows = F.array_sort(F.collect_list(F.struct(
        epoch_seconds("ts").alias("t"),
        "open", "high", "low", "close", F.col("volume").cast("double").alias("v"))))
    per = bars.groupBy("symbol", F.year("ts").alias("year")).agg(rows.alias("r"))
    status = F.lit("ok") if no_data_symbol is None else \
        F.when(F.col("symbol") == no_data_symbol, F.lit("no_data")).otherwise(F.lit("ok"))
    payload = F.struct(
        status.alias("s"),
        F.col("r.t").alias("t"), F.col("r.open").alias("o"), F.col("r.high").alias("h"),
        F.col("r.low").alias("l"), F.col("r.close").alias("c"), F.col("r.v").alias("v"))
    return per.select("symbol", F.to_json(payload).alias("payload"))


def alert_rules(ticks: DataFrame) -> DataFrame:
    """Per symbol: low / high = exact 5th / 95th percentile of the price.

    Spark's exact ``percentile`` buffers value -> count maps and merges them
    partially, so a symbol's state is bounded by its distinct prices (tick
    size times price range), not by its number of trades."""
    return ticks.groupBy("symbol").agg(
        F.percentile("price", 0.05).alias("low"),
        F.percentile("price", 0.95).alias("high"))


# -- event log ------------------------------------------------------------------

def _iso(ts_col: str) -> F.Column:
    return F.date_format(F.col(ts_col), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def event_log(events: DataFrame) -> DataFrame:
    """``events`` -> the event store's log.

    aggregate_id = 'U' || user_id; event type = emitted type number
    ``event_id % 9``; ``seq`` keeps the bigint id for a total order.
    """
    types = F.array(*[F.lit(t) for t in S.EMITTED_EVENT_TYPES])
    et = F.element_at(types, (F.col("event_id") % 9 + 1).cast("int"))
    k = F.get_json_object("props", "$.k")
    aid = F.concat(F.lit("A"), F.col("event_id").cast("string"))
    sym = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    extra = (F.when(et == S.ANALYSIS_REQUESTED,
                    F.lit(',"requester":"system","previous_status":"idle"'))
             .when(et == S.DATA_FETCHED,
                   F.concat(F.lit(',"data_info":{"data_points":'), k, F.lit("}")))
             .when(et == S.PREDICTION_COMPLETED,
                   F.concat(F.lit(',"predictions":{"k":'), k, F.lit("}")))
             .when(et == S.ANALYSIS_COMPLETED,
                   F.concat(F.lit(',"results":{"request_id":"'), aid, F.lit('","k":'), k,
                            F.lit('},"completion_timestamp":"'), _iso("ts"), F.lit('"')))
             .when(et == S.ANALYSIS_FAILED, F.lit(',"error":"stage failed"'))
             .otherwise(F.lit("")))
    data = F.concat(F.lit('{"analysis_id":"'), aid, F.lit('","symbol":"'), sym,
                    F.lit('"'), extra, F.lit("}"))
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        et.alias("event_type"),
        sym.alias("aggregate_id"),
        F.lit(S.AGGREGATE_TYPE).alias("aggregate_type"),
        data.alias("data"),
        F.lit("{}").alias("metadata"),
        F.col("ts").alias("timestamp"),
        F.lit(1).alias("version"),
        F.col("event_id").alias("seq"))


def commands(events: DataFrame) -> DataFrame:
    """Sign-ups are analysis requests for symbol 'U<user_id>'."""
    return (events.filter(F.col("event_type") == "signup")
            .select(F.col("event_id").cast("string").alias("command_id"),
                    F.lit("RequestAnalysis").alias("command_type"),
                    F.upper(F.concat(F.lit("u"), F.col("user_id").cast("string")))
                     .alias("aggregate_id"),
                    F.lit("{}").alias("data"),
                    F.lit("{}").alias("metadata"),
                    F.col("ts").alias("timestamp"),
                    F.lit(None).cast("string").alias("correlation_id"),
                    F.col("event_id").alias("seq")))


# Step written to the processing status by each event of the workflow.
STEP_OF_EVENT = {
    S.ANALYSIS_REQUESTED: "event_stored",
    S.ANALYSIS_STARTED: "fetching_data",
    S.DATA_FETCHED: "fetching_data",
    S.LSTM_TRAINING_STARTED: "training_lstm",
    S.LSTM_TRAINING_COMPLETED: "training_lstm",
    S.PREDICTION_STARTED: "generating_predictions",
    S.PREDICTION_COMPLETED: "completing_analysis",
    S.ANALYSIS_COMPLETED: "workflow_completed",
    S.ANALYSIS_FAILED: "workflow_failed",
}
STATUS_OF_STEP = {"workflow_completed": "completed", "workflow_failed": "error",
                  "request_failed": "error"}


def with_steps(log: DataFrame) -> DataFrame:
    """The log with the processing-status write of each event alongside
    (``step_status``, ``step``, ``step_analysis_id``, ``step_error``)."""
    step = F.create_map(*[x for kv in STEP_OF_EVENT.items() for x in map(F.lit, kv)])[
        F.col("event_type")]
    status = F.coalesce(
        F.create_map(*[x for kv in STATUS_OF_STEP.items() for x in map(F.lit, kv)])[step],
        F.lit("started"))
    return log.withColumns({
        "step_status": status, "step": step,
        "step_analysis_id": F.get_json_object("data", "$.analysis_id"),
        "step_error": F.when(F.col("event_type") == S.ANALYSIS_FAILED,
                             F.get_json_object("data", "$.error"))})


def step_log(log: DataFrame) -> DataFrame:
    """Event log -> processing-status writes, one per event."""
    return with_steps(log).select(
        F.col("aggregate_id").alias("symbol"), F.col("step_status").alias("status"), "step",
        F.col("step_analysis_id").alias("analysis_id"), F.col("step_error").alias("error"),
        F.col("timestamp").alias("ts"), F.col("seq"))


def committed_log(log: DataFrame) -> DataFrame:
    """The log as acknowledged by the broker: every tenth event never arrived."""
    return log.filter(F.col("seq") % 10 != 0)
