"""Registered queries over sources, predicates and symbol sets (S1-S3, S8, S10,
P1, P6-P9, U2, scalar functions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.functions.timecols import epoch_seconds
from tickflow.operators import indicators as ind
from tickflow.plans.market_queries import bars, order_quotes
from tickflow.plans.oracle import with_fixtures
from tickflow.plans.registry import register, rounded
from tickflow.sources import fixtures as fx
from tickflow.sources import history as hist
from tickflow.sources.tables import Tables

NO_DATA_SYMBOL = "3-MEDIUM"
_LISTING_SQL = "(VALUES " + ", ".join(
    "('{}', '{}')".format(s, n.replace("'", "''")) for s, n in S.SYMBOL_LIST) + ") AS l(symbol, name)"


@register("candles_explode", ids=("S1",), sql=with_fixtures(f"""
    SELECT symbol, ts, open, high, low, close, CAST(volume AS DOUBLE) AS volume
    FROM bars WHERE symbol <> '{NO_DATA_SYMBOL}'""", "bars"))
def q_candles_explode(spark, sf_dir):
    return hist.candles_to_bars(fx.candles(bars(spark, sf_dir), NO_DATA_SYMBOL))


@register("daily_bars_clean", ids=("S2", "P2", "P3", "P4"), sql=with_fixtures("""
    SELECT symbol, ts, open, high, low, round(adj_close, 6) AS close, volume
    FROM history_src
    WHERE symbol IS NOT NULL AND ts IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL
      AND low IS NOT NULL AND close IS NOT NULL AND adj_close IS NOT NULL
      AND volume IS NOT NULL""", "history_src"))
def q_daily_bars_clean(spark, sf_dir):
    src = fx.daily_history_source(Tables(spark, sf_dir).orders)
    return rounded(hist.clean_daily_history(src))


#: The moment at which all sources are read ("now" of the request).
FALLBACK_ASOF = "2001-08-02"


def _fallback_candidates(orders):
    """Three sources cut at the same moment.  The first (orders still open) lacks one symbol and is too short for
    others; no source has the last symbol."""
    served = orders.filter(F.col("o_orderpriority") != "5-LOW")
    open_ = served.filter((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") != "2-HIGH"))
    every = fx.daily_bars(served)
    return [(hist.last_n_days(fx.daily_bars(open_), 730, FALLBACK_ASOF), S.MIN_ROWS),
            (hist.last_n_days(every, 730, FALLBACK_ASOF), 1),
            (hist.last_n_days(every, 365, FALLBACK_ASOF), 1)]


_FALLBACK_SQL = with_fixtures(f"""
    SELECT c.symbol, c.ts, c.open, c.high, c.low, c.close, c.volume,
           c.priority AS source_priority
    FROM cand c JOIN (SELECT symbol, min(priority) AS priority
                      FROM (SELECT symbol, priority, count(*) AS n, max(m) AS m
                            FROM cand GROUP BY 1, 2) x
                      WHERE n >= m GROUP BY symbol) b
      ON c.symbol = b.symbol AND c.priority = b.priority""", "bars", extra=[
    ("pbars", """
        SELECT o_orderpriority AS symbol, o_orderdate AS ts,
               arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
               min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
               count(*) AS volume
        FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority NOT IN ('2-HIGH', '5-LOW') GROUP BY 1, 2"""),
    ("cand", f"""
        SELECT p.*, 0 AS priority, {S.MIN_ROWS} AS m FROM pbars p
          WHERE ts >= TIMESTAMP '{FALLBACK_ASOF}' - INTERVAL 730 DAY
        UNION ALL
        SELECT b.*, 1, 1 FROM bars b
          WHERE symbol <> '5-LOW' AND ts >= TIMESTAMP '{FALLBACK_ASOF}' - INTERVAL 730 DAY
        UNION ALL
        SELECT b.*, 2, 1 FROM bars b
          WHERE symbol <> '5-LOW' AND ts >= TIMESTAMP '{FALLBACK_ASOF}' - INTERVAL 365 DAY""")])


@register("source_fallback", ids=("S3", "P7"), sql=_FALLBACK_SQL)
def q_source_fallback(spark, sf_dir):
    return hist.source_fallback(_fallback_candidates(Tables(spark, sf_dir).orders))


@register("history_from_messages", ids=("S8", "P5", "L3"), sql=with_fixtures("""
    SELECT upper(symbol) AS symbol, ts, open, high, low, close, volume
    FROM bars b
    WHERE year(ts) = (SELECT min(year(ts)) FROM bars c WHERE c.symbol = b.symbol)""", "bars"))
def q_history_from_messages(spark, sf_dir):
    msgs = hist.history_messages(bars(spark, sf_dir))
    return hist.history_from_messages(msgs)


@register("symbols_dim", ids=("S10",), sql=f"""
    SELECT s.symbol, coalesce(l.name, s.symbol) AS name,
           s.symbol || ' - ' || coalesce(l.name, s.symbol) AS display
    FROM (SELECT DISTINCT o_orderpriority AS symbol FROM orders) s
    LEFT JOIN {_LISTING_SQL} ON s.symbol = l.symbol""")
def q_symbols_dim(spark, sf_dir):
    return hist.symbols_dim(spark, bars(spark, sf_dir))


@register("subscribed_symbols", ids=("U2",), sql="SELECT DISTINCT event_type AS symbol FROM events")
def q_subscribed_symbols(spark, sf_dir):
    return hist.subscribed_symbols(fx.events_as_ticks(Tables(spark, sf_dir).events))


@register("symbol_upper", ids=("P1",), sql="""
    SELECT upper(event_type) AS symbol, count(*) AS n FROM events GROUP BY 1""")
def q_symbol_upper(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    return ev.groupBy(F.upper("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@register("bars_last_n_days", ids=("P6",), sql=with_fixtures("""
    SELECT b.* FROM bars b
    WHERE ts >= (SELECT max(ts) FROM bars q WHERE q.symbol = b.symbol) - INTERVAL 730 DAY""",
    "bars"))
def q_bars_last_n_days(spark, sf_dir):
    return hist.last_n_days(bars(spark, sf_dir), 730)


@register("min_rows_gate", ids=("P7",), sql=with_fixtures("""
    SELECT * FROM bars_1h
    WHERE symbol IN (SELECT symbol FROM bars_1h GROUP BY symbol HAVING count(*) >= 100)""",
    "bars_1h"))
def q_min_rows_gate(spark, sf_dir):
    return hist.min_rows_gate(fx.hourly_bars(Tables(spark, sf_dir).events), S.MIN_ROWS)


@register("valid_symbols", ids=("P8",), sql=with_fixtures(f"""
    SELECT DISTINCT symbol FROM order_ticks
    WHERE symbol IN (SELECT symbol FROM quotes_o WHERE c IS NOT NULL AND c > 0)
       OR symbol IN (SELECT symbol FROM {_LISTING_SQL})""", "quotes_o"))
def q_valid_symbols(spark, sf_dir):
    ticks = fx.orders_as_ticks(Tables(spark, sf_dir).orders)
    return hist.valid_symbols(ticks, order_quotes(spark, sf_dir), hist.listing(spark))


def current_with_default(requests, current):
    """Requested symbols joined to their current data, the fallback row when missing."""
    d = S.FALLBACK_CURRENT_DATA
    j = requests.select("symbol").distinct().join(current, "symbol", "left")
    have = F.col("current_price").isNotNull()
    return j.select(
        "symbol",
        F.coalesce("current_price", F.lit(d["current_price"])).alias("current_price"),
        F.coalesce("change", F.lit(d["change"])).alias("change"),
        F.coalesce("change_pct", F.lit(d["change_pct"])).alias("change_pct"),
        F.coalesce("volume", F.lit(d["volume"]).cast("bigint")).alias("volume"),
        F.when(have, F.col("data_source")).otherwise(F.lit(d["source"])).alias("source"))


@register("current_data_with_default", ids=("P9",), sql=with_fixtures("""
    SELECT r.symbol, coalesce(c.current_price, 100.0) AS current_price,
           coalesce(c.change, 0.0) AS change, coalesce(c.change_pct, 0.0) AS change_pct,
           coalesce(c.volume, CAST(1000000 AS BIGINT)) AS volume,
           CASE WHEN c.current_price IS NOT NULL THEN 'hybrid_lstm_only' ELSE 'fallback' END
             AS source
    FROM (SELECT o_orderpriority AS symbol FROM orders UNION
          SELECT event_type FROM events) r
    LEFT JOIN (SELECT symbol, round(close, 6) AS current_price,
                      round(close - prev, 6) AS change,
                      round(CASE WHEN prev <> 0 THEN (close - prev) / prev * 100 ELSE 0.0 END, 6)
                        AS change_pct, volume
               FROM (SELECT symbol, close, volume,
                            coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), close) AS prev,
                            row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn
                     FROM bars) x WHERE rn = 1) c
      ON r.symbol = c.symbol""", "bars"))
def q_current_data_with_default(spark, sf_dir):
    t = Tables(spark, sf_dir)
    requests = (t.orders.select(F.col("o_orderpriority").alias("symbol"))
                .unionByName(t.events.select(F.col("event_type").alias("symbol"))))
    cur = ind.current_data(bars(spark, sf_dir), None, digits=6)
    return current_with_default(requests, cur)


@register("scalar_format", ids=("2.8",), sql=with_fixtures("""
    SELECT upper(symbol) AS symbol_upper, strftime(ts, '%Y-%m-%d') AS date,
           strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(epoch(ts) AS BIGINT) AS epoch,
           ts + INTERVAL 1 DAY AS next_day,
           'LSTM-' || symbol AS metrics_key,
           printf('Analysis for %s is still running', symbol) AS message,
           round(close, 2) AS close_2, round(sqrt(abs(close - open)), 6) AS sqrt_abs,
           round(pow(close / open, 2), 6) AS ratio_sq, CAST(volume AS INTEGER) AS volume_int
    FROM bars""", "bars"))
def q_scalar_format(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.select(
        F.upper("symbol").alias("symbol_upper"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        epoch_seconds("ts").alias("epoch"),
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("next_day"),
        F.concat_ws("-", F.lit(S.MODEL_LABEL_METRICS), "symbol").alias("metrics_key"),
        F.format_string(S.MSG_NOT_READY, "symbol").alias("message"),
        F.round("close", 2).alias("close_2"),
        F.round(F.sqrt(F.abs(F.col("close") - F.col("open"))), 6).alias("sqrt_abs"),
        F.round(F.pow(F.col("close") / F.col("open"), 2), 6).alias("ratio_sq"),
        F.col("volume").cast("int").alias("volume_int"))


@register("json_roundtrip", ids=("2.8",), sql=with_fixtures("""
    SELECT symbol, ts,
           '{"symbol":"' || symbol || '","volume":' || volume || ',"date":"' ||
             strftime(ts, '%Y-%m-%d') || '"}' AS value,
           close, volume
    FROM bars""", "bars"))
def q_json_roundtrip(spark, sf_dir):
    b = bars(spark, sf_dir)
    value = F.to_json(F.struct("symbol", "volume",
                               F.date_format("ts", "yyyy-MM-dd").alias("date"),
                               "close"))
    decoded = F.from_json(value, "symbol string, volume bigint, date string, close double")
    enc = b.select("symbol", "ts", decoded.alias("d"))
    out = F.to_json(F.struct("d.symbol", "d.volume", "d.date"))
    return enc.select("symbol", "ts", out.alias("value"), F.col("d.close").alias("close"),
                      F.col("d.volume").alias("volume"))
