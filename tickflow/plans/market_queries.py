"""Registered queries over bars: indicators, last rows, history views."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickflow.operators import indicators as ind
from tickflow.plans.oracle import full_sql, lag_sql, ret_sql, with_fixtures
from tickflow.plans.registry import register, rounded
from tickflow.sources import fixtures as fx
from tickflow.sources.tables import Tables

SQRT252 = repr(math.sqrt(252))


def bars(spark, sf_dir):
    return fx.daily_bars(Tables(spark, sf_dir).orders)


def order_quotes(spark, sf_dir):
    return fx.quotes_from_ticks(fx.orders_as_ticks(Tables(spark, sf_dir).orders),
                                zero_symbol="2-HIGH", drop_symbol="5-LOW")


def _r(expr: str, alias: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {alias}"


@register("moving_averages", ids=("W1", "L5"), sql=with_fixtures(f"""
    SELECT symbol, ts, round(close, 6) AS close,
           {_r(full_sql('avg', 'close', 5), 'ma_5')},
           {_r(full_sql('avg', 'close', 20), 'ma_20')},
           {_r(full_sql('avg', 'close', 50), 'ma_50')}
    FROM bars""", "bars"))
def q_moving_averages(spark, sf_dir):
    return rounded(ind.moving_averages(bars(spark, sf_dir)))


@register("daily_returns", ids=("W2",), sql=with_fixtures(f"""
    SELECT symbol, ts, round(close, 6) AS close, {_r(ret_sql(), 'daily_return', 8)},
           {_r(ret_sql() + ' * 100', 'change_pct')}
    FROM bars""", "bars"))
def q_daily_returns(spark, sf_dir):
    df = ind.daily_returns(bars(spark, sf_dir))
    return df.select("symbol", "ts", F.round("close", 6).alias("close"),
                     F.round("daily_return", 8).alias("daily_return"),
                     F.round("change_pct", 6).alias("change_pct"))


@register("price_change", ids=("W3",), sql=with_fixtures(f"""
    SELECT symbol, ts, round(close, 6) AS close,
           {_r('close - ' + lag_sql('close'), 'price_change')}
    FROM bars""", "bars"))
def q_price_change(spark, sf_dir):
    return rounded(ind.price_changes(bars(spark, sf_dir)))


@register("volatility_10", ids=("W4",), sql=with_fixtures(f"""
    SELECT symbol, ts, {_r(full_sql('stddev_samp', 'r', 10) + ' * 100', 'volatility', 4)}
    FROM (SELECT symbol, ts, {ret_sql()} AS r FROM bars) b""", "bars"))
def q_volatility_10(spark, sf_dir):
    return rounded(ind.volatility_10(bars(spark, sf_dir)), 4)


@register("volatility_annual", ids=("W5",), sql=with_fixtures(f"""
    SELECT symbol, ts,
           {_r(full_sql('stddev_samp', 'r', 30) + ' * ' + SQRT252 + ' * 100', 'volatility', 2)}
    FROM (SELECT symbol, ts, {ret_sql()} AS r FROM bars) b""", "bars"))
def q_volatility_annual(spark, sf_dir):
    return rounded(ind.volatility_annual(bars(spark, sf_dir)), 2)


@register("support_resistance", ids=("W6",), sql=with_fixtures(f"""
    SELECT symbol, ts, {full_sql('max', 'high', 20)} AS resistance,
           {full_sql('min', 'low', 20)} AS support
    FROM bars""", "bars"))
def q_support_resistance(spark, sf_dir):
    return ind.support_resistance(bars(spark, sf_dir))


@register("high_low_52w", ids=("W7",), sql=with_fixtures(f"""
    SELECT symbol, ts, {full_sql('max', 'high', 252)} AS high_52w,
           {full_sql('min', 'low', 252)} AS low_52w
    FROM bars""", "bars"))
def q_high_low_52w(spark, sf_dir):
    return ind.high_low_52w(bars(spark, sf_dir))


@register("last_change", ids=("W8",), sql=with_fixtures(f"""
    SELECT symbol, ts, round(close, 6) AS close, round(prev_close, 6) AS prev_close,
           round(close - prev_close, 6) AS change,
           round(CASE WHEN prev_close <> 0 THEN (close - prev_close) / prev_close * 100
                      ELSE 0.0 END, 6) AS change_pct
    FROM (SELECT symbol, ts, close, coalesce({lag_sql('close')}, close) AS prev_close,
                 row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn
          FROM bars) b
    WHERE rn = 1""", "bars"))
def q_last_change(spark, sf_dir):
    return rounded(ind.last_change(bars(spark, sf_dir)))


@register("latest_bar", ids=("L1",), sql=with_fixtures("""
    SELECT symbol, ts, open, high, low, close, volume
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) b
    WHERE rn = 1""", "bars"))
def q_latest_bar(spark, sf_dir):
    return ind.latest_bar(bars(spark, sf_dir))


@register("tail_n", ids=("W12", "L2"), sql=with_fixtures("""
    SELECT symbol, ts, open, high, low, close, volume
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) b
    WHERE rn <= 100""", "bars"))
def q_tail_n(spark, sf_dir):
    return ind.tail_n(bars(spark, sf_dir), 100)


_CURRENT_SQL = with_fixtures(f"""
    SELECT l.symbol,
           round(cur, 6) AS current_price,
           round(cur - prv, 6) AS change,
           round(CASE WHEN prv <> 0 THEN (cur - prv) / prv * 100 ELSE 0.0 END, 6) AS change_pct,
           volume, round(ma_20, 6) AS ma_20, round(ma_50, 6) AS ma_50,
           round(volatility, 6) AS volatility, round(high_52w, 6) AS high_52w,
           round(low_52w, 6) AS low_52w, 'hybrid_lstm_only' AS data_source,
           ts AS last_updated, is_real_time
    FROM (SELECT l.*, q.c IS NOT NULL AND q.c <> 0 AS is_real_time,
                 CASE WHEN q.c IS NOT NULL AND q.c <> 0 THEN q.c ELSE close END AS cur,
                 CASE WHEN q.c IS NOT NULL AND q.c <> 0 THEN coalesce(q.pc, prev_close)
                      ELSE prev_close END AS prv
          FROM (SELECT * FROM feats WHERE rn = 1) l LEFT JOIN quotes_o q USING (symbol)) l
    """, "bars", "quotes_o", extra=[
    ("rets", f"SELECT *, {ret_sql()} AS r FROM bars"),
    ("feats", f"""
        SELECT symbol, ts, close, volume, coalesce({lag_sql('close')}, close) AS prev_close,
               {full_sql('avg', 'close', 20)} AS ma_20, {full_sql('avg', 'close', 50)} AS ma_50,
               {full_sql('stddev_samp', 'r', 30)} * {SQRT252} * 100 AS volatility,
               {full_sql('max', 'high', 252)} AS high_52w,
               {full_sql('min', 'low', 252)} AS low_52w,
               row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn
        FROM rets""")])


@register("current_data", ids=("W13", "J1", "P11"), sql=_CURRENT_SQL)
def q_current_data(spark, sf_dir):
    return ind.current_data(bars(spark, sf_dir), order_quotes(spark, sf_dir), digits=6)


@register("current_data_blocked", ids=("W13",), sql=_CURRENT_SQL)
def q_current_data_blocked(spark, sf_dir):
    """The flagship with every symbol cut into halo blocks of 500 bars: the
    strategy for a symbol too long for one task; same rows as ``current_data``."""
    return ind.current_data(bars(spark, sf_dir), order_quotes(spark, sf_dir), digits=6,
                            block_rows=500, unit="month")


@register("quote_overlay", ids=("J1",), sql=with_fixtures("""
    SELECT l.symbol, l.close, l.prev_close,
           q.c IS NOT NULL AND q.c <> 0 AS is_real_time,
           CASE WHEN q.c IS NOT NULL AND q.c <> 0 THEN q.c ELSE l.close END AS current_price,
           CASE WHEN q.c IS NOT NULL AND q.c <> 0 THEN coalesce(q.pc, l.prev_close)
                ELSE l.prev_close END AS prev_price
    FROM (SELECT symbol, close, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts),
                 close) AS prev_close,
                 row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn
          FROM bars_1h) l
    LEFT JOIN quotes_e q USING (symbol)
    WHERE rn = 1""", "bars_1h", "quotes_e"))
def q_quote_overlay(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ticks = fx.events_as_ticks(t.events)
    b = fx.bars_from_ticks(ticks, "hour")
    last = ind.last_row(b.select("symbol", "ts", "close",
                                 F.coalesce(F.lag("close").over(ind.by_symbol()),
                                            F.col("close")).alias("prev_close")))
    quotes = fx.quotes_from_ticks(ticks, zero_symbol="click", drop_symbol="view")
    return ind.quote_overlay(last, quotes).select(
        "symbol", "close", "prev_close", "is_real_time", "current_price", "prev_price")


_TAIL = "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars)"


@register("enriched_history", ids=("W14",), sql=with_fixtures(f"""
    SELECT symbol, strftime(ts, '%Y-%m-%d') AS date, round(close, 2) AS price, volume,
           round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low,
           round(ma_5, 6) AS ma_5, round(ma_20, 6) AS ma_20,
           round(r, 8) AS daily_return, round(vol, 4) AS volatility,
           round(pc, 2) AS price_change, round(r * 100, 4) AS price_change_pct,
           round(resistance, 2) AS resistance, round(support, 2) AS support
    FROM (SELECT *, {full_sql('stddev_samp', 'r', 10)} * 100 AS vol
          FROM (SELECT *, {full_sql('avg', 'close', 5)} AS ma_5,
                       {full_sql('avg', 'close', 20)} AS ma_20, {ret_sql()} AS r,
                       close - {lag_sql('close')} AS pc,
                       {full_sql('max', 'high', 20)} AS resistance,
                       {full_sql('min', 'low', 20)} AS support
                FROM tail) a) b""", "bars", extra=[("tail", f"SELECT * FROM {_TAIL} WHERE rn <= 100")]))
def q_enriched_history(spark, sf_dir):
    return ind.enriched_history(bars(spark, sf_dir), 100, price_digits=2, avg_digits=6,
                                return_digits=8, ratio_digits=4)


@register("basic_history", ids=("W15",), sql=with_fixtures(f"""
    SELECT symbol, strftime(ts, '%Y-%m-%d') AS date, round(close, 2) AS price, volume,
           round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low
    FROM {_TAIL} t WHERE rn <= 100""", "bars"))
def q_basic_history(spark, sf_dir):
    return ind.basic_history(bars(spark, sf_dir), 100)


@register("price_stats", ids=("A1",), sql=with_fixtures(f"""
    SELECT symbol, min(close) AS min, max(close) AS max, round(avg(close), 6) AS mean,
           round(stddev_samp(close), 4) AS std,
           round((max(close) - min(close)) / avg(close) * 100, 6) AS variation_pct
    FROM {_TAIL} t WHERE rn <= 100 GROUP BY symbol""", "bars"))
def q_price_stats(spark, sf_dir):
    df = ind.price_stats(bars(spark, sf_dir), 100)
    return df.select("symbol", "min", "max", F.round("mean", 6).alias("mean"),
                     F.round("std", 4).alias("std"),
                     F.round("variation_pct", 6).alias("variation_pct"))


@register("data_info", ids=("A4",), sql=with_fixtures("""
    SELECT symbol, count(*) AS data_points, min(ts) AS start, max(ts) AS "end",
           'open,high,low,close,volume' AS columns
    FROM bars GROUP BY symbol""", "bars"))
def q_data_info(spark, sf_dir):
    return ind.data_info(bars(spark, sf_dir))
