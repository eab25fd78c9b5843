"""Indicators on hand-made bar frames against pandas (null patterns, edge cases)."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tickflow import schemas as S
from tickflow.operators import forecast as fc
from tickflow.operators import indicators as ind
from tickflow.sources import history as hist


def bars_frame(spark, closes, symbol="X", highs=None, lows=None):
    t0 = datetime(2020, 1, 1)
    rows = []
    for i, c in enumerate(closes):
        h = highs[i] if highs else c + 1.0
        lo = lows[i] if lows else c - 1.0
        rows.append((symbol, t0 + timedelta(days=i), c, h, lo, c, 100 + i))
    return spark.createDataFrame(rows, S.BARS)


def col(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        if y is None or (isinstance(y, float) and math.isnan(y)):
            assert x is None, (a, b)
        else:
            assert x is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12), (x, y)


def test_rolling_matches_pandas(spark):
    rng = np.random.default_rng(3)
    closes = [float(v) for v in np.round(100 + np.cumsum(rng.normal(0, 2, 300)), 2)]
    b = bars_frame(spark, closes)
    s = pd.Series(closes)
    ma = ind.moving_averages(b, (5, 20, 50))
    for n in (5, 20, 50):
        same(col(ma, f"ma_{n}"), s.rolling(n).mean().tolist())
    r = ind.daily_returns(b)
    same(col(r, "daily_return"), s.pct_change().tolist())
    same(col(ind.volatility_10(b), "volatility"), (s.pct_change().rolling(10).std() * 100).tolist())
    ann = s.pct_change().dropna().rolling(30).std() * np.sqrt(252) * 100
    same(col(ind.volatility_annual(b), "volatility")[1:], ann.tolist())
    hl = ind.high_low_52w(b)
    same(col(hl, "high_52w"), (s + 1).rolling(252).max().tolist())
    sr = ind.support_resistance(b)
    same(col(sr, "support"), (s - 1).rolling(20).min().tolist())


def test_short_series_has_no_ma5(spark):
    ma = ind.moving_averages(bars_frame(spark, [1.0, 2.0, 3.0, 4.0]), (5,))
    assert col(ma, "ma_5") == [None] * 4


def test_one_bar_change_zero(spark):
    r = ind.last_change(bars_frame(spark, [10.0])).collect()[0]
    assert (r["change"], r["change_pct"], r["prev_close"]) == (0.0, 0.0, 10.0)


def test_constant_series(spark):
    b = bars_frame(spark, [5.0] * 120)
    assert set(col(fc.minmax_scaled(b), "scaled")) == {0.0}
    vol = [v for v in col(ind.volatility_10(b), "volatility") if v is not None]
    assert vol and set(vol) == {0.0}


def test_zero_price_return_is_null(spark):
    r = col(ind.daily_returns(bars_frame(spark, [0.0, 5.0, 6.0])), "daily_return")
    assert r[0] is None and r[1] is None and math.isclose(r[2], 0.2)


def test_quote_overlay_rules(spark):
    b = bars_frame(spark, [10.0, 11.0]).unionByName(bars_frame(spark, [20.0, 22.0], "Y")) \
        .unionByName(bars_frame(spark, [30.0, 33.0], "Z"))
    quotes = spark.createDataFrame([("X", 12.0, None, None), ("Y", 0.0, 1.0, None)],
                                   "symbol string, c double, pc double, ts timestamp_ntz")
    cur = {r["symbol"]: r for r in ind.current_data(b, quotes).collect()}
    assert cur["X"]["current_price"] == 12.0 and cur["X"]["change"] == 2.0  # pc absent
    assert cur["X"]["is_real_time"] is True
    assert cur["Y"]["current_price"] == 22.0 and cur["Y"]["is_real_time"] is False  # c = 0
    assert cur["Z"]["current_price"] == 33.0 and cur["Z"]["is_real_time"] is False  # no quote


def test_required_columns(spark):
    df = spark.createDataFrame([("X", 1.0)], "symbol string, close double")
    with pytest.raises(ValueError):
        hist.clean_daily_history(df)


def test_candles_status_filter(spark):
    payloads = spark.createDataFrame(
        [("A", '{"s":"ok","t":[0,86400],"o":[1,2],"h":[1,2],"l":[1,2],"c":[1,2],"v":[5,6]}'),
         ("B", '{"s":"no_data"}'),
         ("C", '{"s":"ok","t":[],"o":[],"h":[],"l":[],"c":[],"v":[]}')],
        "symbol string, payload string")
    rows = hist.candles_to_bars(payloads).orderBy("ts").collect()
    assert [r["symbol"] for r in rows] == ["A", "A"]
    assert rows[1]["ts"] == datetime(1970, 1, 2)


def test_source_fallback_priorities(spark):
    a = bars_frame(spark, [1.0] * 50, "S")     # first source too short for S
    b = bars_frame(spark, [2.0] * 10, "S")
    c = bars_frame(spark, [3.0] * 150, "T")    # first source serves T
    out = hist.source_fallback([(a.unionByName(c), 100), (b, 1)])
    got = {r["symbol"]: r["source_priority"] for r in out.select("symbol", "source_priority")
           .distinct().collect()}
    assert got == {"S": 1, "T": 0}


@pytest.mark.parametrize("fn,block", [
    (lambda b, k: ind.moving_averages(b, block_rows=k), 60),
    (lambda b, k: ind.volatility_annual(b, block_rows=k), 40),
    (lambda b, k: ind.support_resistance(b, block_rows=k), 25),
    (lambda b, k: ind.high_low_52w(b, block_rows=k), 260),
    (lambda b, k: ind.current_data(b, block_rows=k, digits=9), 260),
])
def test_halo_blocks_equal_whole_symbol_windows(spark, sf_dir, fn, block):
    from tickflow.sources import fixtures as fx
    from tickflow.sources.tables import Tables
    b = fx.daily_bars(Tables(spark, sf_dir).orders)
    whole, split = fn(b, None), fn(b, block)
    assert split.count() == whole.count()
    assert split.exceptAll(whole.select(*split.columns)).count() == 0
