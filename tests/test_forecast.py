"""Forecasting properties: fit recovers known weights, noise 0 collapses the
band, same seed repeats, result independent of partitioning, recursion equals
a numpy loop."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.operators import forecast as fc


def series_bars(spark, values, symbol="X"):
    t0 = datetime(2020, 1, 1)
    rows = [(symbol, t0 + timedelta(days=i), float(v), float(v), float(v), float(v), 1)
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, S.BARS)


def ar_series(n, seed=0, noise=1.0):
    """Stationary AR on lags 1, 2 and 60."""
    rng = np.random.default_rng(seed)
    x = list(rng.normal(0, 1, 60))
    for _ in range(n - 60):
        x.append(0.5 * x[-1] + 0.2 * x[-2] + 0.1 * x[-60] + rng.normal(0, noise))
    return np.array(x) * 10 + 500


def test_fit_recovers_weights(spark):
    b = series_bars(spark, ar_series(4000))
    coefs = fc.fit_linear(fc.training_set(b)).collect()[0]
    w = np.array(coefs["coef"])
    assert w[-1] == pytest.approx(0.5, abs=0.05)
    assert w[-2] == pytest.approx(0.2, abs=0.05)
    assert w[0] == pytest.approx(0.1, abs=0.05)
    assert np.abs(w[1:-2]).max() < 0.08
    assert coefs["n_fit"] == int(int(3940 * 0.8) * 0.8)


def test_noise_zero_band_collapses_and_matches_numpy(spark):
    vals = ar_series(200, 1)
    b = series_bars(spark, vals)
    start = fc.forecast_start(b)
    coefs = fc.equal_weights(start)
    out = fc.forecast(b, coefs, noise_sd=0.0, days=7).orderBy("step").collect()
    for r in out:
        assert r["lower"] == r["upper"] == pytest.approx(r["prediction"], rel=1e-12)
    mn, mx = vals.min(), vals.max()
    win = list((vals[-60:] - mn) / (mx - mn))
    expected = []
    for _ in range(7):
        y = 0.0
        for v in win:
            y += v * (1.0 / 60)
        expected.append(y * (mx - mn) + mn)
        win = win[1:] + [y]
    assert [r["prediction"] for r in out] == pytest.approx(expected, rel=1e-12)
    assert out[0]["date"].isoformat() == (datetime(2020, 1, 1) + timedelta(days=200)).date() \
        .isoformat()


def test_same_seed_same_forecast_any_partitioning(spark):
    b = series_bars(spark, ar_series(200, 2)).unionByName(series_bars(spark, ar_series(180, 3), "Y"))
    coefs = fc.equal_weights(fc.forecast_start(b))
    a = fc.forecast_paths(fc.forecast_start(b), coefs, seed=7).select("symbol", "sim", "step",
                                                                       "value")
    c = fc.forecast_paths(fc.forecast_start(b.repartition(5)), coefs.repartition(3), seed=7) \
        .select("symbol", "sim", "step", "value")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, c.collect()))
    d = fc.forecast_paths(fc.forecast_start(b), coefs, seed=8).select("symbol", "sim", "step",
                                                                       "value")
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, d.collect()))


def test_noise_is_standard_normal(spark):
    from tickflow.functions.noise import gaussian
    df = spark.range(20000).select(gaussian(F.lit(12345).cast("bigint"), F.col("id") % 100,
                                            F.col("id"), 42).alias("z"))
    s = df.agg(F.avg("z").alias("m"), F.stddev("z").alias("sd")).collect()[0]
    assert abs(s["m"]) < 0.03 and abs(s["sd"] - 1) < 0.03


def test_training_gate(spark):
    short = series_bars(spark, ar_series(159))   # 99 samples
    ok = series_bars(spark, ar_series(160), "Y")  # 100 samples
    syms = {r["symbol"] for r in fc.training_set(short.unionByName(ok)).select("symbol")
            .distinct().collect()}
    assert syms == {"Y"}


def test_training_set_blocks_equal_whole(spark, sf_dir):
    from tickflow.sources import fixtures as fx
    from tickflow.sources.tables import Tables
    b = fx.daily_bars(Tables(spark, sf_dir).orders)
    whole, split = fc.training_set(b), fc.training_set(b, block_rows=70)
    assert split.count() == whole.count()
    assert split.exceptAll(whole.select(*split.columns)).count() == 0
