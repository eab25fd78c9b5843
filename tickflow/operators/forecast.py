"""Forecasting on Spark.

Training rows are the 60 previous closes of a bar, a row frame under one
partitioning on ``symbol`` and one sort on ``ts``, scaled by min / max of the
whole series (the scaler is fit on all closes, as the application does): a
partial aggregate joined back.  Lag arrays stay inside the plan; nothing 60x
wide is ever written.

The model is a next-value linear regression on the 60 scaled lags, fitted
per symbol.  Scoring is a dot product in SQL expressions and the recursive
Monte-Carlo forecast is one ``aggregate`` over the step sequence per
(symbol, simulation): all JVM-side.  The fit is the only Python: partial
normal equations per Arrow batch (``mapInPandas``), summed by Spark, solved
per symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.functions import lstsq
from tickflow.functions.noise import gaussian, symbol_code
from tickflow.functions.windows import by_symbol, carried, split_windows
from tickflow.operators.indicators import tail_n


def _range(mn: Column, mx: Column) -> Column:
    """Scaler range, 1 for a constant series (so the scaled value is 0)."""
    return F.when(mx - mn == 0, F.lit(1.0)).otherwise(mx - mn)


def scaler_params(bars: DataFrame) -> DataFrame:
    """Fit the min-max scaler per symbol: one partial aggregate."""
    return (bars.groupBy("symbol")
            .agg(F.min("close").alias("mn"), F.max("close").alias("mx"),
                 F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("first_ts"),
                 F.max("ts").alias("last_ts"))
            .withColumn("rng", _range(F.col("mn"), F.col("mx"))))


def minmax_scaled(bars: DataFrame) -> DataFrame:
    """(close - min) / (max - min) per symbol over the whole series (A7); the scaler is a partial aggregate joined back."""
    rows = bars.select("symbol", "ts", "close").join(scaler_params(bars).select("symbol", "mn", "rng"), "symbol")
    return rows.select("symbol", "ts", "close", ((F.col("close") - F.col("mn")) / F.col("rng")).alias("scaled"))


def lag_windows(bars: DataFrame, window: int = S.WINDOW_SIZE, block_rows: int | None = None,
                unit: str = "month") -> DataFrame:
    """Each bar with the ``window`` previous scaled closes and its own scaled
    close as label; bars with fewer predecessors are dropped (W9).

    The lags are a frame of ``window`` rows; the scaler (min / max / count
    over the whole series) is a partial aggregate joined back per symbol.
    With ``block_rows`` the frames run per halo block
    (``functions.windows.split_windows``) instead of per symbol.
    """
    def compute(df, part):
        w = by_symbol(part)
        i = F.col("_pos") if "_pos" in df.columns else F.row_number().over(w)
        return df.select(*carried(df), "symbol", "ts", "close", i.alias("i"),
                         F.collect_list("close").over(w.rowsBetween(-window, -1)).alias("raw"))

    rows = split_windows(bars.select("symbol", "ts", "close"), compute, window, block_rows, unit=unit)
    params = scaler_params(bars).select("symbol", "mn", "rng", "n_bars")
    rows = rows.filter(F.size("raw") == window).join(params, "symbol")
    return rows.select(
        "symbol", "ts", "close", "mn", "rng",
        (F.col("i") - window).cast("bigint").alias("j"),
        (F.col("n_bars") - window).alias("n_samples"),
        F.transform("raw", lambda x: (x - F.col("mn")) / F.col("rng")).alias("lags"),
        ((F.col("close") - F.col("mn")) / F.col("rng")).alias("label"))


def training_set(bars: DataFrame, window: int = S.WINDOW_SIZE,
                 train_fraction: float = S.TRAIN_FRACTION,
                 validation_fraction: float = S.VALIDATION_FRACTION,
                 min_samples: int = S.MIN_ROWS, block_rows: int | None = None) -> DataFrame:
    """M1: lag windows + chronological split (W10) + validation tail
    + the minimum-samples gate (P7)."""
    lw = lag_windows(bars, window, block_rows).filter(F.col("n_samples") >= min_samples)
    n_train = F.floor(F.col("n_samples") * train_fraction)
    lw = lw.withColumn("n_train", n_train.cast("bigint"))
    n_fit = F.floor(F.col("n_train") * (1.0 - validation_fraction))
    return (lw.withColumn("split", F.when(F.col("j") <= F.col("n_train"), F.lit("train"))
                          .otherwise(F.lit("test")))
            .withColumn("is_validation", (F.col("j") <= F.col("n_train")) & (F.col("j") > n_fit)))


# -- model ---------------------------------------------------------------------

COEF_SCHEMA = "symbol string, intercept double, coef array<double>, n_fit bigint"
STATS_SCHEMA = "symbol string, stats array<double>"


def fit_linear(training: DataFrame, use_validation: bool = False) -> DataFrame:
    """M2: least-squares next-value model per symbol on the fit rows (train
    minus the validation tail).

    The normal equations are summed the way Spark sums anything: each task
    turns its Arrow batches into per-symbol partial Z'Z / Z'y
    (``mapInPandas``, constant memory), the entries are added up by a
    partial aggregate on (symbol, entry), and only the summed system of a
    symbol (61 x 62 numbers) reaches the final ``applyInPandas`` solve.  No
    symbol's windows are ever held in one place, however long its history.
    """
    rows = training.filter(F.col("split") == "train")
    if not use_validation:
        rows = rows.filter(~F.col("is_validation"))
    partial = rows.select("symbol", "lags", "label").mapInPandas(
        lstsq.partial_normal_equations, STATS_SCHEMA)
    summed = (partial.select("symbol", F.posexplode("stats").alias("i", "v"))
              .groupBy("symbol", "i").agg(F.sum("v").alias("v")))
    return summed.groupBy("symbol").applyInPandas(lstsq.solve, COEF_SCHEMA)


def fit_pooled(training: DataFrame, use_validation: bool = False) -> tuple[float, list[float]]:
    """M2, pooled: one least-squares model over the fit rows of all symbols, as literals for ``with_model``.

    ``pyspark.ml``'s normal-equation solver sums one 61 x 61 system in a tree
    of tasks; only that system reaches the driver, whatever the rows.
    Without rows to fit there is no model, which is an error.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    rows = training.filter(F.col("split") == "train")
    if not use_validation:
        rows = rows.filter(~F.col("is_validation"))
    rows = rows.select(array_to_vector("lags").alias("features"), "label")
    if rows.isEmpty():
        raise ValueError("no rows to fit")
    model = LinearRegression(solver="normal", regParam=0.0, standardization=False).fit(rows)
    return float(model.intercept), [float(c) for c in model.coefficients]


def equal_weights(symbols: DataFrame, window: int = S.WINDOW_SIZE) -> DataFrame:
    """Fixed model as a coefficient table: the mean of the lags (weights
    1/window, intercept 0) for every symbol of ``symbols``."""
    return symbols.select("symbol").distinct().select(
        "symbol", F.lit(0.0).alias("intercept"),
        F.array_repeat(F.lit(1.0 / window), window).alias("coef"),
        F.lit(0).cast("bigint").alias("n_fit"))


def fixed_model(window: int = S.WINDOW_SIZE, intercept: float = 0.0,
                coef: list[float] | None = None) -> tuple[float, list[float]]:
    """One model for all symbols, applied as literals (no join): by default
    the mean of the lags."""
    return intercept, (coef if coef is not None else [1.0 / window] * window)


def with_model(df: DataFrame, model) -> DataFrame:
    """Attach ``intercept`` / ``coef``: join a per-symbol coefficient table
    (AQE broadcasts it when small) or add a fixed model as literals."""
    if isinstance(model, DataFrame):
        return df.join(model.select("symbol", "intercept", "coef"), "symbol")
    intercept, coef = model
    return df.withColumns({"intercept": F.lit(float(intercept)),
                           "coef": F.array(*[F.lit(float(c)) for c in coef])})


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def score_windows(training: DataFrame, coefs) -> DataFrame:
    """M3: prediction per window, back in price units (``coefs``: see
    ``with_model``)."""
    j = with_model(training, coefs)
    pred = dot(F.col("lags"), F.col("coef")) + F.col("intercept")
    return j.select("symbol", "ts", "j", "split", "is_validation",
                    (pred * F.col("rng") + F.col("mn")).alias("prediction"),
                    (F.col("label") * F.col("rng") + F.col("mn")).alias("actual"))


def forecast_metrics(scores: DataFrame) -> DataFrame:
    """A5 / M4: MAE and RMSE in price units per symbol and split."""
    err = F.col("actual") - F.col("prediction")
    return (scores.groupBy("symbol", "split")
            .agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                 F.count(F.lit(1)).alias("samples")))


# -- recursive Monte-Carlo forecast -----------------------------------------------

def forecast_start(bars: DataFrame, window: int = S.WINDOW_SIZE) -> DataFrame:
    """Per symbol: the last ``window`` scaled closes, the scaler and the last date.

    The newest bars are a window group limit, gathered per symbol without
    another exchange; the scaler is a partial aggregate joined back.  Symbols
    with fewer bars get no row.
    """
    tail = tail_n(bars.select("symbol", "ts", "close"), window)
    g = tail.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("r"))
    g = g.filter(F.size("r") == window).join(scaler_params(bars).select("symbol", "mn", "rng", "last_ts"), "symbol")
    return g.select("symbol", "last_ts", "mn", "rng",
                    F.transform("r", lambda x: (x["close"] - F.col("mn")) / F.col("rng"))
                    .alias("win"))


def forecast_paths(start: DataFrame, coefs, sims: int = S.NUM_SIMULATIONS,
                   days: int = S.DAYS_AHEAD, noise_sd: float = S.NOISE_SD,
                   seed: int = 42, window: int = S.WINDOW_SIZE) -> DataFrame:
    """M5: ``sims`` recursive paths of ``days`` steps per symbol, in scaled
    space; each prediction plus N(0, noise_sd) noise feeds the next window.

    Simulations are generated rows (``explode(sequence)``), so paths of all
    symbols and simulations run in parallel; the recursion over steps is an
    ``aggregate`` whose state is (window, outputs).
    """
    j = with_model(start, coefs)
    j = j.withColumn("code", symbol_code(F.col("symbol")))

    def draws(sim):
        if not noise_sd:
            return F.array_repeat(F.lit(0.0), days)
        return F.transform(F.sequence(F.lit(1), F.lit(days)),
                           lambda i: gaussian(F.col("code"), sim, i, seed, noise_sd))

    # One generated row per simulation carrying its noise array: the generator
    # materialises the draws, so the step recursion reads them instead of
    # re-deriving them inside its lambda.
    per_sim = F.transform(F.sequence(F.lit(0), F.lit(sims - 1)),
                          lambda s: F.struct(s.alias("sim"), draws(s).alias("noise")))
    j = j.select("*", F.explode(per_sim).alias("_p")) \
        .select("*", F.col("_p.sim").alias("sim"), F.col("_p.noise").alias("noise")).drop("_p")

    def step(acc, i):
        y = dot(acc["win"], F.col("coef")) + F.col("intercept") + F.element_at(F.col("noise"), i)
        return F.transform(F.array(y), lambda v: F.struct(
            F.concat(F.slice(acc["win"], 2, window - 1), F.array(v)).alias("win"),
            F.concat(acc["out"], F.array(v)).alias("out")))[0]

    init = F.struct(F.col("win").alias("win"), F.array().cast("array<double>").alias("out"))
    paths = j.withColumn("out", F.aggregate(F.sequence(F.lit(1), F.lit(days)), init, step,
                                            lambda acc: acc["out"]))
    return paths.select("symbol", "sim", "last_ts", "mn", "rng",
                        F.posexplode("out").alias("pos", "value")) \
        .select("symbol", "sim", (F.col("pos") + 1).alias("step"), "value",
                "last_ts", "mn", "rng")


def simulation_band(paths: DataFrame) -> DataFrame:
    """Mean, 25th and 75th percentile (linear) per symbol and step."""
    return (paths.groupBy("symbol", "step")
            .agg(F.avg("value").alias("mean"), F.percentile("value", 0.25).alias("p25"),
                 F.percentile("value", 0.75).alias("p75"),
                 F.max("last_ts").alias("last_ts"), F.max("mn").alias("mn"),
                 F.max("rng").alias("rng")))


def forecast_table(band: DataFrame) -> DataFrame:
    """M6: date, prediction, lower, upper in price units (calendar days after
    the last bar; scaling is increasing, so percentiles commute with it)."""
    inv = lambda c: F.col(c) * F.col("rng") + F.col("mn")
    return band.select(
        "symbol", "step",
        F.date_add(F.to_date("last_ts"), F.col("step").cast("int")).alias("date"),
        inv("mean").alias("prediction"), inv("p25").alias("lower"), inv("p75").alias("upper"))


def forecast(bars: DataFrame, coefs, **kw) -> DataFrame:
    return forecast_table(simulation_band(forecast_paths(forecast_start(bars), coefs, **kw)))


def prediction_document(fc: DataFrame, digits: int = 2) -> DataFrame:
    """M7: per symbol, arrays of dates / prices / bounds rounded to ``digits``;
    a missing bound falls back to the prediction.  Arrays are as long as the
    horizon."""
    rows = F.array_sort(F.collect_list(F.struct(
        "step", F.date_format("date", "yyyy-MM-dd").alias("d"),
        F.round("prediction", digits).alias("p"),
        F.round(F.coalesce("lower", "prediction"), digits).alias("lo"),
        F.round(F.coalesce("upper", "prediction"), digits).alias("hi"))))
    g = fc.groupBy("symbol").agg(rows.alias("r"))
    return g.select("symbol", F.col("r.d").alias("dates"), F.col("r.p").alias("prices"),
                    F.col("r.lo").alias("lower_bound"), F.col("r.hi").alias("upper_bound"))
