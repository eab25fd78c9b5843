"""Registered forecasting queries.

SQL twins use the fixed model (weights 1/60, intercept 0); the fitted models
(M2) by their errors' orthogonality, and by a pytest that recovers known weights.
Noise is on in the driver queries: DuckDB evaluates the same integer noise.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.functions.noise import gaussian_sql, symbol_code_sql
from tickflow.operators import forecast as fc
from tickflow.plans.market_queries import bars
from tickflow.plans.oracle import with_fixtures
from tickflow.plans.registry import register

W = S.WINDOW_SIZE
SEED = 42
COEF = repr(1.0 / W)
DBL08 = "CAST(0.8 AS DOUBLE)"

SCALED_SQL = """
    SELECT symbol, ts, close, mn, rng, (close - mn) / rng AS scaled,
           row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i,
           count(*) OVER (PARTITION BY symbol) AS n_bars
    FROM (SELECT *, min(close) OVER (PARTITION BY symbol) AS mn,
                 CASE WHEN max(close) OVER (PARTITION BY symbol) - min(close) OVER (PARTITION BY symbol) = 0
                      THEN CAST(1.0 AS DOUBLE)
                      ELSE max(close) OVER (PARTITION BY symbol) - min(close) OVER (PARTITION BY symbol)
                 END AS rng
          FROM bars) b"""

LAGS_SQL = f"""
    SELECT symbol, ts, i - {W} AS j, n_bars - {W} AS n_samples, scaled AS label, mn, rng,
           lag(scaled, {W}) OVER w AS lag_first, lag(scaled, 1) OVER w AS lag_last,
           sum(scaled) OVER (w ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING) AS lag_sum,
           avg(scaled) OVER (w ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING) AS lag_mean
    FROM sc WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""

TRAIN_SQL = f"""
    SELECT *, CASE WHEN j <= n_train THEN 'train' ELSE 'test' END AS split,
           j <= n_train AND j > CAST(floor(n_train * {DBL08}) AS BIGINT) AS is_validation
    FROM (SELECT *, CAST(floor(n_samples * {DBL08}) AS BIGINT) AS n_train
          FROM lw WHERE j >= 1 AND n_samples >= {S.MIN_ROWS}) t"""

# Fixed-model scores: the prediction is the mean of the 60 lags.
SCORES_SQL = """
    SELECT symbol, ts, j, split, is_validation,
           lag_mean * rng + mn AS prediction, label * rng + mn AS actual
    FROM tr"""

FORECAST_CTES = [
    ("sc", SCALED_SQL), ("lw", LAGS_SQL),
    ("start", f"""
        SELECT symbol, last_ts, mn, rng, win, {symbol_code_sql('symbol')} AS code
        FROM (SELECT symbol, ts AS last_ts, mn, rng,
                     list(scaled) OVER (PARTITION BY symbol ORDER BY ts
                                        ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS win,
                     row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn
              FROM sc) s
        WHERE rn = 1 AND len(win) = {W}"""),
]

_Y = (f"(list_reduce(list_transform(win, lambda x: x * CAST({COEF} AS DOUBLE)), "
      f"lambda a, b: a + b) + CAST(0.0 AS DOUBLE) + "
      f"{gaussian_sql('code', 'sim', 'step + 1', SEED, S.NOISE_SD)})")

PATHS_SQL = f"""
    WITH RECURSIVE paths(symbol, sim, step, win, value, code, last_ts, mn, rng) AS (
        SELECT symbol, CAST(s.sim AS INTEGER), 0, win, CAST(NULL AS DOUBLE), code, last_ts, mn, rng
        FROM start, range({S.NUM_SIMULATIONS}) s(sim)
        UNION ALL
        SELECT symbol, sim, step + 1, list_append(list_slice(win, 2, {W}), {_Y}), {_Y},
               code, last_ts, mn, rng
        FROM paths WHERE step < {S.DAYS_AHEAD})
    SELECT symbol, sim, step, value, last_ts, mn, rng FROM paths WHERE step >= 1"""

BAND_SQL = """
    SELECT symbol, step, avg(value) AS mean, quantile_cont(value, 0.25) AS p25,
           quantile_cont(value, 0.75) AS p75, max(last_ts) AS last_ts, max(mn) AS mn,
           max(rng) AS rng
    FROM paths GROUP BY symbol, step"""

FC_SQL = """
    SELECT symbol, step, CAST(last_ts + CAST(step AS INTEGER) * INTERVAL 1 DAY AS DATE) AS date,
           mean * rng + mn AS prediction, p25 * rng + mn AS lower, p75 * rng + mn AS upper
    FROM band"""


def _paths_with_ctes(body: str, extra: list[tuple[str, str]]) -> str:
    """A recursive CTE needs ``WITH RECURSIVE`` at the head of the list: put
    the fixtures first, then the recursion, then the CTEs that read it."""
    fixtures = with_fixtures("SELECT 1", "bars", extra=FORECAST_CTES)
    fixtures = fixtures[len("WITH "):fixtures.rindex("\nSELECT 1")]
    rec = PATHS_SQL.strip()[len("WITH RECURSIVE "):]
    rec_def, rec_select = rec.split("\n    SELECT symbol, sim, step, value", 1)
    tail = [("paths_all", "SELECT symbol, sim, step, value" + rec_select)] + extra
    tail_sql = ",\n".join(f"{n} AS ({q.strip()})" for n, q in tail)
    return f"WITH RECURSIVE {fixtures},\n{rec_def.strip()},\n{tail_sql}\n{body.strip()}"


def start_and_coefs(spark, sf_dir):
    b = bars(spark, sf_dir)
    start = fc.forecast_start(b)
    return b, start, fc.fixed_model()


@register("minmax_scaled", ids=("A7",), sql=with_fixtures(
    "SELECT symbol, ts, close, round(scaled, 9) AS scaled FROM sc", "bars",
    extra=[("sc", SCALED_SQL)]))
def q_minmax_scaled(spark, sf_dir):
    df = fc.minmax_scaled(bars(spark, sf_dir))
    return df.withColumn("scaled", F.round("scaled", 9))


@register("lag_windows", ids=("W9",), sql=with_fixtures("""
    SELECT symbol, ts, j, n_samples, round(label, 9) AS label,
           round(lag_first, 9) AS lag_first, round(lag_last, 9) AS lag_last,
           round(lag_sum, 8) AS lag_sum
    FROM lw WHERE j >= 1""", "bars", extra=[("sc", SCALED_SQL), ("lw", LAGS_SQL)]))
def q_lag_windows(spark, sf_dir):
    lw = fc.lag_windows(bars(spark, sf_dir))
    return lw.select("symbol", "ts", "j", "n_samples", F.round("label", 9).alias("label"),
                     F.round(F.element_at("lags", 1), 9).alias("lag_first"),
                     F.round(F.element_at("lags", -1), 9).alias("lag_last"),
                     F.round(F.aggregate("lags", F.lit(0.0), lambda a, x: a + x), 8)
                     .alias("lag_sum"))


_TR_EXTRA = [("sc", SCALED_SQL), ("lw", LAGS_SQL), ("tr", TRAIN_SQL)]


@register("train_test_split", ids=("W10",), sql=with_fixtures(
    "SELECT symbol, ts, j, n_samples, n_train, split FROM tr", "bars", extra=_TR_EXTRA))
def q_train_test_split(spark, sf_dir):
    return fc.training_set(bars(spark, sf_dir)).select("symbol", "ts", "j", "n_samples",
                                                       "n_train", "split")


@register("validation_split", ids=("W11",), sql=with_fixtures("""
    SELECT symbol, ts, j, is_validation FROM tr WHERE split = 'train'""",
    "bars", extra=_TR_EXTRA))
def q_validation_split(spark, sf_dir):
    return (fc.training_set(bars(spark, sf_dir)).filter(F.col("split") == "train")
            .select("symbol", "ts", "j", "is_validation"))


@register("training_set", ids=("M1", "P7"), sql=with_fixtures("""
    SELECT split, is_validation, count(*) AS samples, round(sum(label), 6) AS label_sum,
           round(sum(lag_sum), 5) AS lag_total
    FROM tr GROUP BY split, is_validation""", "bars", extra=_TR_EXTRA))
def q_training_set(spark, sf_dir):
    ts = fc.training_set(bars(spark, sf_dir))
    lag_sum = F.aggregate("lags", F.lit(0.0), lambda a, x: a + x)
    return (ts.groupBy("split", "is_validation")
            .agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("label"), 6).alias("label_sum"),
                 F.round(F.sum(lag_sum), 5).alias("lag_total")))


# A least-squares fit is the one whose errors are orthogonal to the constant and to each lag.
_FIT_SQL = f"""
    SELECT {{key}} count(*) AS n_fit, {W} AS n_coef, CAST(0 AS DOUBLE) AS largest_gradient
    FROM tr WHERE split = 'train' AND NOT is_validation"""


def _gradients(training, model, *keys):
    """Rows fitted, coefficients, and the largest mean product of the errors with a lag (or 1), to six digits."""
    rows = fc.with_model(training.filter((F.col("split") == "train") & ~F.col("is_validation")), model)
    error = F.col("label") - fc.dot(F.col("lags"), F.col("coef")) - F.col("intercept")
    terms = rows.select(*keys, F.size("coef").alias("n_coef"), error.alias("e"), F.posexplode(F.concat(F.array(F.lit(1.0)), "lags")).alias("k", "z"))
    means = terms.groupBy(*keys, "k").agg(F.abs(F.avg(F.col("e") * F.col("z"))).alias("g"), F.count("*").alias("n"), F.max("n_coef").alias("n_coef"))
    return means.groupBy(*keys).agg(F.max("n").alias("n_fit"), F.max("n_coef").alias("n_coef"),
                                    F.round(F.max("g"), 6).alias("largest_gradient"))


@register("model_coefficients", ids=("M2",), sql=with_fixtures(
    _FIT_SQL.format(key="symbol,") + " GROUP BY symbol", "bars", extra=_TR_EXTRA))
def q_model_coefficients(spark, sf_dir):
    """One model per symbol: its errors are orthogonal to every lag."""
    training = fc.training_set(bars(spark, sf_dir))
    return _gradients(training, fc.fit_linear(training), "symbol")


@register("model_pooled", ids=("M2",), sql=with_fixtures(_FIT_SQL.format(key=""), "bars", extra=_TR_EXTRA))
def q_model_pooled(spark, sf_dir):
    """One model over all symbols: its errors are orthogonal to every lag."""
    training = fc.training_set(bars(spark, sf_dir))
    return _gradients(training, fc.fit_pooled(training))


@register("window_scores", ids=("M3",), sql=with_fixtures("""
    SELECT symbol, ts, j, split, round(prediction, 6) AS prediction, round(actual, 6) AS actual
    FROM sco""", "bars", extra=_TR_EXTRA + [("sco", SCORES_SQL)]))
def q_window_scores(spark, sf_dir):
    ts = fc.training_set(bars(spark, sf_dir))
    s = fc.score_windows(ts, fc.fixed_model())
    return s.select("symbol", "ts", "j", "split", F.round("prediction", 6).alias("prediction"),
                    F.round("actual", 6).alias("actual"))


@register("forecast_metrics", ids=("A5", "M4"), sql=with_fixtures("""
    SELECT symbol, split, round(avg(abs(actual - prediction)), 4) AS mae,
           round(sqrt(avg((actual - prediction) * (actual - prediction))), 4) AS rmse,
           count(*) AS samples
    FROM sco GROUP BY symbol, split""", "bars", extra=_TR_EXTRA + [("sco", SCORES_SQL)]))
def q_forecast_metrics(spark, sf_dir):
    ts = fc.training_set(bars(spark, sf_dir))
    m = fc.forecast_metrics(fc.score_windows(ts, fc.fixed_model()))
    return m.select("symbol", "split", F.round("mae", 4).alias("mae"),
                    F.round("rmse", 4).alias("rmse"), "samples")


@register("forecast_paths", ids=("M5",), sql=_paths_with_ctes(
    "SELECT symbol, sim, step, round(value, 8) AS value FROM paths_all", []))
def q_forecast_paths(spark, sf_dir):
    _, start, coefs = start_and_coefs(spark, sf_dir)
    p = fc.forecast_paths(start, coefs, seed=SEED)
    return p.select("symbol", "sim", "step", F.round("value", 8).alias("value"))


_BAND_EXTRA = [("band", BAND_SQL.replace("FROM paths", "FROM paths_all"))]


@register("simulation_band", ids=("A6",), sql=_paths_with_ctes("""
    SELECT symbol, step, round(mean, 8) AS mean, round(p25, 8) AS p25, round(p75, 8) AS p75
    FROM band""", _BAND_EXTRA))
def q_simulation_band(spark, sf_dir):
    _, start, coefs = start_and_coefs(spark, sf_dir)
    b = fc.simulation_band(fc.forecast_paths(start, coefs, seed=SEED))
    return b.select("symbol", "step", F.round("mean", 8).alias("mean"),
                    F.round("p25", 8).alias("p25"), F.round("p75", 8).alias("p75"))


FC_EXTRA = _BAND_EXTRA + [("fc", FC_SQL)]


def _forecast(spark, sf_dir):
    _, start, coefs = start_and_coefs(spark, sf_dir)
    return fc.forecast_table(fc.simulation_band(fc.forecast_paths(start, coefs, seed=SEED)))


@register("forecast", ids=("M6",), sql=_paths_with_ctes("""
    SELECT symbol, step, date, round(prediction, 6) AS prediction, round(lower, 6) AS lower,
           round(upper, 6) AS upper
    FROM fc""", FC_EXTRA))
def q_forecast(spark, sf_dir):
    f = _forecast(spark, sf_dir)
    return f.select("symbol", "step", "date", F.round("prediction", 6).alias("prediction"),
                    F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@register("forecast_head", ids=("L4",), sql=_paths_with_ctes("""
    SELECT symbol, step, date, round(prediction, 6) AS prediction FROM fc WHERE step <= 3""",
    FC_EXTRA))
def q_forecast_head(spark, sf_dir):
    f = _forecast(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("step"))
    head = f.withColumn("_rn", first).filter(F.col("_rn") <= 3)
    return head.select("symbol", "step", "date", F.round("prediction", 6).alias("prediction"))


DOCUMENT_SQL = """
    SELECT symbol, count(*) AS n_days, min(strftime(date, '%Y-%m-%d')) AS first_date,
           max(strftime(date, '%Y-%m-%d')) AS last_date,
           round(sum(round(prediction, 2)), 2) AS prices_sum,
           round(sum(round(lower, 2)), 2) AS lower_sum, round(sum(round(upper, 2)), 2) AS upper_sum
    FROM fc GROUP BY symbol"""


@register("prediction_document", ids=("M7",), sql=_paths_with_ctes(DOCUMENT_SQL, FC_EXTRA))
def q_prediction_document(spark, sf_dir):
    doc = fc.prediction_document(_forecast(spark, sf_dir))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 2)
    return doc.select("symbol", F.size("dates").cast("bigint").alias("n_days"),
                      F.element_at("dates", 1).alias("first_date"),
                      F.element_at("dates", -1).alias("last_date"),
                      total("prices").alias("prices_sum"), total("lower_bound").alias("lower_sum"),
                      total("upper_bound").alias("upper_sum"))
