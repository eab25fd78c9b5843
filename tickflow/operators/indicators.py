"""Technical indicators over bar tables (all symbols in one pass).

Every function takes a bar DataFrame ``(symbol, ts, open, high, low, close,
volume)`` and returns a DataFrame; rolling values follow the pandas rule
(null until the frame holds ``n`` non-null inputs).  Indicators computed in
one ``select`` share one exchange on ``symbol`` and one sort on ``ts``.

Parallelism of the windows is the number of symbols; the rows of one symbol
are its bars, which the calendar bounds (one per day or per minute), so a
hot symbol in the raw trades does not turn into a hot window partition.
Where one symbol's bars are still too many for a task, the window operators
take ``block_rows`` and run per halo block of the symbol instead (exact).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.functions.windows import (Key, by_symbol, carried, full, newest_first,
                                        split_windows)


def _lag_close(part: Key = "symbol") -> Column:
    return F.lag("close").over(by_symbol(part))


def daily_return(part: Key = "symbol") -> Column:
    """close / previous close - 1; null for the first bar and for a zero previous close."""
    return F.try_divide(F.col("close"), _lag_close(part)) - F.lit(1.0)


def price_change(part: Key = "symbol") -> Column:
    return F.col("close") - _lag_close(part)


def moving_average(n: int, col: str = "close", part: Key = "symbol") -> Column:
    return full(F.avg, col, n, part)


def rolling_std(col: str | Column, n: int, part: Key = "symbol") -> Column:
    return full(F.stddev_samp, col, n, part)


def with_returns(bars: DataFrame, part: Key = "symbol") -> DataFrame:
    return bars.withColumn("daily_return", daily_return(part))


# -- W1-W7: one column family each -------------------------------------------
# ``block_rows`` runs the windows per halo block instead of per symbol (see
# ``functions.windows.split_windows``): same result, no whole-symbol task.

def moving_averages(bars: DataFrame, windows=(5, 20, 50), block_rows: int | None = None,
                    unit: str = "month") -> DataFrame:
    def compute(df, part):
        return df.select(*carried(df), "symbol", "ts", "close",
                         *[moving_average(n, part=part).alias(f"ma_{n}") for n in windows])
    return split_windows(bars, compute, max(windows) - 1, block_rows, unit=unit)


def daily_returns(bars: DataFrame, block_rows: int | None = None,
                  unit: str = "month") -> DataFrame:
    def compute(df, part):
        r = daily_return(part)
        return df.select(*carried(df), "symbol", "ts", "close", r.alias("daily_return"),
                         (r * 100).alias("change_pct"))
    return split_windows(bars, compute, 1, block_rows, unit=unit)


def price_changes(bars: DataFrame, block_rows: int | None = None,
                  unit: str = "month") -> DataFrame:
    def compute(df, part):
        return df.select(*carried(df), "symbol", "ts", "close",
                         price_change(part).alias("price_change"))
    return split_windows(bars, compute, 1, block_rows, unit=unit)


def volatility_10(bars: DataFrame, block_rows: int | None = None,
                  unit: str = "month") -> DataFrame:
    """Rolling 10-bar sample std of daily returns, in percent."""
    def compute(df, part):
        return (with_returns(df, part)
                .select(*carried(df), "symbol", "ts",
                        (rolling_std("daily_return", 10, part) * 100).alias("volatility")))
    return split_windows(bars, compute, 10, block_rows, unit=unit)


def volatility_annual(bars: DataFrame, n: int = 30, block_rows: int | None = None,
                      unit: str = "month") -> DataFrame:
    """Rolling ``n``-bar std of returns, annualised with 252 days, in percent."""
    def compute(df, part):
        return (with_returns(df, part)
                .select(*carried(df), "symbol", "ts",
                        (rolling_std("daily_return", n, part)
                         * math.sqrt(S.ANNUALISATION_DAYS) * 100).alias("volatility")))
    return split_windows(bars, compute, n, block_rows, unit=unit)


def support_resistance(bars: DataFrame, n: int = 20, block_rows: int | None = None,
                       unit: str = "month") -> DataFrame:
    def compute(df, part):
        return df.select(*carried(df), "symbol", "ts",
                         full(F.max, "high", n, part).alias("resistance"),
                         full(F.min, "low", n, part).alias("support"))
    return split_windows(bars, compute, n - 1, block_rows, unit=unit)


def high_low_52w(bars: DataFrame, n: int = S.ANNUALISATION_DAYS, block_rows: int | None = None,
                 unit: str = "month") -> DataFrame:
    def compute(df, part):
        return df.select(*carried(df), "symbol", "ts",
                         full(F.max, "high", n, part).alias("high_52w"),
                         full(F.min, "low", n, part).alias("low_52w"))
    return split_windows(bars, compute, n - 1, block_rows, unit=unit)


# -- W8, W12, L1: last rows -----------------------------------------------------

def last_row(df: DataFrame, key: str = "symbol", order: str = "ts") -> DataFrame:
    """The newest row per key as a flat row (``max_by`` over a struct).

    An aggregate, not a window: partial aggregation keeps one row per key and
    task before the shuffle, whatever the size of a key.
    """
    cols = [c for c in df.columns if c != key]
    return (df.groupBy(key)
            .agg(F.max_by(F.struct(*cols), F.col(order)).alias("_last"))
            .select(key, "_last.*"))


def latest_bar(bars: DataFrame) -> DataFrame:
    return last_row(bars)


def last_change(bars: DataFrame) -> DataFrame:
    """Last close, previous close (= last when only one bar), change, change %.

    From the last two bars per symbol: no window runs over a history.
    """
    two = (bars.select("symbol", "ts", "close", F.row_number().over(newest_first()).alias("_rn"))
           .filter(F.col("_rn") <= 2).groupBy("symbol")
           .agg(F.max("ts").alias("ts"), F.max(F.when(F.col("_rn") == 1, F.col("close"))).alias("close"),
                F.max(F.when(F.col("_rn") == 2, F.col("close"))).alias("_before")))
    last = two.withColumn("prev_close", F.coalesce("_before", "close"))
    change = F.col("close") - F.col("prev_close")
    pct = F.when(F.col("prev_close") != 0,
                 F.try_divide(change, F.col("prev_close")) * 100).otherwise(F.lit(0.0))
    return last.select("symbol", "ts", "close", "prev_close", change.alias("change"),
                       pct.alias("change_pct"))


def tail_n(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars per symbol (window group limit: top-n per task first)."""
    rn = F.row_number().over(newest_first())
    return bars.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


# -- J1, W13: current data --------------------------------------------------------

def quote_overlay(last: DataFrame, quotes: DataFrame) -> DataFrame:
    """Replace the last / previous close by the quote's ``c`` / ``pc``.

    A quote counts only when ``c`` is present and non-zero; ``pc`` then
    replaces the previous close when present.  ``quotes`` has one row per
    symbol, as many rows as ``last``; the join is left, on the symbol key,
    and AQE turns it into a broadcast join when the runtime size is small.
    """
    q = quotes.select("symbol", F.col("c").alias("_c"), F.col("pc").alias("_pc"))
    j = last.join(q, "symbol", "left")
    use = F.col("_c").isNotNull() & (F.col("_c") != 0)
    return (j.withColumn("is_real_time", use)
            .withColumn("current_price", F.when(use, F.col("_c")).otherwise(F.col("close")))
            .withColumn("prev_price",
                        F.when(use, F.coalesce(F.col("_pc"), F.col("prev_close")))
                        .otherwise(F.col("prev_close")))
            .drop("_c", "_pc"))


def _last_of(items: Column, n: int) -> Column:
    """The last ``n`` of an array, null if it has fewer or a null among them: the array form of ``windows.full``."""
    some = F.slice(items, -n, n)
    return F.when((F.size(items) >= n) & ~F.exists(some, lambda x: x.isNull()), some)


def _mean(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x) / F.size(items)


def _sample_std(items: Column) -> Column:
    squares = F.transform(F.array(_mean(items)), lambda m: F.aggregate(items, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return F.sqrt(squares[0] / (F.size(items) - 1))


def latest_indicators(bars: DataFrame) -> DataFrame:
    """The newest bar's rolling indicators per symbol, from the last 252 bars alone.

    The tail is a window group limit (every task keeps 252 bars per symbol
    before the shuffle); its bars are gathered in one array per symbol and
    folded, so no window runs over a history, however long.
    """
    tail = tail_n(bars.select("symbol", "ts", "close", "high", "low", "volume"), S.ANNUALISATION_DAYS)
    last = tail.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "close", "high", "low", "volume"))).alias("r"))
    last = last.select("symbol", F.element_at("r", -1).alias("b"), F.col("r.close").alias("c"), F.col("r.high").alias("h"), F.col("r.low").alias("l"))
    # the last 30 returns, in the order of their bars
    pairs = F.arrays_zip(F.slice("c", -31, 30).alias("p"), F.slice("c", -30, 30).alias("q"))
    returns = F.when(F.size("c") >= 31, F.transform(pairs, lambda x: F.try_divide(x["q"], x["p"]) - 1))
    last = last.withColumn("d", _last_of(returns, 30))
    return last.select(
        "symbol", "b.ts", "b.close", "b.volume",
        F.coalesce(F.when(F.size("c") > 1, F.try_element_at("c", F.lit(-2))), F.col("b.close")).alias("prev_close"),
        _mean(_last_of(F.col("c"), 20)).alias("ma_20"), _mean(_last_of(F.col("c"), 50)).alias("ma_50"),
        F.array_max(_last_of(F.col("h"), S.ANNUALISATION_DAYS)).alias("high_52w"),
        F.array_min(_last_of(F.col("l"), S.ANNUALISATION_DAYS)).alias("low_52w"),
        (_sample_std(F.col("d")) * math.sqrt(S.ANNUALISATION_DAYS) * 100).alias("volatility"))


def current_data(bars: DataFrame, quotes: DataFrame | None = None,
                 digits: int = 2, block_rows: int | None = None,
                 unit: str = "month") -> DataFrame:
    """One row per symbol: price, change, volume, MA 20 / 50, annual volatility,
    52-week high / low of the newest bar.

    The bars that these reach back to are taken first (``latest_indicators``);
    with ``block_rows`` they roll over the whole history in halo blocks, which
    gives the same rows.
    """
    def compute(df, part):
        rows = df.select(
            *carried(df), "symbol", "ts", "close", "volume",
            F.coalesce(_lag_close(part), F.col("close")).alias("prev_close"),
            moving_average(20, part=part).alias("ma_20"),
            moving_average(50, part=part).alias("ma_50"),
            daily_return(part).alias("daily_return"),
            full(F.max, "high", S.ANNUALISATION_DAYS, part).alias("high_52w"),
            full(F.min, "low", S.ANNUALISATION_DAYS, part).alias("low_52w"))
        return rows.withColumn(
            "volatility",
            rolling_std("daily_return", 30, part) * math.sqrt(S.ANNUALISATION_DAYS) * 100)
    if block_rows:
        last = last_row(split_windows(bars, compute, S.ANNUALISATION_DAYS - 1, block_rows, unit=unit))
    else:
        last = latest_indicators(bars)
    if quotes is not None:
        last = quote_overlay(last, quotes)
    else:
        last = (last.withColumn("is_real_time", F.lit(False))
                .withColumn("current_price", F.col("close"))
                .withColumn("prev_price", F.col("prev_close")))
    change = F.col("current_price") - F.col("prev_price")
    pct = F.when(F.col("prev_price") != 0,
                 F.try_divide(change, F.col("prev_price")) * 100).otherwise(F.lit(0.0))
    r = lambda c: F.round(c, digits)
    return last.select(
        "symbol",
        r(F.col("current_price")).alias("current_price"),
        r(change).alias("change"),
        r(pct).alias("change_pct"),
        F.col("volume").cast("bigint").alias("volume"),
        r(F.col("ma_20")).alias("ma_20"),
        r(F.col("ma_50")).alias("ma_50"),
        r(F.col("volatility")).alias("volatility"),
        r(F.col("high_52w")).alias("high_52w"),
        r(F.col("low_52w")).alias("low_52w"),
        F.lit(S.DATA_SOURCE_CURRENT).alias("data_source"),
        F.col("ts").alias("last_updated"),
        F.col("is_real_time"))


# -- W14, W15, A1, A4 -------------------------------------------------------------

def enriched_history(bars: DataFrame, days: int = 100, price_digits: int = 2,
                     avg_digits: int = 2, return_digits: int = 4,
                     ratio_digits: int = 2) -> DataFrame:
    """Last ``days`` bars with indicators that start *inside* the tail.

    Defaults are the chart API's roundings; callers comparing engines pass
    more digits for the averages and ratios.
    """
    t = tail_n(bars, days)
    ret = daily_return()
    rows = t.select(
        "symbol", "ts", "open", "high", "low", "close", "volume",
        moving_average(5).alias("ma_5"),
        moving_average(20).alias("ma_20"),
        ret.alias("daily_return"),
        price_change().alias("price_change"),
        full(F.max, "high", 20).alias("resistance"),
        full(F.min, "low", 20).alias("support"))
    rows = rows.withColumn("volatility", rolling_std("daily_return", 10) * 100)
    p = lambda c: F.round(F.col(c), price_digits)
    a = lambda c: F.round(F.col(c), avg_digits)
    return rows.select(
        "symbol", F.date_format("ts", "yyyy-MM-dd").alias("date"),
        p("close").alias("price"), F.col("volume"),
        p("open").alias("open"), p("high").alias("high"), p("low").alias("low"),
        a("ma_5").alias("ma_5"), a("ma_20").alias("ma_20"),
        F.round(F.col("daily_return"), return_digits).alias("daily_return"),
        F.round(F.col("volatility"), ratio_digits).alias("volatility"),
        p("price_change").alias("price_change"),
        F.round(F.col("daily_return") * 100, ratio_digits).alias("price_change_pct"),
        p("resistance").alias("resistance"),
        p("support").alias("support"))


def basic_history(bars: DataFrame, days: int = 100, digits: int = 2) -> DataFrame:
    t = tail_n(bars, days)
    return t.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("date"),
                    F.round("close", digits).alias("price"), "volume",
                    F.round("open", digits).alias("open"),
                    F.round("high", digits).alias("high"),
                    F.round("low", digits).alias("low"))


def price_stats(bars: DataFrame, days: int | None = 100) -> DataFrame:
    """min, max, mean, sample std and (max - min) / mean * 100 of the close."""
    t = tail_n(bars, days) if days else bars
    return (t.groupBy("symbol")
            .agg(F.min("close").alias("min"), F.max("close").alias("max"),
                 F.avg("close").alias("mean"), F.stddev_samp("close").alias("std"))
            .withColumn("variation_pct",
                        F.try_divide(F.col("max") - F.col("min"), F.col("mean")) * 100))


def data_info(bars: DataFrame) -> DataFrame:
    """Row count, first and last time and the column list per symbol."""
    value_cols = [c for c in bars.columns if c not in ("symbol", "ts")]
    return (bars.groupBy("symbol")
            .agg(F.count(F.lit(1)).alias("data_points"),
                 F.min("ts").alias("start"), F.max("ts").alias("end"))
            .withColumn("columns", F.lit(",".join(value_cols))))
