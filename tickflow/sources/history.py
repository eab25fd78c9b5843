"""Market-data sources: candle payloads, vendor daily history, source fallback,
history carried on a message topic (S1-S3, S8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.functions.timecols import epoch_seconds, from_epoch_seconds


def candles_to_bars(candles: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Candle responses ``(symbol, payload JSON)`` -> bar rows.

    Only responses with status ``ok`` and a non-empty close array count; the
    parallel arrays are zipped into rows, epoch seconds become timestamps and
    rows with a null field are dropped.  Volume stays a double, as sent.
    """
    p = F.from_json(F.col(payload_col), S.CANDLE_PAYLOAD)
    ok = (candles.select("symbol", p.alias("p"))
          .filter((F.col("p.s") == "ok") & (F.size("p.c") > 0)))
    rows = ok.select("symbol", F.inline(F.arrays_zip("p.t", "p.o", "p.h", "p.l", "p.c", "p.v")))
    return (rows.select("symbol",
                        from_epoch_seconds("t").alias("ts"),
                        F.col("o").alias("open"), F.col("h").alias("high"),
                        F.col("l").alias("low"), F.col("c").alias("close"),
                        F.col("v").alias("volume"))
            .na.drop("any"))


def clean_daily_history(history: DataFrame) -> DataFrame:
    """Vendor daily history -> bars.

    Drop rows with any null, let ``adj_close`` replace ``close`` when the
    source has it, require the OHLCV columns, project to them.
    """
    df = history.na.drop("any")
    if "adj_close" in df.columns:
        df = df.withColumn("close", F.col("adj_close"))
    S.require_columns(df, S.BAR_COLUMNS)
    return df.select(*S.BAR_COLUMNS)


def last_n_days(bars: DataFrame, days: int, asof=None) -> DataFrame:
    """Bars of the last ``days`` days before ``asof``.

    With a fixed ``asof`` this is a plain range filter that reaches the scan.
    Without one, each symbol's own last bar is the reference point: the
    per-symbol maximum is a partial aggregate (one row per symbol) joined back
    on the symbol, which AQE broadcasts when it is small.
    """
    if asof is not None:
        lo = F.lit(asof).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
        return bars.filter(F.col("ts") >= lo)
    last = bars.groupBy("symbol").agg(F.max("ts").alias("_asof"))
    return (bars.join(last, "symbol")
            .filter(F.col("ts") >= F.col("_asof") - F.expr(f"INTERVAL {int(days)} DAYS"))
            .drop("_asof"))


def min_rows_gate(df: DataFrame, min_rows: int = S.MIN_ROWS, key: str = "symbol") -> DataFrame:
    """Keep the groups with at least ``min_rows`` rows (counted by partial aggregation)."""
    ok = df.groupBy(key).count().filter(F.col("count") >= min_rows).select(key)
    return df.join(ok, key, "left_semi")


def source_fallback(candidates: list[tuple[DataFrame, int]], key: str = "symbol") -> DataFrame:
    """Per symbol, the rows of the first candidate source that qualifies.

    ``candidates`` is ``[(rows, min_rows), ...]`` in priority order.  Counting
    is a partial aggregate on (symbol, priority); the winning priority per
    symbol is a one-row-per-symbol table joined back on (symbol, priority).
    A symbol that no source serves gets no rows.
    """
    tagged = [df.withColumn("_priority", F.lit(i)).withColumn("_min_rows", F.lit(m))
              for i, (df, m) in enumerate(candidates)]
    union = reduce(lambda a, b: a.unionByName(b), tagged)
    counts = (union.groupBy(key, "_priority")
              .agg(F.count(F.lit(1)).alias("_n"), F.max("_min_rows").alias("_m")))
    best = (counts.filter(F.col("_n") >= F.col("_m"))
            .groupBy(key).agg(F.min("_priority").alias("_priority")))
    return (union.join(best, [key, "_priority"], "left_semi")
            .withColumnRenamed("_priority", "source_priority").drop("_min_rows"))


def history_messages(bars: DataFrame) -> DataFrame:
    """Bars -> topic messages of type ``historical``, one per symbol and year.

    Odd years carry the symbol in lower case (clients upper-case on compare);
    ``offset`` is the epoch second of the message's first bar.
    """
    year = F.year("ts")
    rec = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                   "open", "high", "low", "close", "volume")
    per = bars.groupBy("symbol", year.alias("year")).agg(
        F.array_sort(F.collect_list(rec)).alias("data"), F.min("ts").alias("first_ts"))
    msg_symbol = F.when(F.col("year") % 2 == 1, F.lower("symbol")).otherwise(F.col("symbol"))
    value = F.to_json(F.struct(msg_symbol.alias("symbol"),
                               F.lit(S.MSG_HISTORICAL).alias("type"), F.col("data")))
    return per.select(F.lit(S.TOPICS["finnhub_historical"]).alias("topic"),
                      msg_symbol.alias("key"), value.alias("value"),
                      epoch_seconds("first_ts").alias("offset"))


def history_from_messages(messages: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """First ``historical`` message per requested symbol -> its bars.

    Matching is on the upper-cased symbol.  ``symbols`` (one column
    ``symbol``) restricts the request; without it every symbol is served.
    The first message per symbol is chosen by ``min_by`` on the offset, a
    partial aggregate, so only one message per symbol and task crosses the
    shuffle; its records are then exploded.
    """
    m = F.from_json("value", S.HISTORY_MESSAGE)
    parsed = (messages.select(m.alias("m"), "offset", "key")
              .filter(F.col("m.type") == S.MSG_HISTORICAL)
              .select(F.upper("m.symbol").alias("symbol"), "offset", "key",
                      F.col("m.data").alias("data")))
    if symbols is not None:
        parsed = parsed.join(symbols.select(F.upper("symbol").alias("symbol")).distinct(),
                             "symbol", "left_semi")
    first = (parsed.groupBy("symbol")
             .agg(F.min_by("data", F.struct("offset", "key")).alias("data")))
    rows = first.select("symbol", F.inline("data"))
    return rows.select("symbol", F.to_timestamp("timestamp").cast("timestamp_ntz").alias("ts"),
                       "open", "high", "low", "close", "volume")


def subscribed_symbols(ticks: DataFrame) -> DataFrame:
    return ticks.select("symbol").distinct()


def symbols_dim(spark, symbols: DataFrame) -> DataFrame:
    """Symbol dimension: the traded symbols with their display names.

    The name list is a fixed literal of ten rows, so it is broadcast.
    """
    names = spark.createDataFrame(S.SYMBOL_LIST, "symbol string, name string")
    return (symbols.select("symbol").distinct()
            .join(F.broadcast(names), "symbol", "left")
            .select("symbol", F.coalesce("name", "symbol").alias("name"))
            .withColumn("display", F.concat_ws(" - ", "symbol", "name")))


def listing(spark) -> DataFrame:
    """The supported-symbol listing (second validity source)."""
    names = spark.createDataFrame(S.SYMBOL_LIST, "symbol string, name string")
    return names.withColumn("display", F.concat_ws(" - ", "symbol", "name"))


def valid_symbols(symbols: DataFrame, quotes: DataFrame, listed: DataFrame) -> DataFrame:
    """Symbols with a usable quote (c present and > 0) or present in the listing."""
    good = quotes.filter(F.col("c").isNotNull() & (F.col("c") > 0)).select("symbol")
    cand = symbols.select("symbol").distinct()
    by_quote = cand.join(good, "symbol", "left_semi")
    by_list = cand.join(listed.select("symbol"), "symbol", "left_semi")
    return by_quote.unionByName(by_list).distinct()

