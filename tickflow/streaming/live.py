"""Structured Streaming versions of the live operators.

Topic decoding and stops are in ``topics``, keyed states (T7, C1) in ``stateful``,
batch-wise upserts (T9, late rows) in ``upserts``, the event store (S7) in ``store``.

The transformations are the batch functions of ``tickflow.operators``; this
module adds what only a stream has: file / Kafka sources, event-time
watermarks, output modes, checkpointed sinks, and bounded runs
(``availableNow``) for tests and catch-up jobs.

Sinks are restart-safe: file sinks are exactly-once through their
checkpoint, and every ``foreachBatch`` writer overwrites the folder of its
own batch id, so a batch re-run after a lost executor or a driver restart
replaces, never duplicates, its output.  Readers of such changelog tables
take the newest row per key by batch id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickflow.operators import readmodel as rmo
from tickflow.operators import ticks as tk
from tickflow.session import path_exists, shared_path
from tickflow.sources.tables import read_table

EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                 "value double, props string")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    return shared_path(spark, "tickflow-streams", f"{name}-{uuid.uuid4().hex[:12]}")


def table_stream(spark: SparkSession, sf_dir: str, table: str, schema: str | None = None,
                 max_files: int | None = None) -> DataFrame:
    """A parquet table folder (or the driver's one-file tables) as a file stream."""
    if schema is None:
        schema = read_table(spark, sf_dir, table).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def folder_stream(spark: SparkSession, path: str, schema, max_files: int | None = None,
                  fmt: str = "parquet") -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def kafka_stream(spark: SparkSession, servers: str, topics: list[str],
                 starting: str = "latest") -> DataFrame:
    """Subscribe to topics (needs the Kafka connector on the cluster).

    Returns ``(topic, key, value, partition, offset, ts)`` with strings."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", ",".join(topics)).option("startingOffsets", starting).load())
    return raw.select("topic", F.col("key").cast("string").alias("key"),
                      F.col("value").cast("string").alias("value"), "partition", "offset",
                      F.col("timestamp").alias("ts"))


def event_time(df: DataFrame, col: str = "ts", out: str = "event_time") -> DataFrame:
    """Watermarks need TIMESTAMP (not NTZ); the session time zone is UTC."""
    return df.withColumn(out, F.col(col).cast("timestamp"))


def run_available(writer, timeout: float | None = None) -> StreamingQuery:
    """Process what is available now, then stop (bounded consumption).

    A run that ``timeout`` (seconds) ends before its input is used up raises
    ``TimeoutError``; its checkpoint lets the next run go on."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(timeout)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"input left after {timeout} seconds")
    if q.exception() is not None:
        raise q.exception()
    return q


# -- T1 / S7: the log as an appended, partitioned table -----------------------------

def append_log(log_stream: DataFrame, path: str, checkpoint: str):
    """Append events to a parquet log partitioned by event date (exactly-once
    through the file sink's checkpoint)."""
    out = log_stream.withColumn("event_date", F.to_date("timestamp"))
    return (out.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).partitionBy("event_date")
            .outputMode("append"))


# -- changelog tables written by foreachBatch -----------------------------------------

def _newest_version(spark: SparkSession, path: str, column: str, below: int | None = None):
    """Largest ``column=<n>`` partition under ``path`` (below ``below``; None
    when absent)."""
    if not path_exists(spark, path):  # nothing written yet; any failing read is an error
        return None
    versions = spark.read.parquet(path).select(column)
    if below is not None:
        versions = versions.filter(F.col(column) < below)
    return versions.agg(F.max(column)).collect()[0][0]


def changelog_writer(path: str, key: str | None = None, compact_every: int | None = None):
    """foreachBatch function: write the batch to ``path/log/batch_id=<id>``
    (overwrite, so a re-run batch replaces itself).

    With ``key`` and ``compact_every``, every ``compact_every``-th batch also
    folds the log into a snapshot ``path/snapshot/version=<id>`` (newest row
    per key), so readers scan one snapshot plus the batches after it however
    long the stream runs; older folders can then be expired by the store's
    retention.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")
        if key and compact_every and (batch_id + 1) % compact_every == 0:
            spark = batch.sparkSession
            # a re-run batch must not read the snapshot it is rewriting
            current = read_changelog(spark, path, key, upto=batch_id, snapshot_below=batch_id)
            current.write.mode("overwrite").parquet(f"{path}/snapshot/version={batch_id}")
    return write


def latest_by_key(changelog: DataFrame, key: str) -> DataFrame:
    """Newest version of each key in a changelog table."""
    cols = [c for c in changelog.columns if c not in (key, "batch_id")]
    return (changelog.groupBy(key)
            .agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("_r"))
            .select(key, "_r.*"))


def read_changelog(spark: SparkSession, path: str, key: str | None = None,
                   upto: int | None = None, snapshot_below: int | None = None) -> DataFrame:
    """Rows of a changelog table: all logged rows (``key`` None) or the
    newest row per key from the latest snapshot plus the batches after it."""
    log = spark.read.parquet(f"{path}/log")
    if upto is not None:
        log = log.filter(F.col("batch_id") <= upto)
    if key is None:
        return log
    snap_version = _newest_version(spark, f"{path}/snapshot", "version", snapshot_below)
    if snap_version is not None and (upto is None or snap_version <= upto):
        snap = (spark.read.parquet(f"{path}/snapshot/version={snap_version}")
                .withColumn("batch_id", F.lit(snap_version)))
        log = snap.unionByName(log.filter(F.col("batch_id") > snap_version))
    return latest_by_key(log, key)


def read_model_stream(log_stream: DataFrame, path: str, checkpoint: str,
                      compact_every: int | None = 100):
    """The read-model aggregate kept current (update mode) in a changelog."""
    partials = rmo.read_model_partials(log_stream)
    return (partials.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(changelog_writer(path, "symbol", compact_every)))


def read_model_table(spark: SparkSession, path: str) -> DataFrame:
    return rmo.finish_read_model(read_changelog(spark, path, "symbol"))


def last_price_stream(ticks_stream: DataFrame, path: str, checkpoint: str,
                      compact_every: int | None = 100):
    """T3 live: latest price per symbol, update mode into a changelog."""
    return (tk.last_price(ticks_stream).writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(changelog_writer(path, "symbol", compact_every)))


# -- windowed and deduplicating streams ----------------------------------------------

def ohlcv_stream(ticks_stream: DataFrame, path: str, checkpoint: str,
                 watermark: str = "1 hour", every: str = "1 minute"):
    """T2 live: tumbling OHLCV bars, emitted once the watermark closes them."""
    t = event_time(ticks_stream).withWatermark("event_time", watermark)
    bars = tk.ohlcv(t.drop("ts").withColumnRenamed("event_time", "ts"), every)
    return (bars.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append"))


def ohlcv_update_stream(ticks_stream: DataFrame, path: str, checkpoint: str, watermark: str = "1 hour",
                        every: str = "1 minute", compact_every: int | None = 100):
    """T2 live: every bar as it stands, open windows too, update mode into a changelog."""
    t = event_time(ticks_stream).withWatermark("event_time", watermark)
    bars = tk.ohlcv(t.drop("ts").withColumnRenamed("event_time", "ts"), every)
    keyed = bars.select(F.struct("symbol", "ts").alias("bar"), *[c for c in bars.columns if c not in ("symbol", "ts")])
    return (keyed.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(changelog_writer(path, "bar", compact_every)))


def ohlcv_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each bar of ``ohlcv_update_stream``."""
    return read_changelog(spark, path, "bar").select(
        F.col("bar.symbol").alias("symbol"), F.col("bar.ts").cast("timestamp_ntz").alias("ts"),
        F.col("ts_end").cast("timestamp_ntz").alias("ts_end"), "open", "high", "low", "close", "volume", "trades")


def dedup_stream(events_stream: DataFrame, path: str, checkpoint: str,
                 watermark: str = "1 hour", key: str = "event_id"):
    """Drop redelivered events within the watermark (state bounded by it)."""
    e = event_time(events_stream).withWatermark("event_time", watermark)
    out = e.dropDuplicatesWithinWatermark([key]).drop("event_time")
    return (out.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append"))


def live_bars(messages_stream: DataFrame, symbols, callback, checkpoint: str):
    """``ohlcv_1min`` messages of the subscribed symbols, handed to
    ``callback`` once per micro-batch (the callback receives a DataFrame).

    ``symbols`` is a list, or a static DataFrame with a ``symbol`` column
    (joined stream-static, so a large subscription list never reaches the
    driver)."""
    m = messages_stream.select(
        F.upper(F.get_json_object("value", "$.symbol")).alias("symbol"),
        F.get_json_object("value", "$.type").alias("type"), "value")
    m = m.filter(F.col("type") == "ohlcv_1min")
    if isinstance(symbols, DataFrame):
        m = m.join(symbols.select(F.upper("symbol").alias("symbol")).distinct(), "symbol",
                   "left_semi")
    else:
        m = m.filter(F.col("symbol").isin([s.upper() for s in symbols]))
    return (m.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, batch_id: callback(df, batch_id)))


# -- alerts, training status -------------------------------------------------------

def alerts_stream(ticks_stream: DataFrame, rules: DataFrame, path: str, checkpoint: str):
    """T4 + S5f live: stream-static join with the per-symbol bands; alert
    messages appended to a topic folder (or Kafka via ``write_records``)."""
    from tickflow.operators import messages as msg
    alerts = tk.price_alerts(ticks_stream, rules)
    return (msg.price_alerts(alerts).writeStream.format("json").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append"))


def training_status_stream(log_stream: DataFrame, path: str, checkpoint: str,
                           compact_every: int | None = 100):
    """T5 live: newest training status per symbol, update mode into a changelog."""
    latest = tk.latest_training_status(tk.training_status_updates(log_stream))
    return (latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(changelog_writer(path, "symbol", compact_every)))
