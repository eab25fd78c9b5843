"""Live operators with a state per key of their own: ring buffers (T7) and the status before a command.

Both run on ``transformWithStateInPandas`` with RocksDB state: a micro-batch
reads and writes the state of the keys it touches, and no other.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.functions.processors import BUFFERS, COMMAND, RingBuffer, StatusBefore
from tickflow.operators import events as evo
from tickflow.streaming.live import changelog_writer, read_changelog

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB (the session's own choice is put back after)."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")).alias(column)


def _time(column: str) -> Column:
    return F.timestamp_micros(column).cast("timestamp_ntz").alias(column)


# -- T7: the last n trades per symbol ----------------------------------------------------

def ring_buffer_stream(ticks_stream: DataFrame, path: str, checkpoint: str, n: int = S.RING_BUFFER):
    """T7 live: the buffers of the symbols of each micro-batch, appended to a changelog.

    Start it inside :func:`rocksdb_state`.  A trade without symbol, time or
    price is no trade and is left out.
    """
    rows = ticks_stream.select("symbol", "trade_id", _micros("ts"), "price",
                               F.coalesce("size", F.lit(0)).cast("long").alias("size")).dropna()
    out = rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=RingBuffer(n), outputStructType=BUFFERS, outputMode="Update", timeMode="None")
    return (out.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(changelog_writer(path)))


def ring_buffer_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest buffer of each symbol: the rows of the last batch that touched it."""
    rows = read_changelog(spark, path)
    newest = rows.groupBy("symbol").agg(F.max("batch_id").alias("batch_id"))
    return (rows.join(newest, ["symbol", "batch_id"], "left_semi")
            .select("trade_id", "symbol", _time("ts"), "price", "size"))


# -- C1: the status of an aggregate when a command comes --------------------------------

def commands_stream(log_stream: DataFrame, command_stream: DataFrame, path: str, checkpoint: str):
    """C1 live: RequestAnalysis commands become AnalysisRequested events as they arrive, beside the log.

    Start it inside :func:`rocksdb_state`.
    """
    none = F.lit(None).cast("string")
    events = evo.status_changes(log_stream).select(
        "aggregate_id", _micros("timestamp"), "seq", F.lit(0).alias("kind"), "status",
        none.alias("command_id"), none.alias("metadata"))
    asked = command_stream.select(
        "aggregate_id", _micros("timestamp"), "seq", F.lit(1).alias("kind"),
        none.alias("status"), "command_id", "metadata")
    told = events.unionByName(asked).groupBy("aggregate_id").transformWithStateInPandas(
        statefulProcessor=StatusBefore(S.STATUS_IDLE), outputStructType=COMMAND, outputMode="Append", timeMode="None")
    out = evo.requested_events(told.withColumn("timestamp", _time("timestamp")))
    return (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append"))
