"""Consuming topics: decoding with a corrupt-record branch (S6), stops when idle or satisfied."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tickflow import schemas as S

CORRUPT = "_corrupt"


# -- S6: decode, and keep what does not decode --------------------------------------

def decode_all(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """``messages`` plus ``msg`` (the decoded value) and ``corrupt`` (the raw value where it does not decode, else null).

    A value that is no JSON object of the schema, and a null value (raw ''), are corrupt: every message
    comes out once, on one side or the other.
    """
    held = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    msg = F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = messages.withColumn("msg", msg)
    broken = F.col("msg").isNull() | F.col(f"msg.{CORRUPT}").isNotNull()
    return (out.withColumn("corrupt", F.when(broken, F.coalesce("value", F.lit(""))))
            .withColumn("msg", F.when(~broken, F.col("msg").dropFields(CORRUPT))))


def topic_writer(schema: T.StructType, path: str, types: list[str] | None = None):
    """foreachBatch function: decoded messages (of ``types``) to ``path/decoded``, the others to ``path/corrupt``.

    Each batch overwrites its own folder in both, so a batch that is run
    again replaces its output.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by two writes, as large as one micro-batch
        try:
            both = decode_all(batch, schema)
            good = both.where("corrupt is null")
            if types:
                good = good.where(F.col("msg.type").isin(types))
            good.drop("corrupt", "value").write.mode("overwrite").parquet(f"{path}/decoded/batch_id={batch_id}")
            (both.where("corrupt is not null").drop("msg", "value")
             .write.mode("overwrite").parquet(f"{path}/corrupt/batch_id={batch_id}"))
        finally:
            batch.unpersist()
    return write


# -- T8: bounded consumption ----------------------------------------------------------

class IdleStop(StreamingQueryListener):
    """Notes when each query last read a row or finished a batch of rows."""

    def __init__(self):
        self.busy: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:
        self.busy[str(event.id)] = time.monotonic()

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.busy[str(event.progress.id)] = time.monotonic()

    def onQueryIdle(self, event) -> None:
        self.busy.setdefault(str(event.id), time.monotonic())

    def onQueryTerminated(self, event) -> None:
        self.busy.pop(str(event.id), None)


def run_until(writer, spark: SparkSession, idle: float | None = None, elapsed: float | None = None, done=None,
              every: str = "0 seconds", poll: float = 0.1) -> str:
    """Run a stream until nothing came for ``idle`` seconds, ``elapsed`` seconds are over, or ``done()``; says which.

    A batch under way is finished before the stream stops, and its
    checkpoint lets the next run go on.  An error of the stream is raised.
    """
    listener = IdleStop()
    spark.streams.addListener(listener)
    query: StreamingQuery | None = None
    try:
        query = writer.trigger(processingTime=every).start()
        began = time.monotonic()
        listener.busy.setdefault(str(query.id), began)
        while True:
            if query.awaitTermination(poll):
                return "ended"
            now = time.monotonic()
            if done is not None and done():
                return "done"
            if elapsed is not None and now - began >= elapsed:
                return "elapsed"
            working = query.status["isTriggerActive"] and query.status["isDataAvailable"]
            if idle is not None and not working and now - listener.busy.get(str(query.id), began) >= idle:
                return "idle"
    finally:
        if query is not None:
            while query.isActive and query.status["isTriggerActive"] and query.status["isDataAvailable"]:
                time.sleep(poll)
            query.stop()
        spark.streams.removeListener(listener)


# -- S8: the first historical message of each requested symbol ------------------------

def history_stream(messages: DataFrame, symbols: DataFrame, path: str, checkpoint: str, idle: float = 5.0,
                   elapsed: float | None = None) -> str:
    """Read a topic until every symbol of ``symbols`` has its first ``historical`` message; says why it stopped.

    The messages (``key``, ``value``, ``offset``, in the order of the offsets)
    of requested symbols that have none yet are kept per batch under
    ``path``; :func:`history_table` turns them into bars.  The check after a
    batch counts symbols, it does not collect them.
    """
    spark = messages.sparkSession
    wanted = symbols.select(F.upper("symbol").alias("symbol")).distinct()
    total = wanted.count()
    state = {"open": total}

    def keep(batch: DataFrame, batch_id: int) -> None:
        m = F.from_json("value", S.HISTORY_MESSAGE)
        found = (batch.select("key", "value", "offset", m.alias("m")).where(F.col("m.type") == S.MSG_HISTORICAL)
                 .select(F.upper("m.symbol").alias("symbol"), "key", "value", "offset")
                 .join(wanted, "symbol", "left_semi"))
        first = found.groupBy("symbol").agg(F.min_by(F.struct("key", "value", "offset"), F.struct("offset", "key")).alias("f"))
        first = first.select("symbol", "f.*")
        earlier = _before(spark, path, batch_id)
        if earlier is not None:
            first = first.join(earlier, "symbol", "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        have = _before(spark, path, batch_id + 1)
        state["open"] = total - (have.distinct().count() if have is not None else 0)

    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep)
    if not total:
        return "done"
    return run_until(writer, spark, idle=idle, elapsed=elapsed, done=lambda: state["open"] <= 0)


FIRST_MESSAGES = "symbol string, key string, value string, offset bigint, batch_id bigint"


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The symbols served by batches before ``batch_id``."""
    if batch_id <= 0:
        return None
    return spark.read.schema(FIRST_MESSAGES).parquet(path).where(F.col("batch_id") < batch_id).select("symbol")


def first_messages(spark: SparkSession, path: str) -> DataFrame:
    """The messages kept by :func:`history_stream`."""
    return spark.read.schema(FIRST_MESSAGES).parquet(path).drop("batch_id")
