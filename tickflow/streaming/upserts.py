"""Streams that keep a table current batch by batch: live bars into the stored ones (T9), late rows set aside.

Both write with ``foreachBatch`` and are safe to run again: a batch that is
repeated after a lost driver leaves the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.operators import ticks as tk
from tickflow.operators.messages import JSON_OPTIONS
from tickflow.session import path_exists

# -- T9: live bars merged into the table a predictor reads --------------------------------


def write_bars(bars: DataFrame, path: str) -> None:
    """The stored bars, partitioned by day."""
    bars.select(*S.BAR_COLUMNS).withColumn("bar_date", F.to_date("ts")).write.mode("overwrite").partitionBy("bar_date").parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*S.BAR_COLUMNS)


def bar_merge_writer(path: str, staging: str):
    """foreachBatch function: upsert a batch of live bars into the table at ``path``.

    Only the days that the batch touches are read, merged and rewritten.  The
    merged days are written to ``staging`` first, under the batch's number,
    and copied from there: a batch repeated after a failure in the copy finds
    its merge done and copies it again, so a half-copied day is never merged
    from.  Several updates of one bar in a batch: the one that came last wins
    (``arrival``, where the batch has that column), else the greatest.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = f"{staging}/batch_id={batch_id}"
        if not path_exists(spark, f"{staged}/_SUCCESS"):
            values = F.struct(*[c for c in S.BAR_COLUMNS if c not in ("symbol", "ts")])
            order = F.struct("arrival", values) if "arrival" in batch.columns else values
            bars = batch.groupBy("symbol", "ts").agg(F.max_by(values, order).alias("b")).select("symbol", "ts", "b.*")
            bars = bars.withColumn("bar_date", F.to_date("ts"))
            days = bars.select("bar_date").distinct()
            stored = spark.read.parquet(path).join(days, "bar_date", "left_semi")  # partitions are pruned by the days
            merged = tk.merge_bars(stored, bars).withColumn("bar_date", F.to_date("ts"))
            merged.write.mode("overwrite").parquet(staged)
        (spark.read.parquet(staged).hint("rebalance", "bar_date").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bar_date").parquet(path))
    return write


def bar_messages(batch: DataFrame) -> DataFrame:
    """Bars from ``ohlcv_1min`` messages (``value`` as S9 hands it on)."""
    m = F.from_json("value", "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume bigint",
                    JSON_OPTIONS)
    return batch.select(m.alias("m")).select("m.symbol", F.col("m.timestamp").alias("ts"), "m.open", "m.high", "m.low",
                                             "m.close", "m.volume")


# -- T10: redeliveries dropped, late rows kept aside ---------------------------------------

def late_writer(path: str, delay: str = "1 hour", key: str = "event_id", time: str = "ts", counts: dict | None = None):
    """foreachBatch function: each id once under ``path/kept``, rows behind the watermark under ``path/late``.

    The watermark of a batch is the newest time of all batches before it less
    ``delay``.  A row behind it is late and goes aside as it is; of the
    others those whose id is new are kept.  Ids are compared with the kept
    rows not behind the watermark only (an id keeps its time), so what is
    read per batch is the delay's share of the table, not all of it.  A row
    without a time is never late.  ``counts`` gets the rows of each batch:
    ``{batch_id: {"rows": ..., "late": ...}}``, as observed by the write.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = None
        if batch_id > 0:
            marks = spark.read.parquet(f"{path}/marks").where(F.col("batch_id") < batch_id)
            mark = marks.agg((F.max("newest") - F.expr(f"interval {delay}")).cast("string").alias("mark")).first()["mark"]
        behind = F.lit(mark).cast(batch.schema[time].dataType)  # null: nothing is late
        late = F.coalesce(F.col(time) < behind, F.lit(False))
        seen = Observation(f"late-{batch_id}")
        batch = batch.persist()
        try:
            judged = batch.withColumn("_late", late).observe(
                seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("_late"), 1)).alias("late"))
            judged.where("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
            fresh = batch.withColumn("_late", late).where("not _late").drop("_late").dropDuplicates([key])
            if batch_id > 0:
                kept = spark.read.parquet(f"{path}/kept").where(F.col("batch_id") < batch_id)
                if mark is not None:
                    kept = kept.where((F.col(time) >= behind) | F.col(time).isNull())
                fresh = fresh.join(kept.select(key), key, "left_anti")
            fresh.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/kept/batch_id={batch_id}")
            batch.agg(F.max(time).alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")
        finally:
            batch.unpersist()
        if counts is not None:
            counts[batch_id] = {k: seen.get[k] for k in ("rows", "late")}
    return write


def late_tables(spark: SparkSession, path: str) -> DataFrame:
    """Kept and late rows, told apart by ``late``."""
    kept = spark.read.parquet(f"{path}/kept").drop("batch_id").withColumn("late", F.lit(False))
    return kept.unionByName(spark.read.parquet(f"{path}/late").drop("batch_id").withColumn("late", F.lit(True)))
