"""Positions inside a key without sending a whole key to one task.

``row_number() OVER (PARTITION BY key ORDER BY ts)`` sorts every row of a
key in one task; with one key holding a third of the log that task is the
job.  Here the key is split into time buckets: bucket sizes are counted by
partial aggregation, their running offsets come from the small
(key, bucket) count table, and rows are numbered inside (key, bucket) only.
The result equals the plain window, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickflow.functions.timecols import floor_time


def positions(df: DataFrame, key: str, order: list[str], ts: str, unit: str = "day",
              counters: dict[str, Column] | None = None) -> DataFrame:
    """Add ``pos`` (1-based rank of the row inside ``key`` by ``order``) and,
    for each ``name -> boolean column`` in ``counters``, a running count
    ``name`` of rows up to and including this one where the flag holds.

    ``order`` must start with the time column ``ts`` that the buckets cut
    (``floor_time(ts, unit)``) and be a total order inside the key.
    """
    counters = counters or {}
    flagged = df.withColumn("_b", floor_time(F.col(ts), unit))
    for name, cond in counters.items():
        flagged = flagged.withColumn(f"_f_{name}", F.when(cond, 1).otherwise(0))
    sums = [F.count(F.lit(1)).alias("_n")] + [F.sum(f"_f_{n}").alias(f"_s_{n}") for n in counters]
    per_bucket = flagged.groupBy(key, "_b").agg(*sums)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        key, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in counters])
    inside = Window.partitionBy(key, "_b").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = flagged.join(offsets, [key, "_b"])
    out = out.withColumn("pos", F.row_number().over(inside) + F.col("_off"))
    for n in counters:
        out = out.withColumn(n, (F.sum(f"_f_{n}").over(running) + F.col(f"_o_{n}")).cast("bigint"))
    drop = ["_b", "_off"] + [f"_f_{n}" for n in counters] + [f"_o_{n}" for n in counters]
    return out.drop(*drop).withColumn("pos", F.col("pos").cast("bigint"))
