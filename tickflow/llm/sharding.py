"""Operator 7: shards of near-equal bytes by sampled splitters.

Method.  A record's key is (hash of its text, hash of its id): equal texts lie
side by side.  A size-weighted sample of keys gives quantile boundaries of
many fine ranges; records are range-partitioned by them, which subdivides a
range that one text would overfill (its copies differ in the second part).
Exact bytes and rows of each range, a small table, then place every range:
a record's position in bytes decides its shard, so sizes are equal up to a
group of copies of at most ``keep_share`` of a shard, or one record.

All of it is DataFrame functions but the search of a key among the sorted
splitters.  The records are shuffled once, by range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickflow.llm.frames import outputs_last

#: Bytes aimed at in one fine range (one task's sort), and how many ranges a shard has.
RANGE_BYTES, RANGES_A_SHARD = 64 << 20, (16, 1024)
#: Sampled keys for each range.
KEYS_A_RANGE = 16
#: Copies of a text up to this share of a shard stay together.
KEEP_SHARE = 0.01


def record_size(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long")


def range_of(high: np.ndarray, low: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Number of splitters (sorted pairs) at or below each key (high, low)."""
    out = np.searchsorted(splitters[:, 0], high, "left")
    end = np.searchsorted(splitters[:, 0], high, "right")
    for i in np.unique(out[end > out]):  # a text that splitters cut: by the second part
        same = (out == i) & (end > out)
        stop = end[same][0]
        out[same] = i + np.searchsorted(splitters[i:stop, 1], low[same], "right")
    return out


def shard(docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id",
          keep_share: float = KEEP_SHARE) -> DataFrame:
    """``docs`` plus size (long), law ('bytes'), shard (int from 0), slot (long, gapless from 0), grown_shard (null).

    Order within the shards is by text hash, id hash and id; a null text has
    size 8, a null id sorts first; equal rows take neighbouring slots.  An
    empty table gives no rows.  Columns named like an output are replaced.
    The law is equal bytes, which a further shard moves, so ``grown_shard`` is
    null.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("__key"),
                       record_size(text).alias("__size"), F.xxhash64(F.lit(7), F.col(text)).alias("__high"),
                       F.xxhash64(F.lit(11), F.col(key)).alias("__low"))
    total = rows.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    ranges = int(min(max(total // RANGE_BYTES, shards * RANGES_A_SHARD[0]), shards * RANGES_A_SHARD[1]))
    # each record drawn with a chance in proportion to its size, one draw for each step of bytes: by a hash, so that
    # a task run again draws the same
    step = max(total / (ranges * KEYS_A_RANGE), 1.0)
    chance = F.pmod(F.xxhash64(F.lit(13), "__high", "__low"), F.lit(1 << 53)) / float(1 << 53)
    draws = F.floor(F.col("__size") / step + chance).cast("int")
    sample = rows.where(draws > 0).select("__high", "__low", draws.alias("n")).toPandas()  # about ranges x KEYS_A_RANGE
    sample = sample.sort_values(["__high", "__low"])
    weight = sample["n"].cumsum().to_numpy()
    pick = np.searchsorted(weight, np.arange(1, ranges) * weight[-1] / ranges) if len(sample) else []
    splitters = sample[["__high", "__low"]].to_numpy(np.int64).reshape(-1, 2)[np.unique(pick).astype(int)]
    text_of, times = np.unique(splitters[:, 0], return_counts=True)
    alone = np.isin(splitters[:, 0], text_of[times == 1])
    splitters[alone, 1] = np.iinfo(np.int64).min  # only texts that overfill a range are cut

    @F.pandas_udf("int")
    def find(high: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series(range_of(high.to_numpy(), low.to_numpy(), splitters))

    ranged = rows.withColumn("__range", find("__high", "__low"))
    table = (ranged.groupBy("__range").agg(F.sum("__size").alias("bytes"), F.count("*").alias("n"))
             .toPandas().sort_values("__range"))  # at most ``ranges`` rows
    before = pd.DataFrame({"__range": table["__range"].astype("int32"),
                           "__bytes": (table["bytes"].cumsum() - table["bytes"]).astype("int64")})
    starts = docs.sparkSession.createDataFrame(before, "__range int, __bytes long")
    order = Window.partitionBy("__range").orderBy("__high", "__low", "__key")
    first = Window.partitionBy("__range", "__high")
    target = total / shards if total else 1.0
    placed = (ranged.join(F.broadcast(starts), "__range")
              .withColumn("__at", F.col("__bytes") + F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("__at", F.coalesce("__at", "__bytes"))
              .withColumn("__group_at", F.min("__at").over(first))
              .withColumn("__group_size", F.sum("__size").over(first))
              # a small group goes where its middle is, a larger one is cut at the exact byte
              .withColumn("__at", F.when(F.col("__group_size") <= keep_share * target,
                                         F.col("__group_at") + F.col("__group_size") / 2)
                          .otherwise(F.col("__at") + F.col("__size") / 2))
              .withColumn("__shard", F.least(F.lit(shards - 1), F.floor(F.col("__at") / target)).cast("int")))
    counts = (placed.groupBy("__shard", "__range").agg(F.count("*").alias("n"))
              .toPandas().sort_values(["__shard", "__range"]))  # at most ranges + shards rows
    base = counts.assign(base=counts.groupby("__shard")["n"].cumsum() - counts["n"])[["__shard", "__range", "base"]]
    bases = docs.sparkSession.createDataFrame(base.astype({"__shard": "int32", "__range": "int32", "base": "int64"}),
                                              "__shard int, __range int, __base long")
    within = Window.partitionBy("__range", "__shard").orderBy("__high", "__low", "__key")
    slotted = (placed.withColumn("__slot", F.row_number().over(within).cast("long") - 1)
               .join(F.broadcast(bases), ["__shard", "__range"])
               .withColumn("__slot", F.col("__slot") + F.col("__base")))
    return outputs_last(slotted, "row", size="__size", law=F.lit("bytes"), shard="__shard", slot="__slot",
                        grown_shard=F.lit(None).cast("int"))
