"""Window specifications and the rolling-window helper.

All indicator windows are *row* frames over one symbol ordered by time, so a
bar table partitioned once by ``symbol`` and sorted once by ``ts`` serves
every indicator of a select: Spark plans one exchange and one sort for all
of them.  A rolling value exists only when the frame holds ``n`` non-null
inputs, which is what ``full`` expresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


Key = str | list[str]


def _keys(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def by_symbol(key: Key = "symbol", order: str | list[str] = "ts") -> WindowSpec:
    order_cols = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*_keys(key)).orderBy(*order_cols)


def trailing(n: int, key: Key = "symbol", order: str | list[str] = "ts") -> WindowSpec:
    """The last ``n`` rows up to and including the current one."""
    return by_symbol(key, order).rowsBetween(-(n - 1), Window.currentRow)


def full(fn, col: str | Column, n: int, key: Key = "symbol",
         order: str | list[str] = "ts") -> Column:
    """``fn(col)`` over the trailing ``n`` rows, null until ``n`` non-null inputs."""
    c = F.col(col) if isinstance(col, str) else col
    w = trailing(n, key, order)
    return F.when(F.count(c).over(w) >= n, fn(c).over(w))


def newest_first(key: Key = "symbol", order: str | list[str] = "ts") -> WindowSpec:
    order_cols = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*_keys(key)).orderBy(*[F.col(c).desc() for c in order_cols])


def carried(df: DataFrame) -> list[str]:
    """Internal columns (``_`` prefix) that window selects pass through."""
    return [c for c in df.columns if c.startswith("_")]


def halo_blocks(df: DataFrame, key: str, order: list[str], ts: str, halo: int,
                block_rows: int, unit: str = "day") -> DataFrame:
    """Cut every key into blocks of ``block_rows`` consecutive rows, each
    block also holding copies of the ``halo`` rows before it (``_halo``).

    Row frames of up to ``halo + 1`` rows and lags of up to ``halo`` rows
    computed per (key, ``_blk``) then equal the per-key result on the
    non-copied rows, so a symbol with a third of all bars runs as many
    parallel tasks as it has blocks.  Positions come from
    ``ordering.positions`` (no whole-key sort either); the copies add
    ``halo / block_rows`` of the rows.
    """
    from tickflow.functions.ordering import positions
    if halo > block_rows:
        raise ValueError("halo must not exceed block_rows")
    p = positions(df, key, order, ts, unit).withColumnRenamed("pos", "_pos")
    blk = F.floor((F.col("_pos") - 1) / block_rows)
    own = p.withColumn("_blk", blk).withColumn("_halo", F.lit(False))
    if halo == 0:
        return own
    copies = (p.filter((F.col("_pos") - 1) % block_rows >= block_rows - halo)
              .withColumn("_blk", blk + 1).withColumn("_halo", F.lit(True)))
    return own.unionByName(copies)


def split_windows(df: DataFrame, compute, halo: int, block_rows: int | None = None,
                  key: str = "symbol", order: str = "ts", unit: str = "day") -> DataFrame:
    """Run ``compute(df, partition_keys)`` — a select whose windows are
    partitioned by ``partition_keys`` and that keeps ``carried`` columns —
    either per ``key`` (default) or per halo block of ``block_rows`` rows.

    The block path reads its input several times (bucket counts, positions,
    halo copies), so the input is materialised once first."""
    if not block_rows:
        return compute(df, key)
    from tickflow.session import materialize
    blocks = halo_blocks(materialize(df), key, [order], order, halo, block_rows, unit)
    out = compute(blocks, [key, "_blk"])
    return out.filter(~F.col("_halo")).drop("_blk", "_halo", "_pos")
