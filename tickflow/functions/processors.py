"""Python side of the operators with a state per key (run inside tasks).

Only pandas and pyspark are referenced, and the module is registered to be
pickled by value, so executors run these without the package being installed
there.  Times are microseconds, so no time zone touches them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

TRADE = T.StructType([T.StructField("trade_id", T.LongType()), T.StructField("ts", T.LongType()),
                      T.StructField("price", T.DoubleType()), T.StructField("size", T.LongType())])
BUFFERS = T.StructType([T.StructField("symbol", T.StringType()), *TRADE.fields])
COMMAND = T.StructType([
    T.StructField("command_id", T.StringType()), T.StructField("aggregate_id", T.StringType()),
    T.StructField("metadata", T.StringType()), T.StructField("timestamp", T.LongType()),
    T.StructField("previous_status", T.StringType())])


class RingBuffer(StatefulProcessor):
    """Per symbol a list state of its newest ``n`` trades, by (ts, trade_id); a touched symbol's buffer comes out whole."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        self.buffer = handle.getListState("buffer", TRADE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = TRADE.names
        held = pd.DataFrame([tuple(row) for row in self.buffer.get()], columns=names)
        for part in rows:  # never more than the buffer and one Arrow batch at a time
            both = part[names] if held.empty else pd.concat([held, part[names]])
            held = both.sort_values(["ts", "trade_id"]).tail(self.n)
        self.buffer.put([(int(i), int(t), float(p), int(s)) for i, t, p, s in held.itertuples(index=False)])
        yield held.assign(symbol=key[0])[BUFFERS.names]

    def close(self) -> None:
        pass


class StatusBefore(StatefulProcessor):
    """Per aggregate a value state of its status; commands come out with the status before them.

    Rows of a micro-batch are taken by time, events before commands of the
    same instant; an event older than the newest seen does not change the
    status (in-order input has none).
    """

    def __init__(self, idle: str):
        self.idle = idle

    def init(self, handle) -> None:
        self.status = handle.getValueState("status", "status string, ts long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["timestamp", "kind", "seq"])  # an aggregate's part of one micro-batch
        status, at = self.idle, None
        if self.status.exists():
            status, *at = self.status.get()
            at = tuple(at)
        out = []
        for r in batch.itertuples(index=False):
            if r.kind:
                out.append((r.command_id, key[0], r.metadata, r.timestamp, status))
            elif r.timestamp == r.timestamp and (at is None or (r.timestamp, r.seq) >= at):  # one without a time sets nothing
                status, at = r.status, (r.timestamp, r.seq)
        if at is not None:
            self.status.update((status, int(at[0]), int(at[1])))
        if out:
            yield pd.DataFrame(out, columns=COMMAND.names).astype({"timestamp": "Int64"})  # a command may have no time

    def close(self) -> None:
        pass


cloudpickle.register_pickle_by_value(sys.modules[__name__])
