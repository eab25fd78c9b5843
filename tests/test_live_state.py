"""Event store, keyed states, upserts, topics: failures, repeated batches, restarts, stops."""

import threading
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow import schemas as S
from tickflow.operators import events as evo
from tickflow.operators import forecast as fc
from tickflow.operators import ticks as tk
from tickflow.plans.market_queries import bars
from tickflow.sources import fixtures as fx
from tickflow.sources import history as hist
from tickflow.sources.tables import Tables
from tickflow.streaming import live, stateful, store, topics, upserts

LOG = T.StructType([T.StructField(name, kind) for name, kind in (
    ("event_id", T.StringType()), ("event_type", T.StringType()), ("aggregate_id", T.StringType()),
    ("timestamp", T.TimestampNTZType()), ("seq", T.LongType()))])
T0 = datetime(2024, 1, 1, 9)


@pytest.fixture(scope="module")
def stream_files(spark, sf_dir):
    """``events`` split into 5 time-ordered parquet files (one folder)."""
    ev = Tables(spark, sf_dir).events
    path = live.scratch(spark, "state-files")
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    lo, hi = ev.select(F.min(secs), F.max(secs)).first()
    for k in range(5):
        ev.where(F.floor((secs - lo) * 5 / (hi - lo + 1)) == k).coalesce(1).write.parquet(f"{path}/part{k}")
    return path, ev.schema


def files(spark, stream_files):
    path, schema = stream_files
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(path))


def same(a, b):
    return sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))


# -- S7 -------------------------------------------------------------------------------

def events_of(spark, ids, kind="A"):
    return spark.createDataFrame([(i, kind, "X", T0 + timedelta(days=int(i or 0) % 3), int(i or 0)) for i in ids], LOG)


def test_store_dispatches_what_was_written(spark):
    got, fails = [], {"on": True}
    es = store.EventStore(spark, live.scratch(spark, "es"), LOG)

    def broken(df, batch):
        if fails["on"]:
            raise RuntimeError("down")
        got.append(("late", batch, sorted(r["event_id"] for r in df.collect())))

    es.register("A", "broken", broken)
    es.register("A", "fine", lambda df, batch: got.append(("fine", batch, sorted(r["event_id"] for r in df.collect()))))
    es.register("B", "fine", es.handlers["fine"][1])
    es.register("C", "other", lambda df, batch: got.append(("other", batch, df.count())))
    assert es.append(events_of(spark, ["1", "2", "2"]), "one")
    assert got == [("fine", "one", ["1", "2"]), ("other", "one", 0)]
    # only new events are written and handed on; other types reach their handlers
    assert es.append(events_of(spark, ["2", "3"]).union(events_of(spark, ["4"], "B")).union(events_of(spark, ["5"], "D")), "two")
    assert got[2:] == [("fine", "two", ["3", "4"]), ("other", "two", 0)]
    assert sorted(r["event_id"] for r in es.committed().collect()) == ["1", "2", "3", "4", "5"]
    # what the failing handler missed is known, and delivered later
    assert [tuple(r) for r in es.undelivered().collect()] == [("one", "broken"), ("two", "broken")]
    assert es.outcomes().where("not ok").select("error").distinct().collect()[0][0] == "down"
    fails["on"] = False
    es.redeliver()
    assert [g for g in got if g[0] == "late"] == [("late", "one", ["1", "2"]), ("late", "two", ["3"])]
    assert es.undelivered().isEmpty()


def test_store_failed_write_is_invisible(spark):
    calls = []
    es = store.EventStore(spark, live.scratch(spark, "es"), LOG)
    es.register("A", "h", lambda df, batch: calls.append((batch, df.count())))
    bad = events_of(spark, ["1", "2"]).withColumn("aggregate_id", F.concat("aggregate_id", F.raise_error(F.lit("no disk"))))
    assert es.append(bad, "one") is False
    assert calls == [] and es.committed().isEmpty() and es.commits().isEmpty()
    # a folder that a failed attempt left is not read, and the retry overwrites it
    events_of(spark, ["8", "9"]).withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date").parquet(f"{es.path}/events/batch=one")
    assert es.committed().isEmpty()
    assert es.append(events_of(spark, ["1", "2"]), "one") and es.append(events_of(spark, ["1", "2"]), "one")
    assert sorted(r["event_id"] for r in es.committed().collect()) == ["1", "2"]
    assert calls == [("one", 2), ("one", 2)]  # an acknowledged batch that comes again is handed on again, not written
    assert es.append(events_of(spark, []), "none") and es.commits().where("batch = 'none'").first()["events"] == 0


def test_store_events_without_id_or_time(spark):
    es = store.EventStore(spark, live.scratch(spark, "es"), LOG)
    rows = [(None, "A", "X", T0, 1), (None, "A", "X", T0, 1), (None, "A", "Y", T0, 1), ("7", "A", "X", None, 2), ("7", "A", "X", None, 2)]
    for batch in ("one", "two"):
        assert es.append(spark.createDataFrame(rows, LOG), batch)
    assert es.committed().count() == 3


# -- T7, C1 ---------------------------------------------------------------------------

def test_ring_buffer_state_equals_batch(spark, sf_dir, stream_files):
    out, ckpt = live.scratch(spark, "ring"), live.scratch(spark, "ringc")
    with stateful.rocksdb_state(spark):
        live.run_available(stateful.ring_buffer_stream(fx.events_as_ticks(files(spark, stream_files)), out, ckpt, 30))
    assert spark.read.parquet(f"{out}/log").select("batch_id").distinct().count() == 5
    assert same(stateful.ring_buffer_table(spark, out), tk.last_n(fx.events_as_ticks(Tables(spark, sf_dir).events), 30))


def test_ring_buffer_writes_touched_symbols_only(spark):
    path, out, ckpt = (live.scratch(spark, k) for k in ("tr", "ring", "ringc"))
    schema = T.StructType.fromDDL("trade_id bigint, symbol string, ts timestamp_ntz, price double, size bigint")
    for k, rows in enumerate([[(1, "a", T0, 1.0, 1), (2, "b", T0, 1.0, None)], [(3, "a", T0, 2.0, 1), (4, None, T0, 2.0, 1), (5, "a", None, 2.0, 1)],
                              [(6, "a", T0 + timedelta(seconds=1), 3.0, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        with stateful.rocksdb_state(spark):
            live.run_available(stateful.ring_buffer_stream(live.folder_stream(spark, path, schema), out, ckpt, 2))
    log = {(r["batch_id"], r["symbol"], r["trade_id"]) for r in spark.read.parquet(f"{out}/log").collect()}
    assert {(b, s) for b, s, _ in log} == {(0, "a"), (0, "b"), (1, "a"), (2, "a")}
    assert sorted((r["symbol"], r["trade_id"]) for r in stateful.ring_buffer_table(spark, out).collect()) == [("a", 3), ("a", 6), ("b", 2)]


def test_commands_stream_equals_batch(spark, sf_dir, stream_files):
    out, ckpt = live.scratch(spark, "cmd"), live.scratch(spark, "cmdc")
    with stateful.rocksdb_state(spark):
        live.run_available(stateful.commands_stream(
            fx.event_log(files(spark, stream_files)), fx.commands(files(spark, stream_files)), out, ckpt))
    ev = Tables(spark, sf_dir).events
    batch = evo.commands_to_events(fx.commands(ev), fx.event_log(ev))
    assert same(spark.read.parquet(out), batch)
    assert batch.select("previous_status").distinct().count() > 1


# -- T9, T10 --------------------------------------------------------------------------

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"


def bar(symbol, day, price):
    return (symbol, T0 + timedelta(days=day), price, price, price, price, 1)


def test_bar_merge_is_safe_to_repeat(spark):
    table, staging = live.scratch(spark, "bars"), live.scratch(spark, "staging")
    upserts.write_bars(spark.createDataFrame([bar("a", d, 1.0) for d in range(4)], BAR), table)
    write = upserts.bar_merge_writer(table, staging)
    first = spark.createDataFrame([bar("a", 3, 2.0), bar("b", 3, 2.0), bar("a", 4, 2.0)], BAR)
    read = lambda: sorted((r["symbol"], (r["ts"] - T0).days, r["close"]) for r in upserts.read_bars(spark, table).collect())
    expected = [("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 2.0), ("a", 4, 2.0), ("b", 3, 2.0)]
    write(first, 0)
    assert read() == expected
    write(first, 0)
    assert read() == expected
    # a batch whose copy was cut short: its merge is found and copied again
    second = spark.createDataFrame([bar("a", 3, 5.0), bar("a", 4, 6.0), bar("a", 4, 7.0)], BAR)
    write(second, 1)
    done = read()
    assert done == [*expected[:3], ("a", 3, 5.0), ("a", 4, 7.0), ("b", 3, 2.0)]
    spark.createDataFrame([bar("z", 3, 0.0)], BAR).withColumn("bar_date", F.to_date("ts")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bar_date").parquet(table)
    write(second, 1)
    assert read() == done
    write(spark.createDataFrame([], BAR), 2)
    assert read() == done
    # the update that arrived last wins
    write(spark.createDataFrame([(*bar("a", 4, 9.0), 1), (*bar("a", 4, 8.0), 2)], BAR + ", arrival int"), 3)
    assert ("a", 4, 8.0) in read()


def test_late_rows_are_kept_aside(spark):
    out, counts = live.scratch(spark, "late"), {}
    write = upserts.late_writer(out, "1 hour", counts=counts)
    row = lambda i, minutes: (i, None if minutes is None else T0 + timedelta(minutes=minutes))
    batches = [[row(1, 0), row(2, 100), row(1, 0)], [row(3, 41), row(4, 39), row(2, 100), row(5, 200), row(6, None)],
               [row(7, 139), row(8, 140), row(6, None), row(3, 41)]]
    frames = [spark.createDataFrame(b, "event_id bigint, ts timestamp_ntz") for b in batches]
    for k, df in enumerate(frames):
        write(df, k)
    write(frames[2], 2)  # a repeated batch replaces itself
    rows = [(r["event_id"], r["late"]) for r in upserts.late_tables(spark, out).collect()]
    assert sorted(rows) == [(1, False), (2, False), (3, False), (3, True), (4, True), (5, False), (6, False), (7, True), (8, False)]
    assert {i for i, _ in rows} == {i for b in batches for i, _ in b}
    assert counts == {0: {"rows": 3, "late": 0}, 1: {"rows": 5, "late": 1}, 2: {"rows": 4, "late": 2}}


# -- S6, S8, T8 -----------------------------------------------------------------------

def test_decode_all_keeps_every_message(spark):
    good = '{"type":"t","n":1}'
    values = [good, '{"type":"t","n":', "5", "[1]", None, "", '{"type":"t","n":"x"}', '{"other":1}']
    df = spark.createDataFrame([(str(i), v, "c") for i, v in enumerate(values)], "key string, value string, corrupt string")
    rows = {int(r["key"]): r for r in topics.decode_all(df, T.StructType.fromDDL("type string, n int")).collect()}
    assert rows[0]["msg"].asDict() == {"type": "t", "n": 1} and rows[0]["corrupt"] is None
    assert rows[7]["msg"].asDict() == {"type": None, "n": None} and rows[7]["corrupt"] is None
    for i in (1, 2, 3, 4, 5, 6):
        assert rows[i]["msg"] is None and rows[i]["corrupt"] == (values[i] or ""), i


def test_stream_stops_when_idle(spark):
    path, out = live.scratch(spark, "dry"), live.scratch(spark, "dry-out")
    spark.range(10).write.parquet(path)
    writer = lambda k: (live.folder_stream(spark, path, "id long").writeStream.format("parquet").option("path", out)
                        .option("checkpointLocation", f"{out}-ckpt"))
    feeder = threading.Timer(2.0, lambda: spark.range(10, 20).write.mode("append").parquet(path))
    feeder.start()
    assert topics.run_until(writer(0), spark, idle=8.0, elapsed=120) == "idle"
    feeder.join()
    assert spark.read.parquet(out).count() == 20  # the rows that came before it ran dry
    began = time.monotonic()
    assert topics.run_until(writer(1), spark, elapsed=1.0) == "elapsed"
    assert time.monotonic() - began < 60
    assert not spark.streams.active


def test_history_stream_stops_with_the_last_symbol(spark, sf_dir):
    messages = hist.history_messages(bars(spark, sf_dir)).select("key", "value", "offset")
    symbols = bars(spark, sf_dir).select("symbol").distinct()
    some = [r["symbol"] for r in symbols.orderBy("symbol").limit(2).collect()]
    path = live.scratch(spark, "hist")
    messages.where(F.upper("key").isin(some[0])).coalesce(1).write.mode("append").json(path)
    messages.where(F.upper("key").isin(some[1])).coalesce(1).write.mode("append").json(path)
    stream = lambda: live.folder_stream(spark, path, "key string, value string, offset bigint", 1, "json")
    asked = spark.createDataFrame([(some[0].lower(),), (some[1],)], "symbol string")
    out = live.scratch(spark, "hist-out")
    assert topics.history_stream(stream(), asked, out, live.scratch(spark, "c"), idle=60) == "done"
    assert same(hist.history_from_messages(topics.first_messages(spark, out)), hist.history_from_messages(messages, asked))
    missing = asked.union(spark.createDataFrame([("none",)], "symbol string"))
    assert topics.history_stream(stream(), missing, live.scratch(spark, "h2"), live.scratch(spark, "c2"), idle=6) == "idle"


# -- M2 -------------------------------------------------------------------------------

def test_pooled_fit_equals_numpy(spark, sf_dir):
    training = fc.training_set(bars(spark, sf_dir)).where("split = 'train' and not is_validation")
    rows = training.select("lags", "label").collect()
    z = np.hstack([np.ones((len(rows), 1)), np.array([r["lags"] for r in rows])])
    own, *_ = np.linalg.lstsq(z, np.array([r["label"] for r in rows]), rcond=None)
    intercept, coef = fc.fit_pooled(training)
    assert np.abs(np.array([intercept, *coef]) - own).max() < 1e-6
    with pytest.raises(ValueError, match="no rows"):
        fc.fit_pooled(training.limit(0))
    assert S.WINDOW_SIZE == len(coef)


# -- C7 -------------------------------------------------------------------------------

def test_result_documents_follow_the_fit(spark, sf_dir):
    from tickflow.operators import workflow as wf

    b = bars(spark, sf_dir)
    symbols = sorted(r["symbol"] for r in b.select("symbol").distinct().collect())
    coefs = fc.equal_weights(b).where(F.col("symbol") != symbols[0])  # one symbol was never fitted
    asked = b.select("symbol").distinct().union(spark.createDataFrame([("NONE",)], "symbol string"))
    docs = {r["symbol"]: r["document"] for r in wf.result_documents(asked, b, None, coefs, "2001-01-01 00:00:00").collect()}
    assert sorted(docs) == symbols
    for symbol, d in docs.items():
        trained = symbol != symbols[0]
        assert d["models_trained"].asDict() == {"lstm": trained, "prophet": False}
        assert (d["predictions"]["lstm_predictions"] is not None) == trained
        assert d["data"]["symbol"] == symbol and d["data"]["current_price"] > 0
        assert list(d["data"].asDict()) == ["symbol", *S.FALLBACK_CURRENT_DATA]
