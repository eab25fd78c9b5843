"""Streams against their batch twins: time-ordered files, bounded runs."""

import pytest
from pyspark.sql import functions as F

from tickflow.operators import readmodel as rmo
from tickflow.operators import ticks as tk
from tickflow.sources import fixtures as fx
from tickflow.sources.tables import Tables
from tickflow.streaming import live


@pytest.fixture(scope="module")
def stream_files(spark, sf_dir):
    """``events`` split into 6 time-ordered parquet files (one folder)."""
    ev = Tables(spark, sf_dir).events
    path = live.scratch(spark, "events-files")
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    bounds = ev.select(F.min(secs).alias("lo"), F.max(secs).alias("hi")).collect()[0]
    step = (bounds["hi"] - bounds["lo"]) / 6 + 1
    part = F.floor((secs - bounds["lo"]) / step)
    for k in range(6):
        ev.filter(part == k).coalesce(1).write.mode("overwrite").parquet(f"{path}/part{k}")
    return path, ev.schema


def _files_stream(spark, stream_files):
    path, schema = stream_files
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(path))


def test_ohlcv_append_equals_batch_minus_open_windows(spark, sf_dir, stream_files):
    src = _files_stream(spark, stream_files)
    out, ckpt = live.scratch(spark, "o"), live.scratch(spark, "oc")
    live.run_available(live.ohlcv_stream(fx.events_as_ticks(src), out, ckpt, "1 hour", "1 hour"))
    got = spark.read.parquet(out)
    batch = tk.ohlcv(fx.events_as_ticks(Tables(spark, sf_dir).events), "1 hour")
    cols = ["symbol", "open", "high", "low", "close", "volume", "trades"]
    g = got.select(F.col("ts").cast("timestamp_ntz").alias("ts"), *cols)
    # every emitted window equals its batch window
    assert g.exceptAll(batch.select("ts", *cols)).count() == 0
    # only windows within the watermark delay of the end are still open
    last = batch.agg(F.max("ts_end")).collect()[0][0]
    missing = batch.select("ts", *cols).exceptAll(g)
    assert missing.filter(F.col("ts") < F.lit(last) - F.expr("INTERVAL 2 HOURS")).count() == 0
    assert g.count() > 0.9 * batch.count()


def test_ohlcv_update_stream_has_open_windows(spark, sf_dir, stream_files):
    """Six micro-batches, some windows updated in several: all bars, the last ones too."""
    out, ckpt = live.scratch(spark, "ou"), live.scratch(spark, "ouc")
    src = fx.events_as_ticks(_files_stream(spark, stream_files))
    live.run_available(live.ohlcv_update_stream(src, out, ckpt, "1 hour", "1 hour", compact_every=2))
    batch = tk.ohlcv(fx.events_as_ticks(Tables(spark, sf_dir).events), "1 hour")
    got = live.ohlcv_table(spark, out)
    assert got.schema.simpleString() == batch.schema.simpleString()
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_ohlcv_query_equals_batch(spark, sf_dir):
    import __spark_entry__ as entry

    got, batch = (entry.queries()[q](spark, sf_dir) for q in ("ohlcv_1min_stream", "ohlcv_1min"))
    assert got.exceptAll(batch.select(*got.columns)).count() == 0
    assert got.count() == batch.count()


def test_read_model_stream_equals_batch(spark, sf_dir, stream_files):
    src = _files_stream(spark, stream_files)
    out, ckpt = live.scratch(spark, "rm"), live.scratch(spark, "rmc")
    live.run_available(live.read_model_stream(fx.event_log(src), out, ckpt))
    got = live.read_model_table(spark, out)
    batch = rmo.read_model(fx.event_log(Tables(spark, sf_dir).events))
    assert got.count() == batch.count()
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


def test_dedup_stream_drops_redeliveries(spark, sf_dir, stream_files):
    src = _files_stream(spark, stream_files)
    doubled = src.unionByName(src)
    out, ckpt = live.scratch(spark, "d"), live.scratch(spark, "dc")
    live.run_available(live.dedup_stream(doubled, out, ckpt))
    got = spark.read.parquet(out)
    ev = Tables(spark, sf_dir).events
    assert got.count() == ev.count()
    assert got.select("event_id").distinct().count() == ev.count()


def test_restart_resumes_from_checkpoint(spark, stream_files):
    """A second run on the same checkpoint adds nothing (exactly-once sink)."""
    out, ckpt = live.scratch(spark, "r"), live.scratch(spark, "rc")
    live.run_available(live.append_log(fx.event_log(_files_stream(spark, stream_files)), out, ckpt))
    n = spark.read.parquet(out).count()
    live.run_available(live.append_log(fx.event_log(_files_stream(spark, stream_files)), out, ckpt))
    assert spark.read.parquet(out).count() == n


def test_live_bars_callback(spark, sf_dir):
    import __spark_entry__ as entry

    got, batch = (entry.queries()[q](spark, sf_dir) for q in ("live_bars_stream", "live_bars"))
    assert sorted(map(tuple, got.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_training_status_stream_equals_batch(spark, sf_dir, stream_files):
    src = fx.event_log(_files_stream(spark, stream_files))
    out, ckpt = live.scratch(spark, "ts"), live.scratch(spark, "tsc")
    live.run_available(live.training_status_stream(src, out, ckpt))
    got = live.read_changelog(spark, out, "symbol")
    batch = tk.latest_training_status(tk.training_status_updates(
        fx.event_log(Tables(spark, sf_dir).events)))
    assert got.exceptAll(batch.select(*got.columns)).count() == 0
    assert got.count() == batch.count()


def test_alerts_stream_equals_batch(spark, sf_dir, stream_files):
    ticks = fx.events_as_ticks(Tables(spark, sf_dir).events)
    rules = fx.alert_rules(ticks)
    out, ckpt = live.scratch(spark, "al"), live.scratch(spark, "alc")
    live.run_available(live.alerts_stream(fx.events_as_ticks(_files_stream(spark, stream_files)),
                                          rules, out, ckpt))
    got = spark.read.schema("topic string, key string, value string").json(out)
    assert got.count() == tk.price_alerts(ticks, rules).count()


def test_changelog_compaction_keeps_newest_rows(spark, sf_dir, stream_files):
    """Compacting every 2 batches gives the same read model as no compaction."""
    src = fx.event_log(_files_stream(spark, stream_files))
    out, ckpt = live.scratch(spark, "cm"), live.scratch(spark, "cmc")
    live.run_available(live.read_model_stream(src, out, ckpt, compact_every=2))
    assert spark.read.parquet(f"{out}/snapshot").select("version").distinct().count() >= 2
    got = live.read_model_table(spark, out)
    batch = rmo.read_model(fx.event_log(Tables(spark, sf_dir).events))
    assert got.count() == batch.count()
    assert got.exceptAll(batch.select(*got.columns)).count() == 0
