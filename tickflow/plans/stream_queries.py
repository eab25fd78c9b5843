"""Registered streaming queries (S4-S6, S9, T1-T6, T8, T10); those with states and stores of their own are in ``live_queries``.

Each runs a bounded stream (``availableNow``) over the driver's tables into a
fresh folder under ``spark.checkpoint.dir`` and returns the sink read back;
those whose result equals a batch query's have its SQL twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.operators import messages as msg
from tickflow.operators import ticks as tk
from tickflow.plans import event_queries  # noqa: F401 - the batch twins
from tickflow.plans.message_queries import alert_fields, field
from tickflow.plans.oracle import with_fixtures
from tickflow.plans.registry import REGISTRY, register
from tickflow.sources import fixtures as fx
from tickflow.sources.tables import Tables
from tickflow.streaming import live


def _events(spark, sf_dir, max_files=None):
    return live.table_stream(spark, sf_dir, "events", live.EVENTS_SCHEMA, max_files)


@register("event_stream", ids=("T1", "S7", "T8"), sql=with_fixtures(
    "SELECT *, CAST(timestamp AS DATE) AS event_date FROM event_log", "event_log"))
def q_event_stream(spark, sf_dir):
    path, ckpt = live.scratch(spark, "log"), live.scratch(spark, "log-ckpt")
    live.run_available(live.append_log(fx.event_log(_events(spark, sf_dir)), path, ckpt))
    return spark.read.parquet(path)


@register("read_model_stream", ids=("T6", "T8"), sql=REGISTRY["read_model"].sql)
def q_read_model_stream(spark, sf_dir):
    path, ckpt = live.scratch(spark, "rm"), live.scratch(spark, "rm-ckpt")
    live.run_available(live.read_model_stream(fx.event_log(_events(spark, sf_dir)), path, ckpt))
    return live.read_model_table(spark, path)


@register("ohlcv_1min_stream", ids=("T2",), sql=REGISTRY["ohlcv_1min"].sql)
def q_ohlcv_1min_stream(spark, sf_dir):
    path, ckpt = live.scratch(spark, "ohlcv"), live.scratch(spark, "ohlcv-ckpt")
    live.run_available(live.ohlcv_update_stream(fx.events_as_ticks(_events(spark, sf_dir)), path, ckpt))
    return live.ohlcv_table(spark, path)


@register("events_dedup_stream", ids=("T10",), sql=REGISTRY["events_dedup"].sql)
def q_events_dedup_stream(spark, sf_dir):
    """Every click arrives twice (the stream unioned with its clicks, as an
    at-least-once consumer would deliver it); the watermarked dedup keeps one."""
    path, ckpt = live.scratch(spark, "dedup"), live.scratch(spark, "dedup-ckpt")
    src = _events(spark, sf_dir)
    doubled = src.unionByName(src.filter(F.col("event_type") == "click"))
    live.run_available(live.dedup_stream(doubled, path, ckpt))
    return spark.read.parquet(path)


@register("last_price_stream", ids=("T3",), sql=REGISTRY["last_price"].sql)
def q_last_price_stream(spark, sf_dir):
    path, ckpt = live.scratch(spark, "last"), live.scratch(spark, "last-ckpt")
    live.run_available(live.last_price_stream(fx.events_as_ticks(_events(spark, sf_dir)),
                                              path, ckpt))
    return live.read_changelog(spark, path, "symbol")


@register("live_bars_stream", ids=("S9", "S4", "S6"), sql=REGISTRY["live_bars"].sql)
def q_live_bars_stream(spark, sf_dir):
    """Bars go out as ``ohlcv_1min`` messages to a topic folder (S4), come back
    through a file stream (S6) and reach a per-batch callback (S9)."""
    topic = live.scratch(spark, "topic")
    t = fx.events_as_ticks(Tables(spark, sf_dir).events)
    if not msg.write_records(msg.ohlcv_messages(tk.ohlcv(t, "1 minute")), "json", path=topic):
        raise RuntimeError("the topic was not written")
    schema = "key string, value string"
    stream = live.folder_stream(spark, f"{topic}/topic={S.TOPICS['finnhub_ohlc']}", schema,
                                fmt="json")
    out, ckpt = live.scratch(spark, "bars-out"), live.scratch(spark, "bars-ckpt")
    symbols = t.select("symbol").distinct()
    live.run_available(live.live_bars(stream, symbols, live.changelog_writer(out), ckpt))
    return live.read_changelog(spark, out).select("symbol", field("timestamp"), field("close", "double"))


@register("event_append", ids=("S7",), sql=with_fixtures(
    "SELECT *, CAST(timestamp AS DATE) AS event_date FROM event_log", "event_log"))
def q_event_append(spark, sf_dir):
    """Append a batch that holds every event twice to a date-partitioned table,
    then append it again as a retry would: the table holds each event once."""
    from tickflow.operators import events as evo
    path = live.scratch(spark, "event-append")
    log = fx.event_log(Tables(spark, sf_dir).events)
    evo.append_events(log.union(log), path)
    evo.append_events(log, path)
    return spark.read.parquet(path)


@register("price_alerts_stream", ids=("T4", "S5f"), sql=REGISTRY["msg_price_alert"].sql)
def q_price_alerts_stream(spark, sf_dir):
    """Trades stream past the static per-symbol bands; alerts land on a topic folder."""
    rules = fx.alert_rules(fx.events_as_ticks(Tables(spark, sf_dir).events))
    path, ckpt = live.scratch(spark, "alerts"), live.scratch(spark, "alerts-ckpt")
    live.run_available(live.alerts_stream(fx.events_as_ticks(_events(spark, sf_dir)), rules,
                                          path, ckpt))
    return alert_fields(spark.read.schema("topic string, key string, value string").json(path))


@register("training_status_stream", ids=("T5",), sql=REGISTRY["training_status"].sql)
def q_training_status_stream(spark, sf_dir):
    path, ckpt = live.scratch(spark, "train"), live.scratch(spark, "train-ckpt")
    live.run_available(live.training_status_stream(fx.event_log(_events(spark, sf_dir)),
                                                   path, ckpt))
    return live.read_changelog(spark, path, "symbol")
