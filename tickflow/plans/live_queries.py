"""Registered queries of the live operators with stores and states of their own.

Each feeds a bounded stream, or the event store, from the given tables and
returns what it leaves behind.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow import schemas as S
from tickflow.operators import events as evo
from tickflow.operators import messages as msg
from tickflow.plans import event_queries  # noqa: F401 - the batch twins
from tickflow.plans.event_queries import _ROUTING_SQL
from tickflow.plans.market_queries import bars
from tickflow.plans.message_queries import ACTION, CUT_BASE, CUT_LIVE, ISO_SQL
from tickflow.plans.oracle import with_fixtures
from tickflow.plans.registry import REGISTRY, register
from tickflow.sources import fixtures as fx
from tickflow.sources import history as hist
from tickflow.sources.tables import Tables
from tickflow.streaming import live, stateful, store, topics, upserts


def _events(spark, sf_dir):
    return live.table_stream(spark, sf_dir, "events", live.EVENTS_SCHEMA)


@register("event_dispatch", ids=("S7", "J4"), sql=with_fixtures(f"""
    SELECT l.event_id, l.event_type, l.aggregate_id, l.timestamp, r.projection AS handler,
           CASE WHEN l.seq % 3 = 0 THEN 'first' ELSE 'second' END AS batch
    FROM event_log l JOIN {_ROUTING_SQL} ON l.event_type = r.event_type""", "event_log"))
def q_event_dispatch(spark, sf_dir):
    """A third of the log is appended, then all of it (as an at-least-once
    producer would), then a batch whose write fails: every committed event
    reaches each handler of its type once, beside a handler that always fails."""
    log = fx.event_log(Tables(spark, sf_dir).events)
    path, out = live.scratch(spark, "store"), live.scratch(spark, "handled")
    events = store.EventStore(spark, path, log.schema)

    def project(name):
        return lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/handler={name}/batch={batch}")

    def broken(df, batch):
        raise RuntimeError(f"no handler for {batch}")

    events.register(S.ANALYSIS_COMPLETED, "broken", broken)
    for event_type, projection in evo.ROUTING:
        events.register(event_type, projection, project(projection))
    answers = [events.append(log.where("seq % 3 = 0"), "first"), events.append(log, "second"),
               events.append(log.withColumn("event_id", F.concat(F.lit("new"), F.raise_error(F.lit("lost connection")))), "third")]
    if answers != [True, True, False]:
        raise RuntimeError(f"appends answered {answers}")
    handled = spark.read.schema("event_id string, event_type string, aggregate_id string, timestamp timestamp_ntz, "
                                "handler string, batch string").parquet(out)
    return handled.select("event_id", "event_type", "aggregate_id", "timestamp", "handler", "batch")


@register("commands_stream", ids=("C1",), sql=REGISTRY["commands_to_events"].sql)
def q_commands_stream(spark, sf_dir):
    """Commands beside the log, the status before each from a state per aggregate."""
    path, ckpt = live.scratch(spark, "commands"), live.scratch(spark, "commands-ckpt")
    with stateful.rocksdb_state(spark):
        live.run_available(stateful.commands_stream(
            fx.event_log(_events(spark, sf_dir)), fx.commands(_events(spark, sf_dir)), path, ckpt))
    return spark.read.parquet(path)


@register("last_1000_stream", ids=("T7",), sql=REGISTRY["last_1000"].sql)
def q_last_1000_stream(spark, sf_dir):
    path, ckpt = live.scratch(spark, "ring"), live.scratch(spark, "ring-ckpt")
    with stateful.rocksdb_state(spark):
        live.run_available(stateful.ring_buffer_stream(fx.events_as_ticks(_events(spark, sf_dir)), path, ckpt, 1000))
    return stateful.ring_buffer_table(spark, path)


@register("live_bar_merge_stream", ids=("T9", "S9"), sql=REGISTRY["live_bar_merge"].sql)
def q_live_bar_merge_stream(spark, sf_dir):
    """Stored hourly bars up to a cut; live bars from the day before it come as
    messages of a topic and are merged in, batch by batch."""
    t = fx.events_as_ticks(Tables(spark, sf_dir).events)
    table, topic = live.scratch(spark, "bars"), live.scratch(spark, "bars-topic")
    upserts.write_bars(fx.bars_from_ticks(t.where(F.col("ts") < F.lit(CUT_BASE).cast("timestamp_ntz"))), table)
    fresh = fx.bars_from_ticks(t.where(F.col("ts") >= F.lit(CUT_LIVE).cast("timestamp_ntz")))
    if not msg.write_records(msg.ohlcv_messages(fresh), "json", path=topic):
        raise RuntimeError("the topic was not written")
    messages = live.folder_stream(spark, f"{topic}/topic={S.TOPICS['finnhub_ohlc']}", "key string, value string", fmt="json")
    write = upserts.bar_merge_writer(table, live.scratch(spark, "bars-staging"))
    live.run_available(live.live_bars(messages, t.select("symbol").distinct(),
                                      lambda df, batch_id: write(upserts.bar_messages(df), batch_id), live.scratch(spark, "bars-ckpt")))
    return upserts.read_bars(spark, table)


#: Of the messages, those of event ids divisible by this many are cut off on their way.
BROKEN = 10


@register("topic_stream", ids=("S6", "T8"), sql=f"""
    SELECT event_type AS key, event_id % {BROKEN} = 0 AS corrupt,
           CASE WHEN event_id % {BROKEN} <> 0 THEN 'user_action' END AS type,
           CASE WHEN event_id % {BROKEN} <> 0 THEN user_id END AS user_id,
           CASE WHEN event_id % {BROKEN} <> 0 THEN value END AS value,
           CASE WHEN event_id % {BROKEN} <> 0 THEN strftime(ts, {ISO_SQL}) END AS timestamp
    FROM events""")
def q_topic_stream(spark, sf_dir):
    """A topic of messages, some cut off, read as a stream: decoded and undecodable ones."""
    ev = Tables(spark, sf_dir).events
    records = msg.user_actions(ev.select(F.col("event_type").alias("action"), "ts", "user_id", "value", "event_id"))
    cut = F.get_json_object("value", "$.details.event_id").cast("long") % BROKEN == 0
    records = records.withColumn("value", F.when(cut, F.expr("left(value, length(value) - 9)")).otherwise(F.col("value")))
    topic, out = live.scratch(spark, "topic"), live.scratch(spark, "topic-out")
    if not msg.write_records(records, "json", path=topic):
        raise RuntimeError("the topic was not written")
    schema = T.StructType.fromDDL(ACTION)
    messages = live.folder_stream(spark, f"{topic}/topic={S.TOPICS['user_actions']}", "key string, value string", fmt="json")
    live.run_available(messages.writeStream.option("checkpointLocation", live.scratch(spark, "topic-ckpt"))
                       .foreachBatch(topics.topic_writer(schema, out, [S.MSG_USER_ACTION])))
    decoded = spark.read.parquet(f"{out}/decoded").select(
        "key", F.lit(False).alias("corrupt"), "msg.type", "msg.details.user_id", "msg.details.value", "msg.timestamp")
    corrupt = spark.read.parquet(f"{out}/corrupt").where("corrupt <> ''").select("key", F.lit(True).alias("corrupt"))
    return decoded.unionByName(corrupt, allowMissingColumns=True)


@register("history_stream", ids=("S8", "T8", "L3"), sql=REGISTRY["history_from_messages"].sql)
def q_history_stream(spark, sf_dir):
    """A history topic, read until each symbol has its first message."""
    b = bars(spark, sf_dir)
    topic, out = live.scratch(spark, "history"), live.scratch(spark, "history-out")
    hist.history_messages(b).write.json(topic)
    messages = live.folder_stream(spark, topic, "key string, value string, offset bigint", fmt="json")
    why = topics.history_stream(messages, b.select("symbol"), out, live.scratch(spark, "history-ckpt"), idle=60.0)
    if why != "done":
        raise RuntimeError(f"the stream stopped because it was {why}")
    return hist.history_from_messages(topics.first_messages(spark, out))


#: Events of ids divisible by this many come after all others.
WITHHELD = 50


@register("events_late_stream", ids=("T10",), sql=f"""
    WITH held AS (SELECT * FROM events WHERE event_id % {WITHHELD} = 0),
    mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS m FROM events WHERE event_id % {WITHHELD} <> 0),
    twice AS (SELECT * FROM held UNION ALL SELECT * FROM held WHERE event_type = 'click')
    SELECT *, FALSE AS late FROM events WHERE event_id % {WITHHELD} <> 0
    UNION ALL SELECT held.*, FALSE FROM held, mark WHERE m IS NULL OR ts >= m
    UNION ALL SELECT twice.*, TRUE FROM twice, mark WHERE ts < m""")
def q_events_late_stream(spark, sf_dir):
    """Three batches, early and late half and what was withheld, every click
    delivered twice: each id kept once, and rows behind the watermark set aside."""
    ev = Tables(spark, sf_dir).events
    middle = ev.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").cast("string").alias("t")).first()["t"]
    early, withheld = F.col("ts") < F.lit(middle).cast("timestamp_ntz"), F.col("event_id") % WITHHELD == 0
    topic, out, ckpt = (live.scratch(spark, f"late{k}") for k in ("", "-out", "-ckpt"))
    write = upserts.late_writer(out)
    for part in (~withheld & early, ~withheld & ~F.coalesce(early, F.lit(False)), withheld):
        some = ev.where(part)
        some.unionByName(some.where("event_type = 'click'")).write.mode("append").parquet(topic)
        stream = live.folder_stream(spark, topic, ev.schema)
        live.run_available(stream.writeStream.option("checkpointLocation", ckpt).foreachBatch(write))
    return upserts.late_tables(spark, out)
