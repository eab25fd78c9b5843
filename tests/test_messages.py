"""Message envelopes: keys, type tags, timestamps, sink and decode round trip."""

from datetime import datetime

from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.operators import messages as msg
from tickflow.streaming import live


def test_stock_data_key_defaults_to_unknown(spark):
    df = spark.createDataFrame([("X", 1.5, datetime(2024, 1, 1, 9, 30, 0, 123456)),
                                (None, 2.0, datetime(2024, 1, 1))],
                               "symbol string, close double, ts timestamp_ntz")
    rows = {r["key"]: r for r in msg.stock_data(df).collect()}
    assert set(rows) == {"X", "unknown"}
    v = rows["X"]["value"]
    assert '"type":"current_stock_data"' in v
    assert '"timestamp":"2024-01-01T09:30:00.123456"' in v  # microseconds kept


def test_metrics_key_and_training_status(spark):
    m = spark.createDataFrame([("X", datetime(2024, 1, 1), 0.5)],
                              "symbol string, ts timestamp_ntz, test_mae double")
    r = msg.model_metrics(m).collect()[0]
    assert r["key"] == "LSTM-X" and r["topic"] == S.TOPICS["model_metrics"]
    assert '"metrics":{"test_mae":0.5}' in r["value"]


def test_records_sink_and_decode_round_trip(spark):
    actions = spark.createDataFrame([("view", datetime(2024, 1, 1), 7, 1.25),
                                     ("click", datetime(2024, 1, 2), 8, 2.5)],
                                    "action string, ts timestamp_ntz, user_id bigint, value double")
    path = live.scratch(spark, "sink")
    msg.write_records(msg.user_actions(actions), "json", path=path)
    back = spark.read.schema("key string, value string").json(f"{path}/topic=user-actions")
    schema = "action string, details struct<user_id:bigint,value:double>, type string"
    got = {r["key"]: r for r in msg.decode(back, schema, [S.MSG_USER_ACTION])
           .select("key", "msg.details.user_id", "msg.details.value").collect()}
    assert got["view"]["user_id"] == 7 and got["click"]["value"] == 2.5
    assert msg.decode(back, schema, ["other"]).count() == 0
    assert back.select(msg.message_type().alias("t")).distinct().collect()[0]["t"] == "user_action"
    assert back.filter(F.col("key").isNull()).count() == 0


def test_sink_returns_success_flag(spark):
    records = msg.user_actions(spark.createDataFrame([("view", datetime(2024, 1, 1), 7)],
                                                     "action string, ts timestamp_ntz, user_id bigint"))
    path = live.scratch(spark, "flag")
    assert msg.write_records(records, "json", path=path) is True
    assert msg.write_records(records, "json", path=path, mode="errorifexists") is False
    assert spark.read.schema("topic string, key string, value string").json(path).count() == 1


def test_kafka_records_are_read_from_their_topics(spark, sf_dir):
    import __spark_entry__ as entry
    got = entry.queries()["kafka_records"](spark, sf_dir)
    assert got.columns == ["topic", "key", "type", "amount", "timestamp"] and got.inputFiles()
    assert {r["topic"] for r in got.select("topic").distinct().collect()} == \
        {S.TOPICS["user_actions"], S.TOPICS["alerts"]}
    events = entry.queries()["topic_source"](spark, sf_dir).count()
    assert got.filter(F.col("topic") == S.TOPICS["user_actions"]).count() == events
