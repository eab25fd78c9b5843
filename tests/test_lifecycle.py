"""Golden event logs (FIXTURES.md section 4) and the sequential semantics of
the aggregate fold and the read model, checked against a row-by-row
dictionary loop on the event_log fixture."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow import schemas as S
from tickflow.operators import events as evo
from tickflow.operators import readmodel as rmo
from tickflow.sources import fixtures as fx
from tickflow.sources.tables import Tables

SUCCESS = [S.ANALYSIS_REQUESTED, S.ANALYSIS_STARTED, S.DATA_FETCHED, S.LSTM_TRAINING_STARTED,
           S.LSTM_TRAINING_COMPLETED, S.PREDICTION_STARTED, S.PREDICTION_COMPLETED,
           S.ANALYSIS_COMPLETED]
T0 = datetime(2024, 1, 1, 9, 0, 0)


def make_log(spark, types, symbol="AAPL", start_seq=0):
    rows = []
    for i, t in enumerate(types):
        seq = start_seq + i
        ts = T0 + timedelta(minutes=seq)
        data = {"analysis_id": f"A{seq // 8}", "symbol": symbol}
        if t == S.ANALYSIS_COMPLETED:
            data_json = ('{"analysis_id":"%s","symbol":"%s","results":{"run":%d},'
                         '"completion_timestamp":"%s"}') % (data["analysis_id"], symbol, seq,
                                                             ts.isoformat())
        elif t == S.DATA_FETCHED:
            data_json = '{"symbol":"%s","data_info":{"data_points":%d}}' % (symbol, seq)
        elif t == S.PREDICTION_COMPLETED:
            data_json = '{"symbol":"%s","predictions":{"n":%d}}' % (symbol, seq)
        else:
            data_json = '{"analysis_id":"%s","symbol":"%s"}' % (data["analysis_id"], symbol)
        rows.append((str(seq), t, symbol, S.AGGREGATE_TYPE, data_json, "{}", ts, 1, seq))
    schema = T.StructType(list(S.EVENT_LOG.fields) + [T.StructField("seq", T.LongType())])
    return spark.createDataFrame(rows, schema)


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()


def test_lifecycle_ok(spark):
    log = make_log(spark, SUCCESS)
    st = one(evo.aggregate_state(log))
    assert st["status"] == "completed" and st["version"] == 6
    assert st["lstm_training"] == "completed"
    assert st["current_data"] == '{"data_points":2}'
    rm = one(rmo.read_model(log))
    assert rm["status"] == "completed"
    assert (rm["progress_data_fetch"], rm["progress_lstm_training"],
            rm["progress_prediction_generation"]) == ("pending", "completed", "pending")
    assert rm["results"] == '{"run":7}'
    assert rm["last_updated"] == T0 + timedelta(minutes=7)


def test_lifecycle_failed(spark):
    log = make_log(spark, [S.ANALYSIS_REQUESTED, S.ANALYSIS_STARTED, S.ANALYSIS_FAILED])
    st = one(evo.aggregate_state(log))
    assert st["status"] == "running" and st["version"] == 2
    assert one(rmo.read_model(log))["status"] == "running"


def test_lifecycle_rerun(spark):
    log = make_log(spark, SUCCESS + [S.ANALYSIS_REQUESTED, S.ANALYSIS_STARTED])
    rm = one(rmo.read_model(log))
    assert rm["status"] == "running"
    assert rm["results"] == '{"run":7}'
    assert rm["progress_lstm_training"] == "pending"
    assert rm["progress_data_fetch"] == "pending"
    assert one(evo.aggregate_state(log))["version"] == 8


def test_training_first(spark):
    log = make_log(spark, [S.LSTM_TRAINING_COMPLETED])
    assert rmo.read_model(log).count() == 0
    assert one(evo.aggregate_state(log))["version"] == 1


def test_training_after_completed(spark):
    log = make_log(spark, [S.ANALYSIS_COMPLETED, S.LSTM_TRAINING_COMPLETED])
    rm = one(rmo.read_model(log))
    assert rm["progress_lstm_training"] == "completed"
    assert rm["progress_data_fetch"] is None and rm["progress_prediction_generation"] is None
    assert rm["last_updated"] == T0 + timedelta(minutes=1)


def _python_read_model(rows):
    """Row-by-row replay with dict.update semantics (the projection handlers)."""
    models = {}
    for r in sorted(rows, key=lambda r: (r["timestamp"], r["seq"])):
        sym, t = r["aggregate_id"], r["event_type"]
        if t == S.ANALYSIS_COMPLETED:
            m = models.setdefault(sym, {})
            m.update(status="completed", analysis_id=r["aid"], results=r["results"],
                     last_updated=r["timestamp"])
        elif t == S.ANALYSIS_STARTED:
            m = models.setdefault(sym, {})
            m.update(status="running", analysis_id=r["aid"], start_timestamp=r["timestamp"],
                     last_updated=r["timestamp"],
                     progress={"data_fetch": "pending", "lstm_training": "pending",
                               "prediction_generation": "pending"})
        elif t == S.LSTM_TRAINING_COMPLETED and sym in models:
            models[sym].setdefault("progress", {})["lstm_training"] = "completed"
            models[sym]["last_updated"] = r["timestamp"]
    out = {}
    for sym, m in models.items():
        p = m.get("progress", {})
        out[sym] = (m.get("status"), m.get("analysis_id"), m.get("results"),
                    p.get("data_fetch"), p.get("lstm_training"), m.get("last_updated"))
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_read_model_equals_sequential_replay(spark, sf_dir, partitions):
    log = fx.event_log(Tables(spark, sf_dir).events).repartition(partitions)
    rows = (log.select("aggregate_id", "event_type", "timestamp", "seq",
                       F.get_json_object("data", "$.analysis_id").alias("aid"),
                       F.get_json_object("data", "$.results").alias("results")).collect())
    expected = _python_read_model([r.asDict() for r in rows])
    got = {r["symbol"]: (r["status"], r["analysis_id"], r["results"], r["progress_data_fetch"],
                         r["progress_lstm_training"], r["last_updated"])
           for r in rmo.read_model(log).collect()}
    assert got == expected


def test_fold_independent_of_order_and_partitions(spark, sf_dir):
    log = fx.event_log(Tables(spark, sf_dir).events)
    a = sorted(map(tuple, evo.aggregate_state(log).collect()))
    b = sorted(map(tuple, evo.aggregate_state(log.orderBy(F.rand(7)).repartition(5)).collect()))
    assert a == b


def test_processing_status_failure_overwrite(spark):
    log = make_log(spark, [S.ANALYSIS_REQUESTED, S.ANALYSIS_STARTED, S.ANALYSIS_FAILED])
    ps = one(evo.processing_status(fx.step_log(log)))
    assert (ps["status"], ps["step"], ps["analysis_id"]) == ("error", "request_failed", None)


def test_event_history_positions_equal_window(spark, sf_dir):
    from pyspark.sql import Window
    log = fx.event_log(Tables(spark, sf_dir).events)
    hist = evo.event_history(log, unit="hour")
    w = Window.partitionBy("aggregate_id").orderBy("timestamp", "seq")
    ref = log.select("event_id", F.row_number().over(w).alias("pos"),
                     F.sum(F.col("event_type").isin(S.VERSIONED_EVENT_TYPES).cast("int"))
                     .over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("version"))
    got = hist.select("event_id", "pos", "version")
    assert got.exceptAll(ref.select("event_id", F.col("pos").cast("bigint"),
                                    F.col("version").cast("bigint"))).count() == 0
    assert got.count() == ref.count()


LATER = T0 + timedelta(days=30)


def test_commands_keep_previous_status(spark):
    log = make_log(spark, SUCCESS)
    cmds = spark.createDataFrame(
        [("c1", "RequestAnalysis", "AAPL", "{}", '{"requester":"ui"}', LATER, None),
         ("c2", "RequestAnalysis", "MSFT", "{}", "{}", T0, None)], S.COMMANDS)
    ev = {r["aggregate_id"]: r for r in evo.commands_to_events(cmds.withColumn("seq", F.lit(99)), log).collect()}
    assert ev["AAPL"]["previous_status"] == "completed" and ev["AAPL"]["requester"] == "ui"
    assert ev["MSFT"]["previous_status"] == "idle" and ev["MSFT"]["requester"] == "system"
    assert len(ev["AAPL"]["analysis_id"]) == 32


def test_uncommitted_and_append_idempotent(spark, tmp_path):
    log = make_log(spark, SUCCESS)
    path = str(tmp_path / "log")
    evo.append_events(log.filter(F.col("seq") < 4), path)
    again = evo.append_events(log.union(log), path)  # retry of an overlapping batch, each event twice
    assert sorted(r["seq"] for r in again.collect()) == [r["seq"] for r in log.filter(F.col("seq") >= 4).orderBy("seq").collect()]
    stored = spark.read.parquet(path)
    assert stored.count() == 8
    assert evo.uncommitted(log, stored).count() == 0


def test_append_of_events_without_timestamp_or_id(spark, tmp_path):
    columns = "event_id string, event_type string, aggregate_id string, timestamp timestamp_ntz, data string, seq bigint"
    at = datetime(2024, 3, 1, 12, 0, 0, 5)
    rows = [("a", "x", "AAPL", at, "{}", 1), ("b", "x", "AAPL", None, "{}", 2), (None, "x", "AAPL", at, "{}", 3),
            (None, "x", "AAPL", at.replace(microsecond=6), "{}", 3), (None, "x", "MSFT", None, None, 4)]
    path, frame = str(tmp_path / "log"), lambda own: spark.createDataFrame(own, columns)
    evo.append_events(frame([("first", "x", "AAPL", at, "{}", 0)]), path)
    assert evo.append_events(frame([rows[1]]), path).count() == 1  # no event of the batch has a timestamp
    assert evo.append_events(frame(rows + rows), path).count() == 4
    for retry in (rows, [rows[1]], [rows[4]]):
        assert evo.append_events(frame(retry), path).count() == 0
    got = [tuple(r) for r in spark.read.parquet(path).select(*frame(rows).columns).collect()]
    assert sorted(got, key=str) == sorted([("first", "x", "AAPL", at, "{}", 0), *rows], key=str)


def test_dispatch_handlers(spark, sf_dir):
    log = fx.event_log(Tables(spark, sf_dir).events)
    out = evo.dispatch(log, evo.routing_table(spark), {
        "project_analysis_started": lambda df: df.groupBy("aggregate_id").count(),
        "project_training_completed": lambda df: df.select("event_type").distinct()})
    assert {r["event_type"] for r in out["project_training_completed"].collect()} == \
        {S.LSTM_TRAINING_COMPLETED}
    n_started = log.filter(F.col("event_type") == S.ANALYSIS_STARTED).count()
    assert out["project_analysis_started"].agg(F.sum("count")).collect()[0][0] == n_started


def test_workflow_log_folds_to_expected_states(spark, sf_dir):
    """End to end: the workflow's own event log folds to the application's
    states (success: completed / version 6; training failure: running /
    version 3; fetch failure: running / version 2)."""
    import __spark_entry__ as entry
    log = entry.queries()["workflow_event_log"](spark, sf_dir)
    st = {r["aggregate_id"]: r for r in evo.aggregate_state(log).collect()}
    rm = {r["symbol"]: r for r in rmo.read_model(log).collect()}
    assert (st["1-URGENT"]["status"], st["1-URGENT"]["version"],
            st["1-URGENT"]["lstm_training"]) == ("completed", 6, "completed")
    assert rm["1-URGENT"]["status"] == "completed"
    assert '"models_trained":{"lstm":true' in rm["1-URGENT"]["results"]
    assert (st["CLICK"]["status"], st["CLICK"]["version"]) == ("running", 3)
    assert (st["AAPL"]["status"], st["AAPL"]["version"]) == ("running", 2)
    assert rm["AAPL"]["status"] == "running"


def test_fused_state_and_read_model_equal_separate(spark, sf_dir):
    log = fx.event_log(Tables(spark, sf_dir).events)
    fused = rmo.state_with_read_model(log)
    state = evo.aggregate_state(log)
    assert fused.select(*state.columns).exceptAll(state).count() == 0
    rm = rmo.read_model(log)
    got = fused.filter(F.col("rm_status").isNotNull()).select(
        F.col("aggregate_id").alias("symbol"), *[F.col("rm_" + c).alias(c) for c in rm.columns[1:]])
    assert got.count() == rm.count() and got.exceptAll(rm).count() == 0


def test_append_fails_on_an_unreadable_log(spark, tmp_path):
    log = make_log(spark, SUCCESS)
    path = tmp_path / "log"
    evo.append_events(log, str(path))
    for part in path.rglob("*.parquet"):
        part.write_bytes(b"not parquet")
    with pytest.raises(Exception):
        evo.append_events(log, str(path))
    assert len(list(path.rglob("*.parquet"))) == len([p for p in path.rglob("*.parquet") if p.read_bytes() == b"not parquet"])
