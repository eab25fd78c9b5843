"""Read models and queries over them.

The read model is the three projections (Started, Completed,
TrainingCompleted) with last-write-wins per key, computed as one filtered
aggregate per symbol.  The one order-dependent rule (TrainingCompleted acts
only once the symbol exists) is folded into the same aggregate: only the
newest TrainingCompleted matters, and it counts when it is newer than the
first Started/Completed.  No running window, so the same code serves a
stream (update mode) and a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.operators.events import (last_where, newest_where, oldest_where, parsed,
                                       state_aggregates)

_SO = [S.ANALYSIS_STARTED, S.ANALYSIS_COMPLETED]


def read_model_aggregates(prefix: str = "") -> list[Column]:
    """The read model's aggregate expressions over ``parsed`` log rows (each
    filters by event type itself, so they can share a scan with the fold)."""
    status = F.when(F.col("event_type") == S.ANALYSIS_STARTED, F.lit(S.STATUS_RUNNING)) \
        .otherwise(F.lit(S.STATUS_COMPLETED))
    p = prefix
    return [
        last_where(status, _SO).alias(p + "status"),
        last_where("d.analysis_id", _SO).alias(p + "analysis_id"),
        newest_where(_SO).alias(p + "so"),
        oldest_where(_SO).alias(p + "smin"),
        newest_where([S.ANALYSIS_STARTED]).alias(p + "sto"),
        last_where("d.results", [S.ANALYSIS_COMPLETED]).alias(p + "results"),
        last_where("d.completion_timestamp", [S.ANALYSIS_COMPLETED])
        .alias(p + "completion_timestamp"),
        newest_where([S.LSTM_TRAINING_COMPLETED]).alias(p + "tco")]


def read_model_partials(log: DataFrame) -> DataFrame:
    """The per-symbol aggregate the read model is finished from."""
    ev = parsed(log).filter(F.col("event_type").isin(S.READ_MODEL_EVENT_TYPES))
    return ev.groupBy(F.col("aggregate_id").alias("symbol")).agg(*read_model_aggregates())


def read_model_columns(prefix: str = "") -> list[tuple[str, Column]]:
    """Finished read-model columns (name, expression) from the partials."""
    c = lambda n: F.col(prefix + n)
    tc_valid = c("tco").isNotNull() & (c("tco") > c("smin"))
    started = c("sto").isNotNull()
    lstm = (F.when(tc_valid & (~started | (c("tco") > c("sto"))), F.lit("completed"))
            .when(started, F.lit("pending")))
    pending = F.when(started, F.lit("pending"))
    last_updated = F.when(tc_valid & (c("tco") > c("so")), c("tco").getField("timestamp")) \
        .otherwise(c("so").getField("timestamp"))
    return [("status", c("status")), ("analysis_id", c("analysis_id")),
            ("start_timestamp", c("sto").getField("timestamp")),
            ("results", c("results")), ("completion_timestamp", c("completion_timestamp")),
            ("progress_data_fetch", pending), ("progress_lstm_training", lstm),
            ("progress_prediction_generation", pending), ("last_updated", last_updated)]


def finish_read_model(p: DataFrame) -> DataFrame:
    return p.filter(F.col("smin").isNotNull()).select(
        "symbol", *[col.alias(name) for name, col in read_model_columns()])


def read_model(log: DataFrame) -> DataFrame:
    """One row per symbol that has seen a Started or Completed event."""
    return finish_read_model(read_model_partials(log))


def system_status(rm: DataFrame) -> DataFrame:
    """Active (running / requested), completed and total symbols (A2)."""
    return rm.agg(
        F.count(F.when(F.col("status").isin(S.ACTIVE_STATUSES), 1)).alias("active_analyses"),
        F.count(F.when(F.col("status") == S.STATUS_COMPLETED, 1)).alias("completed_analyses"),
        F.count(F.lit(1)).alias("total_symbols"))


def processing_stats(status: DataFrame) -> DataFrame:
    """Every symbol's processing entry, and the number of symbols in processing (A3): a scalar subquery of the same plan."""
    return status.withColumn("total_processing", status.agg(F.count(F.lit(1))).scalar())


def analysis_status(requests: DataFrame, rm: DataFrame) -> DataFrame:
    """Status query per requested symbol (C5): not_found without a read model."""
    j = requests.select("symbol").distinct().join(rm, "symbol", "left")
    return j.select(
        "symbol",
        F.coalesce("status", F.lit("not_found")).alias("status"),
        "analysis_id",
        "progress_data_fetch", "progress_lstm_training", "progress_prediction_generation",
        "last_updated",
        F.lit(0).alias("n_error_messages"))


def analysis_results(requests: DataFrame, rm: DataFrame) -> DataFrame:
    """Results query per requested symbol."""
    j = requests.select("symbol").distinct().join(rm.select("symbol", "status", "results"),
                                                  "symbol", "left")
    done = F.col("status") == S.STATUS_COMPLETED
    active = F.col("status").isin(S.ACTIVE_STATUSES)
    return j.select(
        "symbol",
        F.when(done, F.lit("success")).when(active, F.lit("not_ready"))
         .otherwise(F.lit("not_found")).alias("status"),
        F.when(done, F.col("results")).alias("results"),
        F.when(done, F.lit(None).cast("string"))
         .when(active, F.format_string(S.MSG_NOT_READY, F.col("symbol")))
         .otherwise(F.format_string(S.MSG_NOT_FOUND, F.col("symbol")))
         .alias("message"))


def status_with_processing(status: DataFrame, proc: DataFrame) -> DataFrame:
    """Status query plus the processing status, default not_found / unknown."""
    p = proc.select("symbol", F.col("status").alias("processing_status"),
                    F.col("step").alias("processing_step"))
    j = status.join(p, "symbol", "left")
    return (j.withColumn("processing_status", F.coalesce("processing_status", F.lit("not_found")))
            .withColumn("processing_step", F.coalesce("processing_step", F.lit("unknown"))))


def status_with_processing_from_log(requests: DataFrame, log_with_steps: DataFrame) -> DataFrame:
    """J2 from one aggregate over the log: read model and processing status
    (the log carries each event's step write: ``step_status``, ``step``,
    ``step_analysis_id``, ``step_error``) come out of the same groupBy, and
    the requests join it once."""
    order = F.struct("timestamp", "seq")
    proc = F.max_by(F.struct(F.col("step_status").alias("status"), F.col("step"),
                             F.col("step_analysis_id").alias("analysis_id"),
                             F.col("step_error").alias("error")), order)
    agg = (parsed(log_with_steps).groupBy(F.col("aggregate_id").alias("symbol"))
           .agg(*read_model_aggregates("_rm_"), proc.alias("_proc")))
    j = requests.select("symbol").distinct().join(agg, "symbol", "left")
    has_rm = F.col("_rm_smin").isNotNull()
    rm = {name: F.when(has_rm, col) for name, col in read_model_columns("_rm_")}
    failed = F.col("_proc.step") == "workflow_failed"
    return j.select(
        "symbol",
        F.coalesce(rm["status"], F.lit("not_found")).alias("status"),
        rm["analysis_id"].alias("analysis_id"),
        *[rm[c].alias(c) for c in ("progress_data_fetch", "progress_lstm_training",
                                   "progress_prediction_generation", "last_updated")],
        F.lit(0).alias("n_error_messages"),
        F.coalesce(F.when(failed, F.lit("error")).otherwise(F.col("_proc.status")),
                   F.lit("not_found")).alias("processing_status"),
        F.coalesce(F.when(failed, F.lit("request_failed")).otherwise(F.col("_proc.step")),
                   F.lit("unknown")).alias("processing_step"))


def state_lookup(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Aggregate state for many requested symbols at once."""
    st = state.withColumnRenamed("aggregate_id", "symbol")
    return requests.select("symbol").distinct().join(st, "symbol", "left")


def state_with_read_model(log: DataFrame) -> DataFrame:
    """Aggregate state (A8) and read model (A9) of every aggregate from one
    aggregate over the log: one scan instead of one per view.  Read-model
    columns are null where the read model has no row."""
    fused = parsed(log).groupBy("aggregate_id").agg(*state_aggregates(),
                                                    *read_model_aggregates("_rm_"))
    has_rm = F.col("_rm_smin").isNotNull()
    state_cols = [c for c in fused.columns if not c.startswith("_rm_")]
    return fused.select(*state_cols, *[F.when(has_rm, col).alias("rm_" + name)
                                       for name, col in read_model_columns("_rm_")])


def workflow_debug_view_from_log(proc: DataFrame, log: DataFrame) -> DataFrame:
    """J5 with the aggregate and the read model from one scan of the log."""
    f = state_with_read_model(log)
    p = proc.select("symbol", F.col("status").alias("processing_status"),
                    F.col("step").alias("processing_step"))
    v = f.select(F.col("aggregate_id").alias("symbol"),
                 F.col("status").alias("aggregate_status"),
                 F.col("lstm_training").alias("training_progress"),
                 F.col("predictions").isNotNull().alias("has_predictions"),
                 "current_analysis_id", "version",
                 F.col("rm_status").alias("read_model_status"),
                 F.col("rm_analysis_id").alias("read_model_analysis_id"))
    return p.join(v, "symbol", "full")


def workflow_debug_view(proc: DataFrame, state: DataFrame, rm: DataFrame) -> DataFrame:
    """Processing status, aggregate and read model side by side per symbol."""
    p = proc.select("symbol", F.col("status").alias("processing_status"),
                    F.col("step").alias("processing_step"))
    a = state.select(F.col("aggregate_id").alias("symbol"),
                     F.col("status").alias("aggregate_status"),
                     F.col("lstm_training").alias("training_progress"),
                     F.col("predictions").isNotNull().alias("has_predictions"),
                     "current_analysis_id", "version")
    r = rm.select("symbol", F.col("status").alias("read_model_status"),
                  F.col("analysis_id").alias("read_model_analysis_id"))
    return p.join(a, "symbol", "full").join(r, "symbol", "full")
