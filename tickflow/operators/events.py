"""Event log: append, routing, the aggregate fold, history, commands, steps
(S7, J4, J6, A8, A11, C1, C4).

The log is the only truth; every state is a fold over it.  Folds are
``groupBy(aggregate_id)`` with filtered ``max_by`` on the order key
``struct(timestamp, seq)``: a declarative aggregate, so partial aggregation
runs before the shuffle and a hot aggregate costs one partial row per task,
and the result does not depend on row order or partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.functions.ordering import positions
from tickflow.functions.timecols import floor_time
from tickflow.operators.messages import JSON_OPTIONS
from tickflow.session import materialize, path_exists


def order_key(ts: str = "timestamp", seq: str = "seq") -> Column:
    return F.struct(F.col(ts), F.col(seq))


def parsed(log: DataFrame) -> DataFrame:
    """The log with its JSON payload parsed once (fields the folds read)."""
    return log.withColumn("d", F.from_json("data", S.EVENT_DATA)).withColumn("_ord", order_key())


def last_where(value: Column | str, types: list[str]) -> Column:
    """Value of the newest event whose type is in ``types`` (null if none)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max_by(v, F.when(F.col("event_type").isin(types), F.col("_ord")))


def newest_where(types: list[str]) -> Column:
    return F.max(F.when(F.col("event_type").isin(types), F.col("_ord")))


def oldest_where(types: list[str]) -> Column:
    return F.min(F.when(F.col("event_type").isin(types), F.col("_ord")))


def count_where(types: list[str]) -> Column:
    return F.count(F.when(F.col("event_type").isin(types), F.lit(1)))


def _status_of() -> Column:
    et = F.col("event_type")
    return (F.when(et == S.ANALYSIS_REQUESTED, F.lit(S.STATUS_REQUESTED))
            .when(et == S.ANALYSIS_STARTED, F.lit(S.STATUS_RUNNING))
            .when(et == S.ANALYSIS_COMPLETED, F.lit(S.STATUS_COMPLETED)))


def aggregate_state(log: DataFrame) -> DataFrame:
    """Fold the log into one state row per aggregate.

    status: newest of Requested / Started / Completed (idle before any);
    current_analysis_id: Requested; current_data: DataFetched; lstm_training:
    'completed' once any TrainingCompleted; predictions: PredictionCompleted;
    last_analysis_timestamp: Completed; version: events applied through the
    aggregate (TrainingStarted, PredictionStarted, AnalysisFailed are not).
    """
    return parsed(log).groupBy("aggregate_id").agg(*state_aggregates())


def state_aggregates() -> list[Column]:
    """The fold's aggregate expressions over ``parsed`` log rows."""
    return [
        F.coalesce(last_where(_status_of(), [S.ANALYSIS_REQUESTED, S.ANALYSIS_STARTED,
                                           S.ANALYSIS_COMPLETED]),
                   F.lit(S.STATUS_IDLE)).alias("status"),
        last_where("d.analysis_id", [S.ANALYSIS_REQUESTED]).alias("current_analysis_id"),
        last_where("d.data_info", [S.DATA_FETCHED]).alias("current_data"),
        F.when(count_where([S.LSTM_TRAINING_COMPLETED]) > 0, F.lit("completed"))
         .alias("lstm_training"),
        last_where("d.predictions", [S.PREDICTION_COMPLETED]).alias("predictions"),
        last_where("d.completion_timestamp", [S.ANALYSIS_COMPLETED])
         .alias("last_analysis_timestamp"),
        count_where(S.VERSIONED_EVENT_TYPES).cast("bigint").alias("version"),
        F.count(F.lit(1)).alias("n_events")]


def event_history(log: DataFrame, unit: str = "day") -> DataFrame:
    """Audit trail as rows: position of each event in its aggregate and the
    aggregate version after it (A11).

    Positions come from ``functions.ordering.positions``, which numbers rows
    inside (aggregate, day) and adds per-day offsets, so a hot aggregate is
    spread over as many tasks as it has days.
    """
    flag = F.col("event_type").isin(S.VERSIONED_EVENT_TYPES)
    out = positions(log.select("aggregate_id", "event_id", "event_type", "timestamp", "seq"),
                    "aggregate_id", ["timestamp", "seq"], "timestamp", unit,
                    counters={"version": flag})
    return out.select("aggregate_id", "pos", "event_id", "event_type", "timestamp", "version")


# Projections registered per event type (the read model's subscriptions).
ROUTING = [
    (S.ANALYSIS_COMPLETED, "project_analysis_completed"),
    (S.ANALYSIS_STARTED, "project_analysis_started"),
    (S.LSTM_TRAINING_COMPLETED, "project_training_completed"),
]


def routing_table(spark: SparkSession, routes=None) -> DataFrame:
    return spark.createDataFrame(routes or ROUTING, "event_type string, projection string")


def route_events(log: DataFrame, routing: DataFrame) -> DataFrame:
    """Event -> every projection registered for its type.

    The routing table is the handler registry: a handful of rows fixed in
    code, so broadcasting it is safe and the log is never shuffled.
    """
    return log.join(F.broadcast(routing), "event_type", "inner")


def dispatch(log: DataFrame, routing: DataFrame, handlers: dict) -> dict[str, DataFrame]:
    """Event handlers as DataFrame functions (the handler registry).

    ``handlers`` maps a projection name to ``DataFrame -> DataFrame``; each
    gets the events routed to it.  The loop runs over the registry written in
    code, never over data; every result stays a lazy DataFrame.
    """
    routed = route_events(log, routing)
    return {name: fn(routed.filter(F.col("projection") == name).drop("projection"))
            for name, fn in handlers.items()}


def uncommitted(produced: DataFrame, committed: DataFrame, key: str = "event_id") -> DataFrame:
    """Events produced but not in the committed log (J6); a plain anti join on
    the unique event id, which also makes re-appends idempotent."""
    return produced.join(committed.select(key), key, "left_anti")


def append_events(events: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Acknowledged append (S7): write the events that the log has not, once each, and return them.

    The log is partitioned by event date so readers prune by time; a retry
    after a lost executor re-runs the whole write and the anti join drops
    what a previous attempt already committed.  An event repeated in the
    batch is written once; an event without an id is known by its whole row.
    Only the log's partitions of the batch's dates are read (an event id keeps
    its date), that of events without a timestamp if the batch has such.  A
    log that cannot be read fails the append; only a path that does not exist
    is a first append.  What is returned was written, so it is what dispatch
    may hand on.
    """
    spark = events.sparkSession
    whole = F.to_json(F.struct(*events.columns), JSON_OPTIONS)
    key = F.coalesce(F.concat(F.lit("id "), F.col("event_id").cast("string")), F.concat(F.lit("row "), whole))
    out = events.withColumn("event_date", F.to_date("timestamp")).withColumn("_key", key).dropDuplicates(["_key"])
    if path_exists(spark, path):
        batch = out.agg(F.count(F.lit(1)).alias("rows"), F.min("event_date").alias("low"), F.max("event_date").alias("high"),
                        F.count("event_date").alias("dated"), F.count("event_id").alias("named")).first()
        if not batch["rows"]:  # nothing to append
            return out.drop("event_date", "_key").limit(0)
        days = F.col("event_date").between(F.lit(batch["low"]), F.lit(batch["high"])) if batch["dated"] else F.lit(False)
        if batch["dated"] < batch["rows"]:
            days = days | F.col("event_date").isNull()
        existing = spark.read.format(fmt).load(path).filter(days)
        if batch["named"] == batch["rows"]:  # ids are all that is compared
            out = out.join(existing.select("event_id"), "event_id", "left_anti")
        else:
            out = out.join(existing.select(key.alias("_key")), "_key", "left_anti")
    written = materialize(out.drop("_key"))  # fixed before the log changes under its own anti join
    written.write.mode("append").partitionBy("event_date").format(fmt).save(path)
    return written.drop("event_date")


def deterministic_id(*parts: Column | str) -> Column:
    """Replay-stable id: first 32 hex digits of sha256 over the parts."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 32)


def status_changes(log: DataFrame) -> DataFrame:
    """The events that set an aggregate's status, and the status they set (stream-safe)."""
    return (log.filter(F.col("event_type").isin(S.ANALYSIS_REQUESTED, S.ANALYSIS_STARTED, S.ANALYSIS_COMPLETED))
            .select("aggregate_id", "timestamp", "seq", _status_of().alias("status")))


def status_asof(requests: DataFrame, log: DataFrame, unit: str = "day") -> DataFrame:
    """As-of join: every ``requests`` row (``aggregate_id``, ``timestamp``,
    ``seq`` and any other columns) gets ``previous_status``, the aggregate's
    status as of its timestamp (events at the same instant count as earlier,
    ``idle`` before any).

    A window over each aggregate's whole history would put a hot aggregate
    in one task.  Instead the history is cut into ``unit`` buckets: the last
    status of every (aggregate, bucket) is a partial aggregate, the status
    carried into each bucket is a running ``last`` over that small table,
    and only the rows of one (aggregate, bucket) are ordered together.
    Exact, with the work of a task bounded by one bucket of one aggregate.
    """
    ord_ = F.struct("timestamp", "seq")
    ev = status_changes(log).select("*", F.lit(0).alias("_kind"), F.lit(None).cast(requests.schema).alias("_req"))
    rq = requests.select("aggregate_id", "timestamp", "seq",
                         F.lit(None).cast("string").alias("status"), F.lit(1).alias("_kind"),
                         F.struct(*requests.columns).alias("_req"))
    both = ev.unionByName(rq).withColumn("_b", floor_time("timestamp", unit))
    # last status per (aggregate, bucket); request-only buckets get a null mark
    marks = (both.groupBy("aggregate_id", "_b")
             .agg(F.max_by("status", F.when(F.col("_kind") == 0, ord_)).alias("_last")))
    before = Window.partitionBy("aggregate_id").orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carried_in = marks.select("aggregate_id", "_b",
                              F.last("_last", ignorenulls=True).over(before).alias("_prior"))
    inside = Window.partitionBy("aggregate_id", "_b").orderBy("timestamp", "_kind", "seq") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = both.join(carried_in, ["aggregate_id", "_b"])
    asof = F.coalesce(F.last("status", ignorenulls=True).over(inside), F.col("_prior"),
                      F.lit(S.STATUS_IDLE))
    return (j.withColumn("previous_status", asof).filter(F.col("_kind") == 1)
            .select("_req.*", "previous_status"))


def commands_to_events(commands: DataFrame, log: DataFrame) -> DataFrame:
    """RequestAnalysis commands -> AnalysisRequested events.

    The analysis id is derived from the command id (stable under replay);
    requester defaults to ``system``; previous_status is the aggregate's
    status when the command arrived (as-of join on the log)."""
    return requested_events(status_asof(commands, log))


def requested_events(commands: DataFrame) -> DataFrame:
    """AnalysisRequested events of commands that carry their ``previous_status`` (stream-safe)."""
    meta = F.from_json("metadata", "requester string")
    return commands.select(
        deterministic_id(F.lit("event"), F.col("command_id")).alias("event_id"),
        F.lit(S.ANALYSIS_REQUESTED).alias("event_type"), "aggregate_id",
        deterministic_id(F.lit("analysis"), F.col("command_id")).alias("analysis_id"),
        F.coalesce(meta.getField("requester"), F.lit(S.DEFAULT_REQUESTER)).alias("requester"),
        "previous_status", "timestamp")


def processing_status(steps: DataFrame) -> DataFrame:
    """Latest processing step per symbol (C4).

    A failed workflow shows ``request_failed`` / ``error`` and no analysis
    id: the request handler replaces the workflow's ``workflow_failed``
    entry by a fresh one that carries only status, step and error.
    """
    last = (steps.groupBy("symbol")
            .agg(F.max_by(F.struct("status", "step", "analysis_id", "error", "ts"),
                          F.struct("ts", "seq")).alias("s"))
            .select("symbol", "s.*"))
    failed = F.col("step") == "workflow_failed"
    return last.select(
        "symbol",
        F.when(failed, F.lit("error")).otherwise(F.col("status")).alias("status"),
        F.when(failed, F.lit("request_failed")).otherwise(F.col("step")).alias("step"),
        F.when(~failed, F.col("analysis_id")).alias("analysis_id"), "error", "ts")
