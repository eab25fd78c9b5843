"""Registered queries over the event log and read models (A2, A3, A8, A9,
A11, C1, C4-C6, J2-J6, P10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.operators import events as evo
from tickflow.operators import readmodel as rmo
from tickflow.plans.oracle import with_fixtures
from tickflow.plans.registry import register
from tickflow.sources import fixtures as fx
from tickflow.sources.tables import Tables

ORD = "{'t': timestamp, 's': seq}"
RQ, ST, DF, TC, PC, CO = (S.ANALYSIS_REQUESTED, S.ANALYSIS_STARTED, S.DATA_FETCHED,
                          S.LSTM_TRAINING_COMPLETED, S.PREDICTION_COMPLETED,
                          S.ANALYSIS_COMPLETED)
VERSIONED = ", ".join(f"'{t}'" for t in S.VERSIONED_EVENT_TYPES)


def log(spark, sf_dir):
    return fx.event_log(Tables(spark, sf_dir).events)


def requests(spark, sf_dir):
    """Requested symbols: every signed-up user plus the raw event types
    (the latter have no analysis and exercise the not-found paths)."""
    ev = Tables(spark, sf_dir).events
    user = F.when(F.col("event_type") == "signup",
                  F.upper(F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    both = F.explode(F.array(user, F.upper("event_type"))).alias("symbol")
    return ev.select(both).filter(F.col("symbol").isNotNull()).distinct()  # one scan


REQUESTS_SQL = """
    SELECT DISTINCT upper('u' || user_id) AS symbol FROM events WHERE event_type = 'signup'
    UNION SELECT DISTINCT upper(event_type) FROM events"""

STATE_SQL = f"""
    SELECT aggregate_id,
           coalesce(arg_max_null(CASE event_type WHEN '{RQ}' THEN 'requested'
                                   WHEN '{ST}' THEN 'running' ELSE 'completed' END, {ORD})
                    FILTER (WHERE event_type IN ('{RQ}', '{ST}', '{CO}')), 'idle') AS status,
           arg_max_null(json_extract_string(data, '$.analysis_id'), {ORD})
             FILTER (WHERE event_type = '{RQ}') AS current_analysis_id,
           arg_max_null(CAST(json_extract(data, '$.data_info') AS VARCHAR), {ORD})
             FILTER (WHERE event_type = '{DF}') AS current_data,
           CASE WHEN count(*) FILTER (WHERE event_type = '{TC}') > 0 THEN 'completed' END
             AS lstm_training,
           arg_max_null(CAST(json_extract(data, '$.predictions') AS VARCHAR), {ORD})
             FILTER (WHERE event_type = '{PC}') AS predictions,
           arg_max_null(json_extract_string(data, '$.completion_timestamp'), {ORD})
             FILTER (WHERE event_type = '{CO}') AS last_analysis_timestamp,
           count(*) FILTER (WHERE event_type IN ({VERSIONED})) AS version,
           count(*) AS n_events
    FROM event_log GROUP BY aggregate_id"""

# Read model written the sequential way: a TrainingCompleted acts only when a
# Started / Completed came before it; then last write wins per key.
READ_MODEL_SQL = f"""
    SELECT aggregate_id AS symbol,
           arg_max_null(CASE WHEN event_type = '{ST}' THEN 'running' ELSE 'completed' END, {ORD})
             FILTER (WHERE event_type IN ('{ST}', '{CO}')) AS status,
           arg_max_null(json_extract_string(data, '$.analysis_id'), {ORD})
             FILTER (WHERE event_type IN ('{ST}', '{CO}')) AS analysis_id,
           arg_max_null(timestamp, {ORD}) FILTER (WHERE event_type = '{ST}') AS start_timestamp,
           arg_max_null(CAST(json_extract(data, '$.results') AS VARCHAR), {ORD})
             FILTER (WHERE event_type = '{CO}') AS results,
           arg_max_null(json_extract_string(data, '$.completion_timestamp'), {ORD})
             FILTER (WHERE event_type = '{CO}') AS completion_timestamp,
           CASE WHEN count(*) FILTER (WHERE event_type = '{ST}') > 0 THEN 'pending' END
             AS progress_data_fetch,
           arg_max_null(CASE WHEN event_type = '{ST}' THEN 'pending' ELSE 'completed' END, {ORD})
             FILTER (WHERE event_type IN ('{ST}', '{TC}')) AS progress_lstm_training,
           CASE WHEN count(*) FILTER (WHERE event_type = '{ST}') > 0 THEN 'pending' END
             AS progress_prediction_generation,
           arg_max_null(timestamp, {ORD}) AS last_updated
    FROM (SELECT *, max(CASE WHEN event_type IN ('{ST}', '{CO}') THEN 1 ELSE 0 END) OVER
                   (PARTITION BY aggregate_id ORDER BY timestamp, seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS existed
          FROM event_log WHERE event_type IN ('{ST}', '{CO}', '{TC}')) v
    WHERE event_type IN ('{ST}', '{CO}') OR existed = 1
    GROUP BY aggregate_id"""

PROC_SQL = """
    SELECT symbol, CASE WHEN step = 'workflow_failed' THEN 'error' ELSE status END AS status,
           CASE WHEN step = 'workflow_failed' THEN 'request_failed' ELSE step END AS step,
           CASE WHEN step <> 'workflow_failed' THEN analysis_id END AS analysis_id, error, ts
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rn
          FROM step_log) s WHERE rn = 1"""


@register("aggregate_state", ids=("A8",), sql=with_fixtures("SELECT * FROM state", "event_log",
                                                            extra=[("state", STATE_SQL)]))
def q_aggregate_state(spark, sf_dir):
    return evo.aggregate_state(log(spark, sf_dir))


@register("event_history", ids=("A11",), sql=with_fixtures(f"""
    SELECT aggregate_id, row_number() OVER w AS pos, event_id, event_type, timestamp,
           CAST(sum(CASE WHEN event_type IN ({VERSIONED}) THEN 1 ELSE 0 END) OVER
                (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS version
    FROM event_log
    WINDOW w AS (PARTITION BY aggregate_id ORDER BY timestamp, seq)""", "event_log"))
def q_event_history(spark, sf_dir):
    return evo.event_history(log(spark, sf_dir))


_ROUTING_SQL = "(VALUES " + ", ".join(f"('{e}', '{p}')" for e, p in evo.ROUTING) + \
    ") AS r(event_type, projection)"


@register("event_routing", ids=("J4",), sql=with_fixtures(f"""
    SELECT l.event_id, l.event_type, l.aggregate_id, l.timestamp, r.projection
    FROM event_log l JOIN {_ROUTING_SQL} ON l.event_type = r.event_type""", "event_log"))
def q_event_routing(spark, sf_dir):
    routed = evo.route_events(log(spark, sf_dir), evo.routing_table(spark))
    return routed.select("event_id", "event_type", "aggregate_id", "timestamp", "projection")


@register("uncommitted_events", ids=("J6",), sql=with_fixtures("""
    SELECT event_id, event_type, aggregate_id, timestamp, seq FROM event_log
    WHERE event_id NOT IN (SELECT event_id FROM committed_log)""", "committed_log"))
def q_uncommitted_events(spark, sf_dir):
    produced = log(spark, sf_dir)
    out = evo.uncommitted(produced, fx.committed_log(produced))
    return out.select("event_id", "event_type", "aggregate_id", "timestamp", "seq")


@register("processing_status", ids=("C4",), sql=with_fixtures(PROC_SQL, "step_log"))
def q_processing_status(spark, sf_dir):
    return evo.processing_status(fx.step_log(log(spark, sf_dir)))


@register("read_model", ids=("A9", "T6"), sql=with_fixtures("SELECT * FROM rm", "event_log",
                                                       extra=[("rm", READ_MODEL_SQL)]))
def q_read_model(spark, sf_dir):
    return rmo.read_model(log(spark, sf_dir))


@register("system_status", ids=("A2",), sql=with_fixtures("""
    SELECT count(*) FILTER (WHERE status IN ('running', 'requested')) AS active_analyses,
           count(*) FILTER (WHERE status = 'completed') AS completed_analyses,
           count(*) AS total_symbols
    FROM rm""", "event_log", extra=[("rm", READ_MODEL_SQL)]))
def q_system_status(spark, sf_dir):
    return rmo.system_status(rmo.read_model(log(spark, sf_dir)))


@register("processing_stats", ids=("A3",), sql=with_fixtures("""
    SELECT *, (SELECT count(*) FROM proc) AS total_processing FROM proc""", "step_log", extra=[("proc", PROC_SQL)]))
def q_processing_stats(spark, sf_dir):
    return rmo.processing_stats(evo.processing_status(fx.step_log(log(spark, sf_dir))))


_STATUS_SQL = """
    SELECT r.symbol, coalesce(m.status, 'not_found') AS status, m.analysis_id,
           m.progress_data_fetch, m.progress_lstm_training, m.progress_prediction_generation,
           m.last_updated, 0 AS n_error_messages
    FROM req r LEFT JOIN rm m ON r.symbol = m.symbol"""


@register("analysis_status", ids=("C5", "J3"), sql=with_fixtures(
    _STATUS_SQL, "event_log", extra=[("rm", READ_MODEL_SQL), ("req", REQUESTS_SQL)]))
def q_analysis_status(spark, sf_dir):
    return rmo.analysis_status(requests(spark, sf_dir), rmo.read_model(log(spark, sf_dir)))


@register("analysis_results", ids=("C6", "P10"), sql=with_fixtures("""
    SELECT r.symbol,
           CASE WHEN m.status = 'completed' THEN 'success'
                WHEN m.status IN ('running', 'requested') THEN 'not_ready'
                ELSE 'not_found' END AS status,
           CASE WHEN m.status = 'completed' THEN m.results END AS results,
           CASE WHEN m.status = 'completed' THEN NULL
                WHEN m.status IN ('running', 'requested')
                  THEN printf('Analysis for %s is still running', r.symbol)
                ELSE printf('No analysis results for %s', r.symbol) END AS message
    FROM req r LEFT JOIN rm m ON r.symbol = m.symbol""",
    "event_log", extra=[("rm", READ_MODEL_SQL), ("req", REQUESTS_SQL)]))
def q_analysis_results(spark, sf_dir):
    return rmo.analysis_results(requests(spark, sf_dir), rmo.read_model(log(spark, sf_dir)))


@register("status_with_processing", ids=("J2",), sql=with_fixtures("""
    SELECT s.*, coalesce(p.status, 'not_found') AS processing_status,
           coalesce(p.step, 'unknown') AS processing_step
    FROM st s LEFT JOIN proc p ON s.symbol = p.symbol""",
    "step_log", extra=[("rm", READ_MODEL_SQL), ("req", REQUESTS_SQL), ("st", _STATUS_SQL),
                       ("proc", PROC_SQL)]))
def q_status_with_processing(spark, sf_dir):
    return rmo.status_with_processing_from_log(requests(spark, sf_dir),
                                               fx.with_steps(log(spark, sf_dir)))


@register("state_lookup", ids=("J3",), sql=with_fixtures("""
    SELECT r.symbol, s.status, s.current_analysis_id, s.current_data, s.lstm_training,
           s.predictions, s.last_analysis_timestamp, s.version, s.n_events
    FROM req r LEFT JOIN state s ON r.symbol = s.aggregate_id""",
    "event_log", extra=[("state", STATE_SQL), ("req", REQUESTS_SQL)]))
def q_state_lookup(spark, sf_dir):
    return rmo.state_lookup(requests(spark, sf_dir), evo.aggregate_state(log(spark, sf_dir)))


@register("workflow_debug_view", ids=("J5",), sql=with_fixtures("""
    SELECT coalesce(p.symbol, a.aggregate_id, m.symbol) AS symbol,
           p.status AS processing_status, p.step AS processing_step,
           a.status AS aggregate_status, a.lstm_training AS training_progress,
           a.predictions IS NOT NULL AS has_predictions, a.current_analysis_id, a.version,
           m.status AS read_model_status, m.analysis_id AS read_model_analysis_id
    FROM proc p FULL JOIN state a ON p.symbol = a.aggregate_id
    FULL JOIN rm m ON coalesce(p.symbol, a.aggregate_id) = m.symbol""",
    "step_log", extra=[("state", STATE_SQL), ("rm", READ_MODEL_SQL), ("proc", PROC_SQL)]))
def q_workflow_debug_view(spark, sf_dir):
    lg = log(spark, sf_dir)
    return rmo.workflow_debug_view_from_log(evo.processing_status(fx.step_log(lg)), lg)


_COMMANDS_SQL = with_fixtures(f"""
    SELECT substr(sha256('event|' || c.command_id), 1, 32) AS event_id,
           'AnalysisRequested' AS event_type, c.aggregate_id,
           substr(sha256('analysis|' || c.command_id), 1, 32) AS analysis_id,
           coalesce(json_extract_string(c.metadata, '$.requester'), 'system') AS requester,
           coalesce(e.status, 'idle') AS previous_status, c.timestamp
    FROM commands c ASOF LEFT JOIN
         (SELECT aggregate_id, timestamp,
                 CASE event_type WHEN '{RQ}' THEN 'requested' WHEN '{ST}' THEN 'running'
                                 ELSE 'completed' END AS status
          FROM event_log WHERE event_type IN ('{RQ}', '{ST}', '{CO}')) e
      ON c.aggregate_id = e.aggregate_id AND c.timestamp >= e.timestamp""",
    "commands", "event_log")


@register("commands_to_events_asof", ids=("C1",), sql=_COMMANDS_SQL)
@register("commands_to_events", ids=("C1",), sql=_COMMANDS_SQL)
def q_commands_to_events(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return evo.commands_to_events(fx.commands(t.events), fx.event_log(t.events))
