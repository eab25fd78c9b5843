"""DuckDB twins of the fixture mappings, used by the SQL oracle.

Each entry is the SQL body of a common table expression over the driver
views (``orders``, ``events``, ...).  ``with_fixtures`` prepends the CTEs a
query uses, dependencies first.
"""

from __future__ import annotations

from tickflow import schemas as S
from tickflow.sources.fixtures import STATUS_OF_STEP, STEP_OF_EVENT


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
_ET = f"{_list(S.EMITTED_EVENT_TYPES)}[event_id % 9 + 1]"
_K = "json_extract_string(props, '$.k')"

FIXTURES: dict[str, tuple[str, tuple[str, ...]]] = {
    "bars": ("""
        SELECT o_orderpriority AS symbol, o_orderdate AS ts,
               arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
               min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
               count(*) AS volume
        FROM orders GROUP BY 1, 2""", ()),
    "history_src": ("""
        SELECT o_orderpriority AS symbol, o_orderdate AS ts,
               arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
               min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
               avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS adj_close,
               count(*) AS volume
        FROM orders GROUP BY 1, 2""", ()),
    "order_ticks": ("""
        SELECT o_orderkey AS trade_id, o_orderpriority AS symbol, o_orderdate AS ts,
               o_totalprice AS price, CAST(1 AS BIGINT) AS size
        FROM orders""", ()),
    "ticks": (f"""
        SELECT event_id AS trade_id, event_type AS symbol, ts, value AS price,
               CAST({_K} AS BIGINT) AS size
        FROM events""", ()),
    "bars_1h": ("""
        SELECT symbol, date_trunc('hour', ts) AS ts,
               arg_min(price, {'t': ts, 'i': trade_id}) AS open, max(price) AS high,
               min(price) AS low, arg_max(price, {'t': ts, 'i': trade_id}) AS close,
               count(*) AS volume
        FROM ticks GROUP BY 1, 2""", ("ticks",)),
    "quotes_o": ("""
        SELECT symbol,
               CASE WHEN symbol = '2-HIGH' THEN 0.0 ELSE max(price) FILTER (WHERE rn = 1) END AS c,
               coalesce(max(price) FILTER (WHERE rn = 2), max(price) FILTER (WHERE rn = 1)) AS pc,
               max(ts) AS ts
        FROM (SELECT symbol, ts, price, row_number() OVER
                     (PARTITION BY symbol ORDER BY ts DESC, trade_id DESC) AS rn
              FROM order_ticks) q
        WHERE rn <= 2 AND symbol <> '5-LOW'
        GROUP BY symbol""", ("order_ticks",)),
    "quotes_e": ("""
        SELECT symbol,
               CASE WHEN symbol = 'click' THEN 0.0 ELSE max(price) FILTER (WHERE rn = 1) END AS c,
               coalesce(max(price) FILTER (WHERE rn = 2), max(price) FILTER (WHERE rn = 1)) AS pc,
               max(ts) AS ts
        FROM (SELECT symbol, ts, price, row_number() OVER
                     (PARTITION BY symbol ORDER BY ts DESC, trade_id DESC) AS rn
              FROM ticks) q
        WHERE rn <= 2 AND symbol <> 'view'
        GROUP BY symbol""", ("ticks",)),
    "alert_rules": ("""
        SELECT symbol, quantile_cont(price, 0.05) AS low, quantile_cont(price, 0.95) AS high
        FROM ticks GROUP BY symbol""", ("ticks",)),
    "event_log": (f"""
        SELECT CAST(event_id AS VARCHAR) AS event_id, {_ET} AS event_type,
               'U' || user_id AS aggregate_id, '{S.AGGREGATE_TYPE}' AS aggregate_type,
               '{{"analysis_id":"A' || event_id || '","symbol":"U' || user_id || '"' ||
               CASE {_ET}
                 WHEN '{S.ANALYSIS_REQUESTED}' THEN ',"requester":"system","previous_status":"idle"'
                 WHEN '{S.DATA_FETCHED}' THEN ',"data_info":{{"data_points":' || {_K} || '}}'
                 WHEN '{S.PREDICTION_COMPLETED}' THEN ',"predictions":{{"k":' || {_K} || '}}'
                 WHEN '{S.ANALYSIS_COMPLETED}' THEN ',"results":{{"request_id":"A' || event_id ||
                      '","k":' || {_K} || '}},"completion_timestamp":"' || {_ISO} || '"'
                 WHEN '{S.ANALYSIS_FAILED}' THEN ',"error":"stage failed"'
                 ELSE '' END || '}}' AS data,
               '{{}}' AS metadata, ts AS timestamp, CAST(1 AS INTEGER) AS version,
               event_id AS seq
        FROM events""", ()),
    "commands": ("""
        SELECT CAST(event_id AS VARCHAR) AS command_id, 'RequestAnalysis' AS command_type,
               upper('u' || user_id) AS aggregate_id, '{}' AS data, '{}' AS metadata,
               ts AS timestamp, CAST(NULL AS VARCHAR) AS correlation_id, event_id AS seq
        FROM events WHERE event_type = 'signup'""", ()),
    "step_log": (f"""
        SELECT aggregate_id AS symbol,
               coalesce({_case(_case('event_type', STEP_OF_EVENT), STATUS_OF_STEP)}, 'started') AS status,
               {_case('event_type', STEP_OF_EVENT)} AS step,
               json_extract_string(data, '$.analysis_id') AS analysis_id,
               CASE WHEN event_type = '{S.ANALYSIS_FAILED}'
                    THEN json_extract_string(data, '$.error') END AS error,
               timestamp AS ts, seq
        FROM event_log""", ("event_log",)),
    "committed_log": ("SELECT * FROM event_log WHERE seq % 10 <> 0", ("event_log",)),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in FIXTURES[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_fixtures(body: str, *uses: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <fixtures used>, <extra ctes> <body>``."""
    ctes = [f"{n} AS ({FIXTURES[n][0].strip()})" for n in _order(uses)]
    ctes += [f"{n} AS ({q.strip()})" for n, q in (extra or [])]
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


def full_sql(fn: str, col: str, n: int, part: str = "symbol", order: str = "ts") -> str:
    """SQL twin of ``functions.windows.full``."""
    w = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) OVER {w} >= {n} THEN {fn}({col}) OVER {w} END"


def lag_sql(col: str, part: str = "symbol", order: str = "ts") -> str:
    return f"lag({col}) OVER (PARTITION BY {part} ORDER BY {order})"


def ret_sql(part: str = "symbol", order: str = "ts") -> str:
    """Daily return with NULL for a zero or missing previous close."""
    return f"(close / NULLIF({lag_sql('close', part, order)}, 0) - 1)"
