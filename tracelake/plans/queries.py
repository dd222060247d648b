"""Queries over the driver's tables, one for each operator, and the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import scalars
from tracelake.functions.filters import filtered, of_project, since, sort_columns
from tracelake.operators import calls, claim_clusters, claims, graph, grid, incremental, kg_payload, neighbours, readers, schema_timeline, search, summaries, text_metrics, timing, trees, usage
from tracelake.operators.kept_index import KeptIndex
from tracelake.sources import sinks
from tracelake.sources import tables as T
from tracelake.sources.scratch import scratch_path
from tracelake.streaming import migrations, stages

#: The moment that look-backs count from: the tables are of January 2024.
NOW = datetime(2024, 1, 28, 12)
CALL_TYPES = ["tool", "skill", "subagent", "cli", "rule"]
QUERY = "the and"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _case(values: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_BUCKET = {"hour": "strftime(date_trunc('hour', ts), '%Y-%m-%dT%H')", "day": "strftime(ts, '%Y-%m-%d')", "week": "strftime(date_trunc('week', ts), '%Y-%m-%d')", "month": "strftime(ts, '%Y-%m')"}
_EV = f"""base AS (
  SELECT event_id AS event_key, user_id, 'p' || CAST(user_id % 10 AS VARCHAR) AS project_id,
    's' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS session_id, ts,
    {_case(T.MODELS)} AS model_id, {_case(T.KINDS)} AS msg_kind, {_case(T.CALLS)} AS call_type,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value * 10) AS BIGINT) AS output_tokens
  FROM events),
ev AS (
  SELECT *, k AS input_tokens, k * 10 AS cache_read_tokens, k * 2 AS cache_creation_tokens, user_id % 7 = 0 AS is_sidechain,
    CASE WHEN user_id % 7 = 0 THEN 'a' || CAST(event_key % 3 AS VARCHAR) END AS agent_id,
    event_key % 2 = 0 AS ended, event_key % 5 * 500 AS duration_ms, k / 99.0 AS context_ratio, 'n' || CAST(k % 20 AS VARCHAR) AS call_name,
    round((k + output_tokens * 5.0 + k * 10 * 0.1 + k * 2 * 1.25) * CASE WHEN model_id LIKE '%opus%' THEN 5.0 WHEN model_id LIKE '%sonnet%' THEN 3.0 WHEN model_id LIKE '%haiku%' THEN 1.0 ELSE 0.0 END / 1000000, 8) AS cost_usd
  FROM base)"""
_UNITS = "CAST(sum(CAST(round(cost_usd * 1e8) AS BIGINT)) AS BIGINT)"
_SUMS = f"CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, {_UNITS} / 1e8 AS cost_usd"


@query("usage_summary", f"WITH {_EV} SELECT count(DISTINCT project_id) AS n_projects, count(DISTINCT session_id) AS n_sessions, count(*) AS n_events, {_SUMS} FROM ev")
def usage_summary(spark, d):
    return usage.usage_summary(T.session_events(spark, d))


def _usage(grain: str) -> None:
    @query(f"usage_{grain}", f"WITH {_EV} SELECT project_id, model_id, {_BUCKET[grain]} AS bucket, count(*) AS n_events, count(DISTINCT session_id) AS n_sessions, {_SUMS} FROM ev GROUP BY 1, 2, 3")
    def run(spark, d):
        return usage.usage_by(T.session_events(spark, d), grain)


for _grain in ("day", "week", "month"):
    _usage(_grain)


@query("usage_hour_of_day", f"WITH {_EV} SELECT project_id, strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n_events, {_SUMS} FROM ev GROUP BY 1, 2, 3")
def usage_hour_of_day(spark, d):
    return usage.usage_hourly(T.session_events(spark, d))


@query("usage_last_7_days", f"WITH {_EV} SELECT project_id, model_id, {_BUCKET['day']} AS bucket, count(*) AS n_events, count(DISTINCT session_id) AS n_sessions, {_SUMS} FROM ev WHERE ts >= TIMESTAMP '2024-01-21 12:00:00' AND project_id = 'p3' GROUP BY 1, 2, 3")
def usage_last_7_days(spark, d):
    return usage.usage_by(filtered(T.session_events(spark, d), days=7, project="p3", now=NOW), "day")


@query("session_usage", f"WITH {_EV} SELECT project_id, session_id, model_id, count(*) AS n_events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, {_SUMS} FROM ev GROUP BY 1, 2, 3")
def session_usage(spark, d):
    return usage.session_usage(T.session_events(spark, d))


_SESSIONS = f"SELECT project_id, session_id, count(*) AS n_events, greatest(0, count(DISTINCT agent_id) - 1) AS n_subagents, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, {_UNITS} / 1e8 AS cost_usd FROM ev GROUP BY 1, 2"


@query("sessions", f"WITH {_EV} {_SESSIONS}")
def sessions(spark, d):
    return usage.sessions(T.session_events(spark, d))


@query("sessions_by_cost", f"WITH {_EV} SELECT * FROM ({_SESSIONS}) ORDER BY cost_usd DESC, session_id LIMIT 50")
def sessions_by_cost(spark, d):
    keys = {"cost": "cost_usd", "events": "n_events", "last_active": "last_ts", "subagents": "n_subagents"}
    return usage.sessions(T.session_events(spark, d)).orderBy(*sort_columns("cost", "desc", keys, ["session_id"])).limit(50)


@query("projects", f"WITH {_EV}, s AS ({_SESSIONS}) SELECT project_id, count(*) AS n_sessions, CAST(sum(n_events) AS BIGINT) AS n_events, {_UNITS} / 1e8 AS cost_usd FROM s GROUP BY 1")
def projects(spark, d):
    return usage.projects(usage.sessions(T.session_events(spark, d)))


@query("top_projects_weekly", f"WITH {_EV}, best AS (SELECT project_id, {_UNITS} / 1e8 AS total FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) SELECT project_id, {_BUCKET['week']} AS bucket, count(DISTINCT session_id) AS n_sessions, {_UNITS} / 1e8 AS cost_usd, (2 * {_UNITS} + count(DISTINCT session_id)) // (2 * count(DISTINCT session_id)) / 1e8 AS cost_per_session FROM ev WHERE project_id IN (SELECT project_id FROM best) GROUP BY 1, 2")
def top_projects_weekly(spark, d):
    return usage.top_projects_weekly(T.session_events(spark, d))


@query("rolling_cost_7", f"WITH {_EV}, per AS (SELECT {_BUCKET['day']} AS bucket, {_UNITS} AS cost FROM ev GROUP BY 1) SELECT bucket, cost / 1e8 AS cost_usd, CAST((2 * sum(cost) OVER w + count(*) OVER w) AS BIGINT) // (2 * count(*) OVER w) / 1e8 AS rolling_cost FROM per WINDOW w AS (ORDER BY bucket ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def rolling_cost_7(spark, d):
    return usage.rolling_cost(T.session_events(spark, d))


@query("day_hour_matrix", f"WITH {_EV}, cells AS (SELECT CAST(ts AS DATE) AS date, hour(ts) AS hour, {_UNITS} AS cost FROM ev GROUP BY 1, 2), means AS (SELECT (CAST(dayofweek(date) AS INTEGER) + 6) % 7 AS weekday, hour, CAST(20 * sum(cost) + count(*) AS BIGINT) // (2 * count(*)) / 1e9 AS m FROM cells WHERE cost > 0 GROUP BY 1, 2), grid AS (SELECT CAST(g // 24 AS INTEGER) AS weekday, CAST(g % 24 AS INTEGER) AS hour FROM (SELECT unnest(range(168)) AS g)) SELECT grid.weekday, grid.hour, coalesce(m, 0) AS mean_cost FROM grid LEFT JOIN means ON grid.weekday = means.weekday AND grid.hour = means.hour")
def day_hour_matrix(spark, d):
    return usage.day_hour_matrix(T.session_events(spark, d))


@query("hour_heatmap", f"WITH {_EV} SELECT strftime(ts, '%Y-%m-%d') AS date, " + ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h}) AS h{h:02d}" for h in range(24)) + " FROM ev GROUP BY 1")
def hour_heatmap(spark, d):
    return usage.hour_heatmap(T.session_events(spark, d))


@query("cube_all_grains", f"WITH {_EV} " + " UNION ALL ".join(f"SELECT '{g}' AS granularity, {b} AS bucket, project_id, session_id, model_id, count(*) AS n_events, {_SUMS} FROM ev GROUP BY 2, 3, 4, 5" for g, b in _BUCKET.items()))
def cube_all_grains(spark, d):
    return usage.rounded(usage.cube(T.session_events(spark, d)))


@query("cube_refreshed", f"WITH {_EV} " + " UNION ALL ".join(f"SELECT '{g}' AS granularity, {b} AS bucket, project_id, session_id, model_id, count(*) AS n_events, {_SUMS} FROM ev GROUP BY 2, 3, 4, 5" for g, b in _BUCKET.items()))
def cube_refreshed(spark, d):
    events = T.session_events(spark, d)
    late = F.col("ts") >= F.lit(NOW)
    return usage.rounded(usage.refreshed_cube(usage.cube(events.where(~late)), events, events.where(late)))


_LIST = "c AS (SELECT project_id, session_id, " + ", ".join(f"count(*) FILTER (WHERE call_type = '{t}') AS n_{t}" for t in CALL_TYPES) + " FROM ev GROUP BY 1, 2), sk AS (SELECT project_id, session_id, call_name, row_number() OVER (PARTITION BY project_id, session_id ORDER BY count(*) DESC, call_name) AS rn FROM ev WHERE call_type = 'skill' GROUP BY 1, 2, 3)"


@query("sessions_list", f"WITH {_EV}, {_LIST}, s AS ({_SESSIONS}) SELECT s.*, " + ", ".join(f"c.n_{t}" for t in CALL_TYPES) + ", sk.call_name AS top_skill, round((" + " + ".join(f"c.n_{t}" for t in CALL_TYPES) + ") * 100.0 / s.n_events, 1) AS calls_per_100 FROM s LEFT JOIN c ON s.project_id = c.project_id AND s.session_id = c.session_id LEFT JOIN sk ON s.project_id = sk.project_id AND s.session_id = sk.session_id AND sk.rn = 1")
def sessions_list(spark, d):
    return usage.sessions_list(T.session_events(spark, d), T.session_calls(spark, d), CALL_TYPES, "skill")


@query("modal_skill", f"WITH {_EV}, {_LIST}, m AS (SELECT project_id, call_name AS top_skill, count(*) AS n_sessions FROM sk WHERE rn = 1 GROUP BY 1, 2) SELECT project_id, top_skill, n_sessions FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n_sessions DESC, top_skill) AS r FROM m) WHERE r = 1")
def modal_skill(spark, d):
    return usage.modal_skill(sessions_list(spark, d))


@query("calls_timeline", f"WITH {_EV} SELECT {_BUCKET['day']} AS bucket, call_type, count(*) AS n_calls FROM ev GROUP BY 1, 2")
def calls_timeline(spark, d):
    return calls.calls_timeline(T.session_calls(spark, d))


@query("calls_pivot", f"WITH {_EV} SELECT {_BUCKET['week']} AS bucket, " + ", ".join(f"count(*) FILTER (WHERE call_type = '{t}') AS {t}" for t in CALL_TYPES) + " FROM ev GROUP BY 1")
def calls_pivot(spark, d):
    return calls.calls_pivot(T.session_calls(spark, d), CALL_TYPES, "week")


@query("top_calls", f"WITH {_EV} SELECT call_name, count(*) AS n_calls, count(DISTINCT session_id) AS n_sessions FROM ev WHERE call_type = 'cli' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_calls(spark, d):
    return calls.top_calls(T.session_calls(spark, d), "cli", limit=10)


@query("top_calls_excluding", f"WITH {_EV} SELECT call_name, count(*) AS n_calls, count(DISTINCT session_id) AS n_sessions FROM ev WHERE call_type = 'skill' AND call_name NOT IN ('n1', 'n2', 'n3') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_calls_excluding(spark, d):
    return calls.top_calls(T.session_calls(spark, d), "skill", limit=10, exclude=["n1", "n2", "n3"])


@query("timeline_events", f"WITH {_EV} SELECT session_id, event_key, row_number() OVER w AS seq, strftime(min(ts) OVER (PARTITION BY session_id), '%Y-%m-%d %H:%M:%S') AS session_start, CAST(sum(output_tokens) OVER (PARTITION BY session_id ORDER BY ts, event_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_output FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_key)")
def timeline_events(spark, d):
    return timing.timeline(T.session_events(spark, d))


@query("session_order", f"WITH {_EV}, per AS (SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, CAST(sum(output_tokens) AS BIGINT) AS peak_output FROM ev GROUP BY 1) SELECT *, dense_rank() OVER (ORDER BY session_start, session_id) AS place FROM per")
def session_order(spark, d):
    return timing.session_order(timing.timeline(T.session_events(spark, d)))


_TURNS = """walk AS (
  SELECT *, lead(ts) OVER (PARTITION BY project_id, session_id ORDER BY ts, event_key) AS next_ts,
    max(CASE WHEN msg_kind = 'human' THEN ts END) OVER (PARTITION BY project_id, session_id ORDER BY ts, event_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked
  FROM ev WHERE NOT is_sidechain),
t AS (
  SELECT project_id, session_id, event_key, model_id, output_tokens, duration_ms,
    CASE WHEN duration_ms > 0 THEN round(output_tokens * 1000.0 / duration_ms, 2) END AS tps,
    (epoch_us(ts) // 1000) - (epoch_us(asked) // 1000) AS active_ms, (epoch_us(next_ts) // 1000) - (epoch_us(ts) // 1000) AS idle_ms,
    coalesce(output_tokens >= 200 AND (epoch_us(next_ts) // 1000) - (epoch_us(ts) // 1000) < output_tokens * 1000.0 / 8, false) AS too_fast
  FROM walk WHERE msg_kind = 'assistant_text' AND ended)"""


@query("session_turns", f"WITH {_EV}, {_TURNS} SELECT * FROM t")
def session_turns(spark, d):
    return timing.turns(T.session_events(spark, d))


@query("session_timing", f"WITH {_EV}, {_TURNS} SELECT project_id, session_id, count(*) AS n_turns, CAST(coalesce(sum(idle_ms), 0) AS BIGINT) AS idle_ms, CAST(coalesce(sum(active_ms), 0) AS BIGINT) AS active_ms, count(*) FILTER (WHERE too_fast) AS n_too_fast FROM t GROUP BY 1, 2")
def session_timing(spark, d):
    return timing.session_timing(timing.turns(T.session_events(spark, d)))


_METRICS = f"""WITH {_EV}, {_TURNS},
tt AS (SELECT project_id, session_id, count(*) AS n_turns, CAST(coalesce(sum(idle_ms), 0) AS BIGINT) AS idle_ms,
    CAST(coalesce(sum(active_ms), 0) AS BIGINT) AS active_ms, count(*) FILTER (WHERE too_fast) AS n_too_fast FROM t GROUP BY 1, 2),
ss AS (SELECT project_id, session_id, {_UNITS} / 1e8 AS cost_usd, max(context_ratio) AS peak_context_ratio,
    round(sum(output_tokens) FILTER (WHERE msg_kind = 'assistant_text' AND duration_ms > 0) * 1000.0
      / sum(duration_ms) FILTER (WHERE msg_kind = 'assistant_text' AND duration_ms > 0), 4) AS avg_tps FROM ev GROUP BY 1, 2)
SELECT ss.*, coalesce(n_turns, 0) AS n_turns, coalesce(idle_ms, 0) AS idle_ms, coalesce(active_ms, 0) AS active_ms, coalesce(n_too_fast, 0) AS n_too_fast
FROM ss LEFT JOIN tt ON ss.project_id = tt.project_id AND ss.session_id = tt.session_id"""


@query("session_metrics", _METRICS)
def session_metrics(spark, d):
    return timing.session_metrics(T.session_events(spark, d))


@query("session_events_meta", f"WITH {_EV} SELECT session_id, event_key, is_sidechain AS is_meta FROM ev WHERE project_id = 'p7'")
def session_events_meta(spark, d):
    return filtered(T.session_events(spark, d), project="p7").select("session_id", "event_key", F.when(F.col("is_sidechain"), True).otherwise(False).alias("is_meta"))


@query("sessions_a_day", f"WITH {_EV}, w AS (SELECT project_id, count(DISTINCT session_id) AS n_sessions, count(DISTINCT {_BUCKET['week']}) AS n_weeks FROM ev GROUP BY 1) SELECT *, round(n_sessions * 1.0 / (n_weeks * 7), 4) AS per_day FROM w")
def sessions_a_day(spark, d):
    return usage.sessions_a_day(T.session_events(spark, d))


@query("performance_by_model", f"WITH {_EV}, {_TURNS}, sp AS (SELECT model_id, CAST(sum(idle_ms) AS BIGINT) AS idle_ms, CAST(sum(active_ms) AS BIGINT) AS active_ms FROM t GROUP BY 1), h AS (SELECT model_id, count(*) AS n_responses, round(sum(output_tokens) FILTER (WHERE duration_ms > 0) * 1000.0 / sum(duration_ms) FILTER (WHERE duration_ms > 0), 2) AS avg_tps, round(median(CASE WHEN duration_ms > 0 THEN output_tokens * 1000.0 / duration_ms END), 2) AS median_tps FROM ev WHERE msg_kind = 'assistant_text' GROUP BY 1) SELECT h.*, coalesce(sp.idle_ms, 0) AS idle_ms, coalesce(sp.active_ms, 0) AS active_ms FROM h LEFT JOIN sp ON h.model_id = sp.model_id")
def performance_by_model(spark, d):
    return timing.performance_by_model(T.session_events(spark, d))


@query("ratio_histogram", f"WITH {_EV}, b AS (SELECT CAST(least(floor(context_ratio * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM ev GROUP BY 1) SELECT CAST(g AS INTEGER) AS bin, coalesce(n, 0) AS n_events FROM (SELECT unnest(range(10)) AS g) LEFT JOIN b ON g = b.bin")
def ratio_histogram(spark, d):
    return timing.ratio_histogram(T.session_events(spark, d))


@query("sessionized", f"WITH {_EV}, g AS (SELECT *, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_key) <= 1800000 THEN 0 ELSE 1 END AS fresh FROM ev), r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM g) SELECT user_id, run, count(*) AS n_events, min(event_key) AS first_event FROM r GROUP BY 1, 2")
def sessionized(spark, d):
    return timing.sessionized(T.session_events(spark, d))


_LINKS = "links AS (SELECT event_id - event_id % 16 + (event_id % 16 - 1) // 2 AS parent, event_id AS child FROM events WHERE event_id % 16 > 0)"


@query("event_descendants", f"WITH RECURSIVE {_LINKS}, walk AS (SELECT event_id AS root, event_id AS node, 0 AS depth FROM events UNION ALL SELECT w.root, l.child, w.depth + 1 FROM walk w JOIN links l ON l.parent = w.node) SELECT root, node, CAST(depth AS INTEGER) AS depth FROM walk")
def event_descendants(spark, d):
    roots = T.table(spark, d, "events").select(F.col("event_id").alias("node"))
    return trees.descendants(T.event_links(spark, d), roots)


@query("event_tree", f"WITH RECURSIVE {_LINKS}, walk AS (SELECT CAST(160 AS BIGINT) AS node, 0 AS depth UNION ALL SELECT l.child, w.depth + 1 FROM walk w JOIN links l ON l.parent = w.node) SELECT node, CAST(depth AS INTEGER) AS depth FROM walk")
def event_tree(spark, d):
    T.event_links(spark, d).createOrReplaceTempView("tracelake_links")
    return trees.tree_below(spark, "tracelake_links", 160)


@query("dedupe_first_wins", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS rn FROM lineitem) WHERE rn = 1")
def dedupe_first_wins(spark, d):
    lines = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return incremental.first_wins(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate"])


@query("anti_unprocessed", "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def anti_unprocessed(spark, d):
    log = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return incremental.unprocessed(T.table(spark, d, "orders").select("o_orderkey", "o_custkey"), log, ["o_orderkey"])


@query("semi_in_window", f"WITH {_EV} SELECT event_key, session_id FROM ev WHERE session_id IN (SELECT session_id FROM ev WHERE ts >= TIMESTAMP '2024-01-21 12:00:00')")
def semi_in_window(spark, d):
    events = T.session_events(spark, d)
    return incremental.within_window(events.select("event_key", "session_id"), filtered(events, days=7, now=NOW).select("session_id").distinct(), ["session_id"])


@query("null_safe_missing", "WITH e AS (SELECT event_id, nullif(event_type, 'error') AS kind, user_id FROM events), k AS (SELECT DISTINCT kind, user_id FROM e WHERE event_id % 10 = 0) SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.kind IS NOT DISTINCT FROM e.kind AND k.user_id IS NOT DISTINCT FROM e.user_id)")
def null_safe_missing(spark, d):
    e = T.table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"), "user_id")
    return incremental.null_safe_missing(e, e.where("event_id % 10 = 0"), ["kind", "user_id"])


@query("stage_stats", "SELECT 'labelled' AS stage, n AS n_eligible, least(m, n) AS n_done, n - least(m, n) AS n_pending, round(least(m, n) * 100.0 / n, 1) AS pct FROM (SELECT count(DISTINCT doc_id) AS n FROM documents), (SELECT count(DISTINCT doc_id) AS m FROM labels)")
def stage_stats(spark, d):
    return incremental.stage_stats(T.table(spark, d, "documents"), T.table(spark, d, "labels"), ["doc_id"], "labelled")


_LATENCY = "r AS (SELECT event_type AS endpoint, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM {0}) SELECT endpoint, max(n) AS n_calls, max(CASE WHEN nth = least(n, floor(n * 0.5) + 1) THEN ms END) AS p50, max(CASE WHEN nth = least(n, floor(n * 0.95) + 1) THEN ms END) AS p95, max(CASE WHEN nth = least(n, floor(n * 0.99) + 1) THEN ms END) AS p99, max(ms) AS max_ms FROM r GROUP BY 1"


@query("latency_table", "WITH " + _LATENCY.format("events"))
def latency_table(spark, d):
    return incremental.latency_table(T.table(spark, d, "events").select(F.col("event_type").alias("endpoint"), F.col("value").alias("ms")), "endpoint", "ms")


@query("latency_regressions", f"WITH a AS (WITH {_LATENCY.format('(SELECT * FROM events WHERE event_id % 2 = 0)')}), b AS (WITH {_LATENCY.format('(SELECT * FROM events WHERE event_id % 2 = 1)')}) SELECT b.endpoint, b.p95 AS p95_after, a.p95 AS p95_before, b.p95 > a.p95 * 1.01 AS regressed FROM a JOIN b ON a.endpoint = b.endpoint")
def latency_regressions(spark, d):
    e = T.table(spark, d, "events").select("event_id", F.col("event_type").alias("endpoint"), F.col("value").alias("ms"))
    halves = [incremental.latency_table(e.where(F.col("event_id") % 2 == k), "endpoint", "ms") for k in (0, 1)]
    return incremental.regressions(*halves, "endpoint", 0.01)


_SCOPES = "scopes AS (SELECT 'p' || CAST(g AS VARCHAR) AS project_id, CASE WHEN g % 2 = 0 THEN 'clients' ELSE 'play' END AS s1, 'g' || CAST(g % 3 AS VARCHAR) AS s2 FROM (SELECT unnest(range(10)) AS g)), up AS (SELECT project_id, '' AS scope FROM scopes UNION ALL SELECT project_id, s1 FROM scopes UNION ALL SELECT project_id, s1 || '/' || s2 FROM scopes UNION ALL SELECT project_id, s1 || '/' || s2 || '/' || project_id FROM scopes)"
_SB = f"sb AS (SELECT project_id, session_id, strftime(date_trunc('week', min(ts)), '%Y-%m-%d') AS bucket FROM ev GROUP BY 1, 2)"
_CL = "cl AS (SELECT DISTINCT project_id, session_id, call_type AS lens, 'uses ' || call_name AS claim FROM ev)"


@query("scope_rollup", f"WITH {_EV}, {_SCOPES} SELECT scope, count(*) AS n_events, count(DISTINCT session_id) AS n_sessions, {_UNITS} / 1e8 AS cost_usd FROM ev JOIN up ON ev.project_id = up.project_id GROUP BY 1")
def scope_rollup(spark, d):
    rows = T.session_events(spark, d).join(F.broadcast(T.project_scopes(spark, d)), "project_id")
    return claims.scope_rollup(rows, {"n_events": F.count(F.lit(1)), "n_sessions": F.countDistinct("session_id"), "cost_usd": usage.money()})


def _rollup(spark, d):
    events = T.session_events(spark, d)
    return claims.claim_rollup(T.session_claims(spark, d), claims.session_buckets(events, "week"), T.project_scopes(spark, d))


_ROLLUP = f"{_EV}, {_SCOPES}, {_SB}, {_CL}, ru AS (SELECT scope, bucket, lens, claim, count(DISTINCT cl.session_id) AS n_sessions FROM cl JOIN sb ON cl.project_id = sb.project_id AND cl.session_id = sb.session_id JOIN up ON cl.project_id = up.project_id GROUP BY 1, 2, 3, 4)"


@query("claim_rollup", f"WITH {_ROLLUP} SELECT *, row_number() OVER (PARTITION BY scope, bucket, lens ORDER BY n_sessions DESC, claim) - 1 AS place FROM ru")
def claim_rollup(spark, d):
    return _rollup(spark, d).drop("session_ids")


@query("claims_set_union", f"WITH {_EV}, {_SCOPES}, {_CL} SELECT scope, lens, claim, count(DISTINCT session_id) AS n_sessions FROM cl JOIN up ON cl.project_id = up.project_id GROUP BY 1, 2, 3")
def claims_set_union(spark, d):
    return claims.claim_union(_rollup(spark, d))


@query("session_memberships", f"WITH {_EV}, {_SCOPES}, {_SB}, {_CL}, one AS (SELECT min(session_id) AS session_id FROM cl) SELECT scope, bucket, count(*) AS n_claims FROM cl JOIN one ON cl.session_id = one.session_id JOIN sb ON cl.project_id = sb.project_id AND cl.session_id = sb.session_id JOIN up ON cl.project_id = up.project_id GROUP BY 1, 2")
def session_memberships(spark, d):
    first = T.session_claims(spark, d).agg(F.min("session_id")).first()[0]
    return claims.memberships(_rollup(spark, d), first)


_FAILS = "f AS (SELECT DISTINCT project_id, session_id FROM ev WHERE call_type = 'rule')"


@query("summarisation_coverage", f"WITH {_EV}, {_CL}, {_FAILS}, s AS (SELECT DISTINCT project_id, session_id FROM ev), dn AS (SELECT DISTINCT project_id, session_id, 1 AS x FROM cl), j AS (SELECT s.project_id, dn.x AS done, f.session_id AS failed FROM s LEFT JOIN dn ON s.project_id = dn.project_id AND s.session_id = dn.session_id LEFT JOIN f ON s.project_id = f.project_id AND s.session_id = f.session_id), g AS (SELECT project_id, count(*) AS total, count(done) AS done, count(*) FILTER (WHERE failed IS NOT NULL AND done IS NULL) AS failed FROM j GROUP BY 1) SELECT *, total - done - failed AS pending, round(done * 100.0 / total, 1) AS pct FROM g")
def summarisation_coverage(spark, d):
    return claims.coverage(T.session_events(spark, d), T.session_claims(spark, d), T.claim_failures(spark, d))


_PIVOT = f"{_EV}, {_SCOPES}, {_SB}, {_CL}, {_FAILS}, dn AS (SELECT DISTINCT project_id, session_id, 1 AS x FROM cl), pv AS (SELECT scope, bucket, count(*) AS n_sessions, count(dn.x) AS n_done, count(f.session_id) AS n_failed FROM sb JOIN up ON sb.project_id = up.project_id LEFT JOIN dn ON sb.project_id = dn.project_id AND sb.session_id = dn.session_id LEFT JOIN f ON sb.project_id = f.project_id AND sb.session_id = f.session_id GROUP BY 1, 2), st AS (SELECT *, CAST(CASE WHEN n_done = n_sessions THEN 2 WHEN n_done > 0 THEN 1 ELSE 0 END AS INTEGER) AS status FROM pv)"


def _pivot(spark, d):
    return claims.coverage_pivot(claims.session_buckets(T.session_events(spark, d), "week"), T.project_scopes(spark, d), T.session_claims(spark, d), T.claim_failures(spark, d))


@query("coverage_pivot", f"WITH {_PIVOT} SELECT * FROM st")
def coverage_pivot(spark, d):
    return _pivot(spark, d)


@query("coverage_heatmap", f"WITH {_PIVOT} SELECT a.scope, b.bucket, coalesce(st.status, 0) AS status FROM (SELECT DISTINCT scope FROM st) a CROSS JOIN (SELECT DISTINCT bucket FROM st) b LEFT JOIN st ON st.scope = a.scope AND st.bucket = b.bucket")
def coverage_heatmap(spark, d):
    return claims.dense_heatmap(_pivot(spark, d))


@query("failure_categories", f"WITH {_EV}, c AS (SELECT CASE k % 7 WHEN 0 THEN 'context_overflow' WHEN 1 THEN 'non_array_lens' WHEN 2 THEN 'missing_lens_key' WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'truncated_json' ELSE 'empty_or_refusal' END WHEN 4 THEN 'truncated_json' WHEN 5 THEN 'malformed_json' ELSE CASE WHEN k % 2 = 1 THEN 'empty_or_refusal' ELSE 'other' END END AS category FROM ev WHERE call_type = 'rule') SELECT category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM c GROUP BY 1")
def failure_categories(spark, d):
    return claims.failure_analysis(T.claim_failures(spark, d)).drop("samples")


@query("failure_rollup", f"WITH {_EV}, {_SCOPES}, {_SB}, {_FAILS} SELECT scope, bucket, count(DISTINCT f.session_id) AS n_sessions FROM f JOIN sb ON f.project_id = sb.project_id AND f.session_id = sb.session_id JOIN up ON f.project_id = up.project_id GROUP BY 1, 2")
def failure_rollup(spark, d):
    return claims.failure_rollup(T.claim_failures(spark, d), claims.session_buckets(T.session_events(spark, d), "week"), T.project_scopes(spark, d))


@query("plurality_parent", "WITH m AS (SELECT label AS fine, CAST(vec_id % 4 - 1 AS INTEGER) AS coarse FROM embeddings), c AS (SELECT fine, coarse, count(*) AS n FROM m WHERE coarse >= 0 AND fine >= 0 GROUP BY 1, 2) SELECT fine, coarse FROM (SELECT *, row_number() OVER (PARTITION BY fine ORDER BY n DESC, coarse) AS rn FROM c) WHERE rn = 1")
def plurality_parent(spark, d):
    m = T.table(spark, d, "embeddings").select(F.col("label").alias("fine"), (F.col("vec_id") % 4 - 1).cast("int").alias("coarse"))
    return claims.plurality_parents(m)


@query("cluster_tree", "WITH l AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'Unclustered' ELSE event_type END AS coarse, 'c' || CAST(user_id % 3 AS VARCHAR) AS fine, CAST(json_extract_string(props, '$.k') AS BIGINT) AS claim, user_id FROM events) SELECT 'goals' AS lens, coarse, fine, count(DISTINCT claim) AS n_leaves, count(DISTINCT user_id) AS n_sessions FROM l GROUP BY 2, 3")
def cluster_tree(spark, d):
    e = T.table(spark, d, "events")
    leaves = e.select(F.lit("goals").alias("lens"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("coarse"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("fine"), F.get_json_object("props", "$.k").alias("claim"), F.array(F.col("user_id").cast("string")).alias("sessions"))
    return claims.cluster_tree(leaves)


@query("member_texts", f"WITH {_EV}, c AS (SELECT project_id AS cluster, call_name AS claim, count(*) AS n FROM ev GROUP BY 1, 2) SELECT cluster, claim, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY n DESC, claim) AS INTEGER) AS rank FROM c) WHERE rank <= 5")
def member_texts(spark, d):
    return claims.member_texts(T.session_calls(spark, d).select(F.col("project_id").alias("cluster"), F.col("call_name").alias("claim")), 5)


@query("session_texts", "WITH h AS (SELECT conv_id, sha256(string_agg(text || chr(0), '' ORDER BY turn)) AS content_hash, count(*) AS n_texts FROM conversations WHERE role = 'user' AND text <> '' GROUP BY 1) SELECT CAST(conv_id AS VARCHAR) AS session_id, content_hash, n_texts FROM h")
def session_texts(spark, d):
    c = T.table(spark, d, "conversations")
    rows = c.select(F.lit("p").alias("project_id"), F.col("conv_id").cast("string").alias("session_id"), F.timestamp_seconds("turn").alias("ts"), F.col("turn").alias("event_key"), F.when(F.col("role") == "user", "human").otherwise("other").alias("msg_kind"), F.col("text").alias("message_content"))
    return claims.session_texts(rows).select("session_id", "content_hash", F.size("texts").cast("long").alias("n_texts"))


def _bm25_sql(where: str = "true", more: str = "", limit: int = 20) -> str:
    terms = sorted(set(QUERY.split()))
    score = " - ".join(["0"] + [f"greatest(0.000001, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / m))" for i in range(len(terms))])
    words = "list_filter(string_split_regex(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"WITH w AS (SELECT doc_id, lang, source, n_chars, {words} AS words FROM documents), c AS (SELECT doc_id, lang, source, n_chars, len(words) AS length, " + ", ".join(f"len(list_filter(words, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms)) + " FROM w), s AS (SELECT count(*) AS n, avg(length) AS m, " + ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms))) + f" FROM c) SELECT doc_id, round({score}, 6) AS rank{more} FROM c, s WHERE {where} AND " + " AND ".join(f"tf{i} > 0" for i in range(len(terms))) + f" ORDER BY 2, 1 LIMIT {limit}"


@query("keyword_bm25", _bm25_sql())
def keyword_bm25(spark, d):
    return search.bm25(T.table(spark, d, "documents"), QUERY, "doc_id", "text")


@query("kept_index_bm25", _bm25_sql())
def kept_index_bm25(spark, d):
    """All documents go in, the short ones as drafts first; these are replaced, and the search reads two term buckets."""
    docs = T.table(spark, d, "documents").select("doc_id", "text", (F.length("text") < 1000).alias("short"))
    index = KeptIndex(spark, scratch_path(spark, "index"), "doc_id")
    index.put(docs.withColumn("text", F.when(F.col("short"), F.concat_ws(" ", "text", F.lit("the draft and the rest"))).otherwise(F.col("text"))), "text")
    index.put(docs.where("short"), "text")
    return index.bm25(QUERY)


@query("search_events", _bm25_sql("lang = 'en'", ", source, n_chars", 30))
def search_events(spark, d):
    docs = T.table(spark, d, "documents")
    found = search.search_events(docs, QUERY, "doc_id", "text", where=F.col("lang") == "en", limit=30)
    return found.select("doc_id", "rank", "source", "n_chars")


@query("search_events_semantic")
def search_events_semantic(spark, d):
    c = T.table(spark, d, "conversations").withColumn("event_key", F.concat_ws("-", "conv_id", "turn"))
    return search.search_events(c, "a question about the text", "event_key", "text", mode="semantic", where=F.col("role") == "user").select("event_key", "distance", "conv_id", "turn")


@query("semantic_knn", "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7), dd AS (SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS distance FROM embeddings, q WHERE label <> 3) SELECT vec_id, distance FROM dd ORDER BY 2, 1 LIMIT 20")
def semantic_knn(spark, d):
    v = T.table(spark, d, "embeddings")
    one = v.where("vec_id = 7").first()
    return search.nearest(v, [float(x) for x in one.embedding], "vec_id", "embedding", where=F.col("label") != 3)


@query("chunk_text")
def chunk_text(spark, d):
    return search.chunks(T.table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), "doc_id", "text")


@query("schema_timeline", "WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS event_date, '$.k' AS json_path FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL), p AS (SELECT json_path, event_date, count(*) AS n_events FROM r GROUP BY 1, 2) SELECT *, min(event_date) OVER (PARTITION BY json_path) AS first_seen FROM p")
def schema_timeline_(spark, d):
    e = T.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.parse_json("props").alias("raw"))
    return schema_timeline.schema_timeline(schema_timeline.key_paths(e))


@query("text_metrics")
def text_metrics_(spark, d):
    c = T.table(spark, d, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return text_metrics.scored(a.join(b, ["conv_id", "turn"]).withColumn("key", F.concat_ws("-", "conv_id", "turn")), "key", "answer", "reference")


#: Customers by the orders of each: every order links its customer with another one that its numbers name.
_GRAPH = """g AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS src,
    'c' || CAST((o_custkey * 7 + o_orderkey % 5) % (SELECT max(o_custkey) FROM orders) + 1 AS VARCHAR) AS dst FROM orders),
u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM g WHERE src <> dst UNION ALL SELECT dst, src FROM g WHERE src <> dst))"""


def _graph(spark, d):
    o = T.table(spark, d, "orders")
    last = o.agg(F.max("o_custkey")).first()[0] or 1
    node = lambda n: F.concat(F.lit("c"), n.cast("string"))
    return o.select(node(F.col("o_custkey")).alias("src"), node((F.col("o_custkey") * 7 + F.col("o_orderkey") % 5) % last + 1).alias("dst"), F.lit(1.0).alias("weight"))


@query("degrees", f"WITH {_GRAPH} SELECT src AS node, count(*) AS degree FROM u GROUP BY 1")
def degrees(spark, d):
    return graph.degrees(_graph(spark, d))


@query("bfs_expand", f"WITH {_GRAPH}, d0 AS (SELECT min(src) AS node FROM u), d1 AS (SELECT DISTINCT dst AS node FROM u JOIN d0 ON u.src = d0.node), d2 AS (SELECT DISTINCT dst AS node FROM u JOIN d1 ON u.src = d1.node) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT node, 0 AS depth FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2) GROUP BY 1")
def bfs_expand(spark, d):
    edges = _graph(spark, d)
    return graph.neighbourhood(edges, graph.undirected(edges).agg(F.min("src").alias("node")), 2)


@query("connected_components", f"WITH RECURSIVE {_GRAPH}, w AS (SELECT src AS node, src AS root FROM u UNION SELECT u.dst, w.root FROM w JOIN u ON u.src = w.node) SELECT node, min(root) AS component FROM w GROUP BY 1")
def connected_components(spark, d):
    return graph.components(_graph(spark, d))


def _core_sql(k: int, edges: str = "u", rounds: int = 60) -> str:
    """Edges peeled again and again, more often than any of these graphs needs; what the last round has is the core."""
    return f"""e AS (SELECT 0 AS it, src, dst FROM {edges} UNION ALL SELECT it + 1, src, dst FROM (SELECT *, count(*) OVER (PARTITION BY src) AS s, count(*) OVER (PARTITION BY dst) AS t FROM e) WHERE s >= {k} AND t >= {k} AND it < {rounds})
SELECT src, dst FROM e WHERE it = {rounds} AND src < dst"""


@query("k_core", f"WITH RECURSIVE {_GRAPH}, {_core_sql(7)}")
def k_core(spark, d):
    return graph.k_core(_graph(spark, d), 7)


_HEAVY = "h AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM g WHERE src <> dst GROUP BY 1, 2 HAVING count(*) >= 2), uh AS (SELECT a AS src, b AS dst FROM h UNION ALL SELECT b, a FROM h)"


@query("k_core_heavy", f"WITH RECURSIVE {_GRAPH}, {_HEAVY}, {_core_sql(2, 'uh')}")
def k_core_heavy(spark, d):
    """The edges of two orders or more, and of those the part in which everyone has two neighbours."""
    return graph.k_core(_graph(spark, d), 2, least_weight=2)


@query("communities")
def communities(spark, d):
    return graph.communities(_graph(spark, d))


@query("community_levels")
def community_levels(spark, d):
    return graph.community_levels(_graph(spark, d))


@query("betweenness")
def betweenness(spark, d):
    return graph.betweenness(_graph(spark, d)).withColumn("score", F.round("score", 4))


@query("edge_rollup", "WITH e AS (SELECT 's' || CAST(l_suppkey % 10 AS VARCHAR) AS src, 'n' || CAST(l_partkey % 10 AS VARCHAR) AS dst, l_returnflag AS rel_type, l_quantity AS weight FROM lineitem) SELECT 'k' || CAST(CAST(substr(src, 2) AS INTEGER) % 4 AS VARCHAR) AS src, 'k' || CAST(CAST(substr(dst, 2) AS INTEGER) % 4 AS VARCHAR) AS dst, rel_type, sum(weight) AS weight FROM e WHERE CAST(substr(src, 2) AS INTEGER) % 4 <> CAST(substr(dst, 2) AS INTEGER) % 4 GROUP BY 1, 2, 3")
def edge_rollup(spark, d):
    l = T.table(spark, d, "lineitem")
    relations = l.select(F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("l_partkey") % 10).cast("string")).alias("dst"), F.col("l_returnflag").alias("rel_type"), F.col("l_quantity").alias("weight"))
    names = relations.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    canonical = names.withColumn("canonical", F.concat(F.lit("k"), (F.substring("name", 2, 9).cast("int") % 4).cast("string")))
    return graph.rolled_edges(relations, canonical)


@query(
    "entity_resolution",
    r"""WITH RECURSIVE n AS (SELECT lower(p_name) AS name, count(*) AS mentions FROM part WHERE p_name IS NOT NULL GROUP BY 1),
g AS (SELECT name, list_distinct(list_transform(range(1, greatest(length(name), 2)), lambda i: substr(name, i, 2))) AS pairs FROM n),
b AS (SELECT DISTINCT name, unnest(list_concat([substr(name, 1, 3)], list_filter(string_split_regex(name, '\W+'), lambda w: length(w) > 3))) AS block FROM n),
met AS (SELECT DISTINCT x.name AS a, y.name AS b FROM b x JOIN b y ON x.block = y.block AND x.name < y.name),
alike AS (SELECT a, b FROM met JOIN g ga ON ga.name = a JOIN g gb ON gb.name = b
  WHERE 1 - round(0.3 * (1 - levenshtein(a, b) / greatest(length(a), length(b)))
    + 0.7 * len(list_intersect(ga.pairs, gb.pairs)) / len(list_distinct(list_concat(ga.pairs, gb.pairs))), 6) <= 0.4),
u AS (SELECT a AS src, b AS dst FROM alike UNION ALL SELECT b, a FROM alike),
w AS (SELECT name AS node, name AS root FROM n UNION SELECT u.dst, w.root FROM w JOIN u ON u.src = w.node),
c AS (SELECT node AS name, min(root) AS component FROM w GROUP BY 1)
SELECT name, first_value(name) OVER (PARTITION BY component ORDER BY mentions DESC, name) AS canonical FROM c JOIN n USING (name)""",
)
def entity_resolution(spark, d):
    names = T.table(spark, d, "part").select(F.lower("p_name").alias("name"), F.lit(1).alias("mentions"))
    return graph.resolve(names, graph.similar_names(names.select("name").distinct(), most=0.4))


@query("endpoint_templates", r"SELECT regexp_replace(regexp_replace(regexp_replace(url, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f-]+', '{id}', 'g'), '/[0-9]+(/|$|[?#])', '/{n}\1', 'g'), '=[^&#]*', '={v}', 'g') AS template, count(*) AS n_pages FROM pages GROUP BY 1")
def endpoint_templates(spark, d):
    return T.table(spark, d, "pages").groupBy(scalars.endpoint_template(F.col("url")).alias("template")).agg(F.count(F.lit(1)).alias("n_pages"))


@query("context_sizing", f"WITH {_EV} SELECT model_id, count(*) AS n, quantile_cont(output_tokens, 0.5) AS p50, quantile_cont(output_tokens, 0.9) AS p90, quantile_cont(output_tokens, 0.99) AS p99, round(avg(CASE WHEN output_tokens <= 500 THEN 1.0 ELSE 0.0 END) * 100, 2) AS fits_500, round(avg(CASE WHEN output_tokens <= 2000 THEN 1.0 ELSE 0.0 END) * 100, 2) AS fits_2000 FROM ev GROUP BY 1")
def context_sizing(spark, d):
    return sinks.fitting_share(T.session_events(spark, d), "model_id", "output_tokens", [500, 2000])


@query("session_models", f"WITH {_EV} SELECT session_id, model_id FROM ev WHERE call_type = 'skill' UNION SELECT session_id, model_id FROM ev WHERE msg_kind = 'assistant_text'")
def session_models(spark, d):
    e = T.session_events(spark, d)
    return e.where("msg_kind = 'human'").select("session_id", "model_id").unionByName(e.where("msg_kind = 'assistant_text'").select("session_id", "model_id")).distinct()


@query("scope_excerpts", f"""WITH {_EV}, {_SCOPES}, c AS (SELECT scope, strftime(date_trunc('week', ev.ts), '%Y-%m-%d') AS bucket, ev.ts, events.props AS text FROM ev JOIN events ON event_id = event_key JOIN up USING (project_id) WHERE msg_kind = 'human')
SELECT scope, bucket, text, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scope, bucket ORDER BY ts DESC, length(text) DESC, text DESC) AS rank FROM c) WHERE rank <= 20""")
def scope_excerpts(spark, d):
    """The properties of the views as what people said, by scope and week."""
    said = T.session_events(spark, d).join(T.table(spark, d, "events").select(F.col("event_id").alias("event_key"), F.col("props").alias("message_content")), "event_key")
    return claims.excerpts(claims.excerpt_candidates(said, T.project_scopes(spark, d), "week")).select("scope", "bucket", "text", "rank")


@query("scopes_touched", f"WITH {_EV}, {_SCOPES} SELECT DISTINCT project_id FROM up WHERE scope IN ('clients/g0', 'play')")
def scopes_touched(spark, d):
    chain = T.project_scopes(spark, d).withColumn("chain", scalars.ancestors(F.col("scope")))
    return chain.where(F.arrays_overlap("chain", F.array(F.lit("clients/g0"), F.lit("play")))).select("project_id").distinct()


@query("session_totals", f"WITH {_EV} SELECT project_id, count(*) FILTER (WHERE NOT is_sidechain) AS n_main, count(*) FILTER (WHERE is_sidechain) AS n_side, count(DISTINCT agent_id) AS n_agents, count(DISTINCT session_id) AS n_sessions, {_UNITS} / 1e8 AS cost_usd, round(sum(output_tokens) * 1.0 / count(DISTINCT session_id), 4) AS tokens_per_session FROM ev GROUP BY 1")
def session_totals(spark, d):
    e = T.session_events(spark, d)
    side = F.col("is_sidechain")
    grouped = e.groupBy("project_id").agg(F.count_if(~side).alias("n_main"), F.count_if(side).alias("n_side"), F.countDistinct("agent_id").alias("n_agents"), F.countDistinct("session_id").alias("n_sessions"), usage.money().alias("cost_usd"), F.sum("output_tokens").alias("tokens"))
    return grouped.withColumn("tokens_per_session", F.round(F.col("tokens") / F.col("n_sessions"), 4)).drop("tokens")


#: Spending on each day of the week, less its mean: whose orders fall on the same days.
_WEEKDAYS = """w AS (SELECT o_custkey, dayofweek(o_orderdate) AS d, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS s FROM orders GROUP BY 1, 2),
x AS (SELECT o_custkey, list_transform(range(7), lambda k: coalesce(list_sum(list_filter(l, lambda p: p.d = k).list_transform(lambda p: p.s)), 0)) AS v FROM (SELECT o_custkey, list({'d': d, 's': s}) AS l FROM w GROUP BY 1)),
y AS (SELECT o_custkey, list_transform(v, lambda e: CAST(7 * e - list_sum(v) AS DOUBLE)) AS v FROM x)"""


def _weekday_vectors(spark, d):
    o = T.table(spark, d, "orders").groupBy("o_custkey").agg(*(F.coalesce(F.sum(F.when(F.dayofweek("o_orderdate") == k + 1, F.round("o_totalprice").cast("long"))), F.lit(0)).alias(f"d{k}") for k in range(7)))
    total = sum((F.col(f"d{k}") for k in range(7)), F.lit(0))
    return o.select("o_custkey", F.array(*((7 * F.col(f"d{k}") - total).cast("double") for k in range(7))).alias("v"))


@query("vector_neighbours", f"""WITH {_WEEKDAYS}, z AS (SELECT * FROM y WHERE list_max(v) > 0),
p AS (SELECT a.o_custkey AS a, b.o_custkey AS b, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance FROM z a JOIN z b ON a.o_custkey <> b.o_custkey)
SELECT a, b, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM p WHERE distance <= 0.05) WHERE rank <= 10""")
def vector_neighbours(spark, d):
    """So many tables that a pair is missed with a probability of 1e-9: as good as exact."""
    return neighbours.vector_neighbours(_weekday_vectors(spark, d), "o_custkey", "v", most=0.05, miss=1e-9)


@query("allowed_canonicals", f"""WITH {_EV}, k AS (SELECT call_name AS name, CASE WHEN CAST(substr(call_name, 2) AS INTEGER) < 15 THEN 'n' || (CAST(substr(call_name, 2) AS INTEGER) % 4) END AS canonical FROM ev)
SELECT DISTINCT coalesce(canonical, name) AS node FROM ev JOIN (SELECT DISTINCT * FROM k) ON name = call_name WHERE project_id = 'p3' AND ts >= TIMESTAMP '2024-01-26 12:00:00'""")
def allowed_canonicals(spark, d):
    """What the calls of two days of one project name, by canonical names; the names from n15 on were never resolved."""
    made = T.session_calls(spark, d)
    number = F.substring("call_name", 2, 9).cast("int")
    canonical = made.where(number < 15).select(F.col("call_name").alias("name"), F.concat(F.lit("n"), (number % 4).cast("string")).alias("canonical")).distinct()
    chunks = made.select(F.col("event_key").alias("chunk_key"), "event_key")
    mentions = made.select(F.col("event_key").alias("chunk_key"), F.col("call_name").alias("name"))
    return graph.allowed_canonicals(made, chunks, mentions, canonical, of_project("p3", F.col("project_id")) & since(2, F.col("ts"), NOW))


@query("dominant_types", f"WITH {_EV}, c AS (SELECT call_name AS name, call_type AS type, count(*) AS n FROM ev GROUP BY 1, 2) SELECT name, type, mentions FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY name) AS BIGINT) AS mentions, row_number() OVER (PARTITION BY name ORDER BY n DESC, type) AS rn FROM c) WHERE rn = 1")
def dominant_types(spark, d):
    return kg_payload.dominant_types(T.session_calls(spark, d).select(F.col("call_name").alias("name"), F.col("call_type").alias("type")))


@query("scope_summaries")
def scope_summaries(spark, d):
    made = claims.summarise(claims.session_texts(_conversation_events(spark, d)), claims.lead_engine, "lead")
    scopes = T.project_scopes(spark, d)
    rows = made.join(F.broadcast(scopes), "project_id").select("session_id", "content_hash", "scope", F.lit("all").alias("bucket"), "summary")
    return summaries.roll_up(rows, "strict", claims.lead_engine).select("scope", "bucket", "child_count", "source_hash")


def _brief(text: str) -> str:
    """A second stand-in for a summary model: the first words."""
    return " ".join(text.split(None, 40)[:40])


@query("evaluation_grid")
def evaluation_grid(spark, d):
    """Two models by three strategies by two grains over all conversations, scored up to the projects' groups, ranked."""
    events = _conversation_events(spark, d).withColumn("ts", F.timestamp_seconds(F.col("session_id").cast("long") % 60 * 86400 + F.unix_seconds("ts")))
    # a scope for each hundred conversations, which bounds the texts below one
    hundreds = F.concat(F.lit("c"), F.floor(F.col("session_id").cast("long") / 100).cast("string"))
    events = events.withColumn("project_id", hundreds)
    scopes = events.select("project_id").distinct().withColumn("scope", F.concat_ws("/", F.lit("talk"), "project_id"))
    target = scratch_path(spark, "grid")
    models = {"lead": grid.Model(2, claims.lead_engine), "brief": grid.Model(1, _brief)}
    grid.run_grid(events, scopes, target, models, grains=("week", "month"), least_depth=2)
    return grid.ranked(spark, target).select("permutation_id", "status", "n_failed", "rollup_rows", "n_sessions_scored", "n_rollups_scored", "source_sessions", "source_tokens", F.round("combined", 6).alias("combined"))


def _conversation_events(spark, d):
    c = T.table(spark, d, "conversations")
    return c.select(F.concat(F.lit("p"), (F.col("conv_id") % 10).cast("string")).alias("project_id"), F.col("conv_id").cast("string").alias("session_id"), F.timestamp_seconds("turn").alias("ts"), F.col("turn").alias("event_key"), F.when(F.col("role") == "user", "human").otherwise("other").alias("msg_kind"), F.col("text").alias("message_content"))


@query("graph_selection")
def graph_selection(spark, d):
    return kg_payload.selection(_graph(spark, d), top=10, max_depth=1, min_degree=3).select("node", "degree", F.round("node_betweenness", 4).alias("node_betweenness"), F.round("edge_betweenness", 4).alias("edge_betweenness"))


def _mentions_sql() -> str:
    found = " UNION ALL ".join(f"SELECT unnest(regexp_extract_all(chunk, '{p}')) AS name, '{kind}' AS type FROM pieces" for kind, p in kg_payload.ENTITY_PATTERNS.items())
    hidden = ", ".join(f"'{n}'" for n in kg_payload.FORBIDDEN)
    return f"""WITH pieces AS (SELECT url AS chunk FROM pages UNION ALL SELECT html FROM pages), m AS ({found}),
c AS (SELECT name, type, count(*) AS n FROM m WHERE name NOT IN ({hidden}) GROUP BY 1, 2)
SELECT name, type, mentions FROM (
  SELECT name, type, CAST(sum(n) OVER (PARTITION BY name) AS BIGINT) AS mentions, row_number() OVER (PARTITION BY name ORDER BY n DESC, type) AS rn FROM c)
WHERE rn = 1"""


@query("entity_mentions", _mentions_sql())
def entity_mentions(spark, d):
    pages = T.table(spark, d, "pages")
    pieces = pages.select(F.col("page_id").alias("chunk_id"), F.col("url").alias("chunk")).unionByName(pages.select(F.col("page_id").alias("chunk_id"), F.col("html").alias("chunk")))
    return kg_payload.dominant_types(kg_payload.entities(pieces, most=1 << 30))


def _staged_sql() -> str:
    found = " UNION ALL ".join(f"SELECT unnest(regexp_extract_all(substr(text, 1, 1500), '{p}')) AS name FROM t" for p in kg_payload.ENTITY_PATTERNS.values())
    hidden = ", ".join(f"'{n}'" for n in kg_payload.FORBIDDEN)
    return f"""WITH t AS (SELECT url AS text FROM pages WHERE trim(url) <> '' UNION ALL SELECT text FROM conversations WHERE trim(text) <> ''),
m AS (SELECT name FROM ({found}) WHERE name NOT IN ({hidden})), n AS (SELECT count(*) AS n FROM t), d AS (SELECT count(DISTINCT name) AS n FROM m)
SELECT 'chunk' AS stage, n AS n_eligible, n AS n_done, n AS n_rows FROM n UNION ALL SELECT 'vector', n, n, n FROM n
UNION ALL SELECT 'entity', n, n, (SELECT count(*) FROM m) FROM n UNION ALL SELECT 'name', n, n, n FROM d"""


@query("staged_progress", _staged_sql())
def staged_progress(spark, d):
    """Addresses of pages and turns of conversations, which come in one after the other, through all four stages."""
    pages = T.table(spark, d, "pages").select(F.xxhash64(F.lit("page"), "page_id").alias("event_key"), F.col("url").alias("text"))
    turns = T.table(spark, d, "conversations").select(F.xxhash64(F.lit("turn"), "conv_id", "turn").alias("event_key"), "text")
    there = [pages]
    store = stages.Store(spark, scratch_path(spark, "stages"), stages.text_stages(lambda: there[-1]))
    store.drain()
    there.append(pages.unionByName(turns))
    store.drain()
    rows = None
    for stage, output in (("chunk", "chunks"), ("vector", "vectors"), ("entity", "entities"), ("name", "name_vectors")):
        one = store.current(stage, output).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(stage).alias("stage"), "n_rows")
        rows = one if rows is None else rows.unionByName(one)
    return store.progress().join(rows, "stage")


#: Keys of the copies of events in a mirrored folder come after those of the first.
_MIRROR = 10_000_000_000


def _copied_lake(spark, d) -> dict[str, DataFrame]:
    """The events, their edges, files and chunks, a third of them read again from a mirror; every eleventh event has no uuid."""
    uuid = lambda key: F.when(F.col(key) % 11 != 0, F.concat(F.lit("u"), F.col(key).cast("string")))
    first = T.session_events(spark, d).withColumn("event_uuid", uuid("event_key")).withColumn("source_file", F.concat_ws("/", "project_id", "session_id"))
    again = first.where("user_id % 3 = 0").withColumn("event_key", F.col("event_key") + _MIRROR).withColumn("source_file", F.concat(F.lit("mirror/"), F.col("source_file")))
    links = T.event_links(spark, d)
    edge = first.join(links.select(F.col("child").alias("event_key"), "parent"), "event_key")
    edges = edge.select(F.col("event_key").alias("edge_key"), "project_id", "session_id", "event_uuid", uuid("parent").alias("parent_uuid"), "source_file", "user_id")
    copied = edges.where("user_id % 3 = 0").withColumn("edge_key", F.col("edge_key") + _MIRROR).withColumn("source_file", F.concat(F.lit("mirror/"), F.col("source_file")))
    events = first.unionByName(again)
    chunks = events.where("msg_kind = 'human'").select(F.col("event_key").alias("chunk_key"), "event_key")
    return {"events": events, "chunks": chunks, "edges": edges.unionByName(copied).drop("user_id"), "files": events.select("source_file").distinct(), "chunk_logs": chunks.select("chunk_key")}


@query("dedupe_migration", f"""WITH {_EV}, e AS (SELECT *, event_key % 11 <> 0 AS named, user_id % 3 = 0 AS twice FROM ev),
l AS (SELECT project_id, session_id, twice, CASE WHEN event_key % 11 <> 0 THEN event_key END AS u, CASE WHEN (event_key - event_key % 16 + (event_key % 16 - 1) // 2) % 11 <> 0 THEN event_key - event_key % 16 + (event_key % 16 - 1) // 2 END AS p
  FROM e WHERE event_key % 16 > 0 AND event_key - event_key % 16 + (event_key % 16 - 1) // 2 IS NOT NULL)
SELECT 'events' AS "table", count(*) + count(*) FILTER (twice) AS rows_before, count(*) FILTER (twice AND named) AS rows_deleted FROM e
UNION ALL SELECT 'cube events', count(*) + count(*) FILTER (twice), count(*) FILTER (twice AND named) FROM e
UNION ALL SELECT t, count(*) + count(*) FILTER (twice), count(*) FILTER (twice AND named) FROM e, (VALUES ('chunks'), ('chunk_logs')) v(t) WHERE msg_kind = 'human' GROUP BY 1
UNION ALL SELECT 'edges', count(*) + count(*) FILTER (twice), count(*) + count(*) FILTER (twice) - (SELECT count(*) FROM (SELECT DISTINCT project_id, session_id, u, p FROM l)) FROM l
UNION ALL SELECT 'files', count(DISTINCT session_id) + count(DISTINCT session_id) FILTER (twice), count(DISTINCT session_id) FILTER (twice) - count(DISTINCT session_id) FILTER (twice AND NOT named) FROM e""")
def dedupe_migration(spark, d):
    """A lake with copies is pruned once; what the cube counts before and after shows that the roll-ups follow."""
    root = scratch_path(spark, "lake")
    tables = _copied_lake(spark, d)
    migrations.save(tables, root)
    counts = migrations.drop_repeats(spark, root, list(tables)).where(~F.col("table").isin("cube", "sessions"))
    in_cube = lambda cube: cube.where("granularity = 'month'").agg(F.coalesce(F.sum("n_events"), F.lit(0)).cast("long").alias("n"))
    before, after = in_cube(usage.cube(spark.read.parquet(f"{root}/{migrations.BASE}/events"))), in_cube(migrations.present(spark, root, "cube"))
    # one row each
    cube = before.withColumnRenamed("n", "rows_before").join(F.broadcast(after), how="cross").select(F.lit("cube events").alias("table"), "rows_before", (F.col("rows_before") - F.col("n")).alias("rows_deleted"))
    return counts.unionByName(cube)


@query(
    "claim_buckets",
    f"""WITH {_ROLLUP}
SELECT bucket, count(*) AS n_claims, CAST(sum(n_sessions) AS BIGINT) AS total FROM ru WHERE scope = 'clients' GROUP BY 1""",
)
def claim_buckets(spark, d):
    return readers.claim_buckets(_rollup(spark, d), "clients")


@query(
    "scope_children",
    f"""WITH {_SCOPES}
SELECT DISTINCT scope, CAST(2 AS INTEGER) AS depth FROM up WHERE scope LIKE 'clients/%' AND scope NOT LIKE 'clients/%/%'""",
)
def scope_children(spark, d):
    return readers.scope_children(T.project_scopes(spark, d), "clients")


@query(
    "session_claims",
    f"""WITH {_EV},
one AS (SELECT min(session_id) AS session_id FROM ev),
tags AS (SELECT DISTINCT call_type AS lens, call_name, CAST(substr(call_name, 2) AS INTEGER) // 4 AS cluster_id FROM ev WHERE call_type <> 'rule')
SELECT ev.call_type AS lens, ' Uses  ' || upper(ev.call_name) AS claim, CAST(cluster_id AS INTEGER) AS cluster_id,
  CASE WHEN cluster_id < 3 THEN 'group ' || CAST(cluster_id AS VARCHAR) END AS cluster_name
FROM ev JOIN one ON ev.session_id = one.session_id LEFT JOIN tags ON ev.call_type = tags.lens AND ev.call_name = tags.call_name""",
)
def session_claims(spark, d):
    found = T.session_claims(spark, d)
    one = found.orderBy("session_id").select("project_id", "session_id").first()
    calls_ = T.session_calls(spark, d).where("call_type <> 'rule'")
    tags = calls_.select(F.col("call_type").alias("lens"), F.concat(F.lit("uses "), "call_name").alias("claim"), F.floor(F.substring("call_name", 2, 9).cast("int") / 4).cast("int").alias("cluster_id")).distinct()
    names = tags.select("lens", "cluster_id", F.concat(F.lit("group "), F.col("cluster_id").cast("string")).alias("name")).distinct().where("cluster_id < 3")
    return readers.session_claims(found, tags, names, one.project_id, one.session_id)


@query("claim_taxonomy")
def claim_taxonomy(spark, d):
    return claim_clusters.cluster_claims(T.session_claims(spark, d)).clusters


@query(
    "pipeline_stages",
    f"""WITH {_EV},
h AS (SELECT text FROM conversations WHERE role = 'user' AND text <> ''),
names AS (SELECT count(DISTINCT call_name) AS n, count(DISTINCT call_name) FILTER (WHERE call_type = 'tool') AS embedded,
  count(DISTINCT call_name) FILTER (WHERE call_type = 'cli') AS resolved FROM ev),
s AS (
  SELECT 0 AS nth, 'ingest' AS stage, (SELECT count(*) FROM documents) AS eligible, (SELECT count(*) FROM labels) AS d
  UNION ALL SELECT 1, 'chunk', (SELECT count(*) FROM h), (SELECT count(*) FROM h WHERE length(text) >= 40)
  UNION ALL SELECT 2, 'embed', (SELECT count(*) FROM h WHERE length(text) >= 40), (SELECT count(*) FROM h WHERE length(text) >= 60)
  UNION ALL SELECT 3, 'ner', (SELECT count(*) FROM h WHERE length(text) >= 40), (SELECT count(*) FROM h WHERE length(text) >= 80)
  UNION ALL SELECT 4, 're', (SELECT count(*) FROM h WHERE length(text) >= 40), (SELECT count(*) FROM h)
  UNION ALL SELECT 5, 'entity_embed', n, embedded FROM names
  UNION ALL SELECT 6, 'resolve', embedded, resolved FROM names
  UNION ALL SELECT 7, 'communities', (SELECT count(DISTINCT vec_id) FROM embeddings), (SELECT count(DISTINCT vec_id) FROM embeddings)
  UNION ALL SELECT 8, 'naming', (SELECT count(DISTINCT label) FROM embeddings), (SELECT count(DISTINCT label) FROM embeddings WHERE label > 1)),
c AS (SELECT nth, stage, eligible, least(d, eligible) AS done FROM s)
SELECT CAST(nth AS INTEGER) AS nth, stage, eligible, done, eligible - done AS pending,
  CASE WHEN eligible > 0 THEN round(done * 100.0 / eligible, 1) ELSE 0.0 END AS pct FROM c""",
)
def pipeline_stages(spark, d):
    events = T.table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("event_id"), F.when(F.col("role") == "user", "human").otherwise("other").alias("msg_kind"), F.col("text").alias("message_content")
    )
    human = events.where("msg_kind = 'human' AND message_content <> ''")
    longer = lambda n: human.where(F.length("message_content") >= n).select("event_id")
    names = lambda *kinds: T.session_calls(spark, d).where(F.col("call_type").isin(*kinds)).select(F.col("call_name").alias("name"))
    vectors = T.table(spark, d, "embeddings")
    groups = lambda r, by: vectors.select(F.lit(r).alias("resolution"), F.col("vec_id").alias("node"), F.floor(F.col("label") / by).alias("community"))
    tables = {
        "files": T.table(spark, d, "documents"), "source_files": T.table(spark, d, "labels"), "events": events, "chunks": longer(40), "vectors": longer(60), "ner_log": longer(80), "re_log": longer(0),
        "entities": names(*CALL_TYPES), "entity_vectors": names("tool").distinct(), "entity_clusters": names("cli").distinct(), "communities": groups(0.25, 2).unionByName(groups(1.0, 1)),
        "labels": vectors.where("label > 1").select(F.lit(1.0).alias("resolution"), "label").distinct(),
    }
    return readers.pipeline_stages(tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
