"""Queries over feedback, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as B
from ..sources import tables
from ..streaming.runs import finished
from .catalog import query
from .sql import statement

AS_OF = "2024-02-15 00:00:00"
_TARGET = "CASE WHEN signal_type IN ('accepted', 'citation_clicked') THEN 'none' WHEN signal_type IN ('no_result', 'rephrased', 'follow_up') THEN 'retrieval' WHEN signal_type = 'flagged_error' THEN 'curriculum' WHEN citation_score < 0.5 THEN 'retrieval' ELSE 'curriculum' END"
_COUNTED = "count(*) AS total, count(*) FILTER (signal_type = 'accepted') AS accepted, count(*) FILTER (signal_type = 'rejected') AS rejected, round(count(*) FILTER (signal_type = 'accepted') / count(*), 6) AS acceptance_rate, round(count(*) FILTER (signal_type = 'rejected') / count(*), 6) AS rejection_rate, count(*) FILTER (signal_type = 'flagged_error') AS flagged, count(*) FILTER (target = 'retrieval') AS to_retrieval, count(*) FILTER (target = 'curriculum') AS to_curriculum"


@query("h1_record_signals", statement("SELECT signal_id, signal_type, ts FROM signals", "signals"))
def record_signals(spark, sf_dir):
    """Every signal, sent twice, is kept once."""
    rows = tables.signals(spark, sf_dir)
    return B.first_of_each(rows.union(rows)).select("signal_id", "signal_type", "ts")


@query("h1_record_signals_stream", statement("SELECT signal_id, signal_type, ts FROM signals", "signals"))
def record_signals_stream(spark, sf_dir):
    """As a stream in files, each id once."""
    return B.recorded(tables.signals(spark, sf_dir, True)).select("signal_id", "signal_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("h2_filter_signals", statement("SELECT signal_id FROM signals WHERE discipline_id = 'd1' AND signal_type = 'rejected' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'", "signals"))
def filter_signals(spark, sf_dir):
    return B.filtered(tables.signals(spark, sf_dir), None, "d1", "rejected", "2024-01-05", "2024-01-25").select("signal_id")


@query("h2_filter_conversation", statement("SELECT signal_id, signal_type FROM signals WHERE conversation_id = 7", "signals"))
def filter_conversation(spark, sf_dir):
    return B.filtered(tables.signals(spark, sf_dir), conversation=7).select("signal_id", "signal_type")


@query("h3_count_by_type", statement("SELECT t AS signal_type, count(signal_id) AS n FROM (SELECT unnest(['accepted', 'rejected', 'rephrased', 'follow_up', 'flagged_error', 'citation_clicked', 'no_result']) AS t) LEFT JOIN signals ON signal_type = t GROUP BY t", "signals"))
def count_by_type(spark, sf_dir):
    counts = tables.signals(spark, sf_dir).groupBy("signal_type").agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([(t,) for t in B.TYPES], "signal_type string")
    return kinds.join(counts, "signal_type", "left").fillna(0, ["n"])


_KEY = "CASE WHEN signal_type = 'rejected' THEN signal_type || '/' || target ELSE signal_type END"
_SAID = lambda n: f"CASE {_KEY} " + " ".join("WHEN '{}' THEN '{}'".format(k, v[n].replace("'", "''")) for k, v in B.REASONS.items()) + " END"
_ROUTED = f"SELECT *, {_SAID(0)} AS reason, {_SAID(1)} AS action FROM (SELECT *, {_TARGET} AS target, CASE WHEN signal_type = 'flagged_error' THEN 'high' WHEN signal_type IN ('rejected', 'no_result', 'rephrased') THEN 'medium' ELSE 'low' END AS priority FROM signals)"
_ROUTE = ["signal_id", "target", "priority", "reason", "action"]


@query("h4_route_signals", statement(f"SELECT {', '.join(_ROUTE)} FROM ({_ROUTED})", "signals"))
def route_signals(spark, sf_dir):
    return B.route(tables.signals(spark, sf_dir)).select(*_ROUTE)


@query("h4_route_signals_stream", statement(f"SELECT {', '.join(_ROUTE)} FROM ({_ROUTED})", "signals"))
def route_signals_stream(spark, sf_dir):
    return finished(B.route(tables.signals(spark, sf_dir, True)).select(*_ROUTE), "routed")


def _repeat(name: str, kinds: tuple):
    listed = ", ".join(f"'{k}'" for k in kinds)

    @query(name, statement(f"SELECT query, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM signals WHERE signal_type IN ({listed}) GROUP BY query HAVING count(*) >= 3", "signals"))
    def plan(spark, sf_dir):
        return B.repeated(tables.signals(spark, sf_dir), kinds)


_repeat("h5_repeated_failures", B.FAILURES)
_repeat("h7_missing_coverage", ("no_result",))


@query("h6_low_acceptance", statement("SELECT coalesce(discipline_id, 'unknown') AS discipline, count(*) AS n, count(DISTINCT query) AS queries FROM signals WHERE signal_type = 'rejected' GROUP BY ALL HAVING count(*) >= 3", "signals"))
def low_acceptance(spark, sf_dir):
    return B.low_acceptance(tables.signals(spark, sf_dir))


@query(
    "h8_patterns",
    statement(
        f""", routed AS ({_ROUTED}), tagged AS (SELECT *, 0 AS place, 'repeated_failure' AS pattern, query AS subject FROM routed WHERE signal_type IN ('no_result', 'rejected', 'flagged_error')
  UNION ALL SELECT *, 1, 'low_acceptance', coalesce(discipline_id, 'unknown') FROM routed WHERE signal_type = 'rejected' UNION ALL SELECT *, 2, 'missing_coverage', query FROM routed WHERE signal_type = 'no_result'),
g AS (SELECT place, pattern, subject, count(*) AS n, count(DISTINCT query) AS queries, array_to_string(list_sort(list_distinct(list(query))), ',') AS "set", min(row(ts, signal_id)) AS seen, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(target, row(ts, signal_id)) AS target,
  arg_min(priority, row(ts, signal_id)) AS priority, arg_min(action, row(ts, signal_id)) AS action FROM tagged GROUP BY place, pattern, subject HAVING count(*) >= 3)
SELECT pattern, subject, n, queries, first_seen, last_seen, target, priority, action FROM (SELECT *, row_number() OVER (PARTITION BY pattern, "set" ORDER BY seen) AS r FROM g) WHERE r = 1""",
        "signals",
    ),
)
def patterns(spark, sf_dir):
    return B.patterns(tables.signals(spark, sf_dir))


@query("h9_dashboard", statement(f"SELECT coalesce(discipline_id, 'unknown') AS discipline, {_COUNTED} FROM ({_ROUTED}) WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS GROUP BY ALL", "signals"))
def dashboard(spark, sf_dir):
    return B.dashboard(tables.signals(spark, sf_dir), AS_OF)


_HOURLY = statement("SELECT date_trunc('hour', ts) AS hour, signal_type, count(*) AS n FROM signals GROUP BY ALL", "signals")


@query("h10_hourly_counts", _HOURLY)
def hourly_counts(spark, sf_dir):
    return B.hourly(tables.signals(spark, sf_dir))


@query("h10_streaming_counts", _HOURLY)
def streaming_counts(spark, sf_dir):
    return finished(B.hourly(tables.signals(spark, sf_dir, True)), "hourly", "complete").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(
    "h11_streaming_dashboard",
    statement(f"SELECT coalesce(discipline_id, 'unknown') AS discipline, {_COUNTED}, date_trunc('day', ts) + to_days(CAST(k AS INTEGER)) AS until FROM ({_ROUTED}), range(1, 31) AS days(k) GROUP BY ALL", "signals"),
)
def streaming_dashboard(spark, sf_dir):
    out = finished(B.sliding(tables.signals(spark, sf_dir, True)), "dashboard", "complete")
    return out.withColumn("until", F.col("until").cast("timestamp_ntz"))


_SESSIONS = statement(
    ", g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM signals WINDOW w AS (PARTITION BY conversation_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY conversation_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)\n"
    "SELECT conversation_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(signal_type))), ',') AS types, min(ts) AS \"first\", max(ts) AS \"last\" FROM s GROUP BY conversation_id, k",
    "signals",
)


@query("h12_session_feedback", _SESSIONS)
def session_feedback(spark, sf_dir):
    return B.sessions(tables.signals(spark, sf_dir))


@query("h12_session_feedback_stream", _SESSIONS)
def session_feedback_stream(spark, sf_dir):
    return finished(B.sessions(tables.signals(spark, sf_dir, True)), "sessions", "complete").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


_TURNS = "e AS (SELECT user_id AS conv_id, event_id % 7 AS turn, event_id, event_type FROM events)"


def _turns(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 7).alias("turn"), "event_id", "event_type")
    return B.turn_feedback(events, tables.table(spark, sf_dir, "conversations"))


@query("h13_turn_feedback", f"WITH {_TURNS} SELECT * FROM e WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = e.conv_id AND c.turn = e.turn)")
def turn_feedback(spark, sf_dir):
    return _turns(spark, sf_dir)[0]


@query("h13_unknown_turns", f"WITH {_TURNS} SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = e.conv_id AND c.turn = e.turn)")
def unknown_turns(spark, sf_dir):
    return _turns(spark, sf_dir)[1]
