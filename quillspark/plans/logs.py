"""Queries over jobs, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs
from ..streaming import events as stream
from .views import table

_ev = lambda s, d: table(s, d, "events")


def job_table(s, d):
    """Events as jobs: users with a change log, the event number as revision."""
    return _ev(s, d).select((F.col("event_id") % 97).alias("job_id"), F.col("event_id").alias("revision"), F.col("event_type").alias("status"), F.round("value", 2).alias("value"))


QUERIES = {
    "latest_job_state": (lambda s, d: jobs.latest(job_table(s, d), "job_id", "revision"), "SELECT event_id % 97 AS job_id, max(event_id) AS revision, arg_max(event_type, event_id) AS status, round(arg_max(value, event_id), 2) AS value FROM events GROUP BY 1"),
    "next_job": (
        lambda s, d: jobs.next_job(_ev(s, d).select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "click", "queued").otherwise("done").alias("status"), F.lit(False).alias("cancel_requested"), F.col("ts").alias("available_at"), (F.col("event_id") % 4).alias("attempt"), F.lit(3).alias("max_attempts"), F.col("ts").alias("created_at")), F.to_timestamp(F.lit("2024-01-20 00:00:00"))).select("job_id", "status", "attempt"),
        "SELECT event_id AS job_id, 'queued' AS status, event_id % 4 AS attempt FROM events WHERE event_type = 'click' AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND event_id % 4 < 3 ORDER BY ts, event_id LIMIT 1",
    ),
    "retry_delay": (lambda s, d: _ev(s, d).select("event_id", jobs.retry_delay(F.col("event_id") % 9).alias("delay")), "SELECT event_id, CAST(least(60.0, pow(2.0, greatest(0, event_id % 9 - 1))) AS DOUBLE) AS delay FROM events"),
    "retention": (lambda s, d: jobs.retention(_ev(s, d), "ts", F.to_timestamp(F.lit("2024-01-10 00:00:00")))[1], "SELECT count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10 00:00:00') AS removed FROM events"),
    "events_after_cursor": (lambda s, d: jobs.events_after(_ev(s, d), 500).select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE event_id > 500"),
    "state_changes": (
        lambda s, d: jobs.changes(_ev(s, d), "user_id", "event_id", "event_type").select("event_id", "user_id", "event_type", "before"),
        "SELECT event_id, user_id, event_type, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type",
    ),
    "last_n_messages": (
        lambda s, d: jobs.last_messages(table(s, d, "conversations"), 3).select("conv_id", "turn", "role", "place"),
        "SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 3",
    ),
    "jobs_by_status": (lambda s, d: _ev(s, d).filter(F.col("event_type").isin("click", "error")).select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')"),
    "event_windows": (lambda s, d: stream.windowed_counts(_ev(s, d), "1 day").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")), "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"),
    "event_sessions": (
        lambda s, d: stream.sessions(_ev(s, d), "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")),
        "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS m FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(m) AS longest FROM c GROUP BY user_id",
    ),
    "sanitised_payload": (lambda s, d: _ev(s, d).select("event_id", F.to_json(jobs.sanitised(F.create_map(F.lit("Text"), F.lit("x"), F.lit("type"), F.col("event_type")))).alias("payload")), "SELECT event_id, '{\"type\":\"' || event_type || '\"}' AS payload FROM events"),
    "sanitised_events": (
        lambda s, d: _ev(s, d).select("event_id", jobs.sanitised_json(F.to_json(F.struct(F.col("event_type").alias("type"), F.struct(F.col("event_type").alias("Prompt"), F.repeat("event_type", F.lit(60)).alias("long")).alias("inner"), F.array("event_type", F.lit("x")).alias("tags")))).alias("payload")),
        """SELECT event_id, '{"type": "' || event_type || '", "inner": {"long": "' || left(repeat(event_type, 60), 160) || '"}, "tags": 2}' AS payload FROM events""",
    ),
    "request_log": (
        lambda s, d: jobs.request_log(_ev(s, d).select(F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("r"), F.col("event_id"))).alias("request_id"), F.lit("GET").alias("method"), "event_type", F.when(F.col("event_type") != "error", 200).alias("status"), F.col("ts").alias("started"), (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, (event_id % 5000) / 1000.0)")).alias("ended")).withColumnRenamed("event_type", "path")).select("event", "path", "status", "duration_ms", F.when(F.col("request_id").startswith("r"), F.col("request_id")).alias("request_id")),
        "SELECT CASE WHEN event_type = 'error' THEN 'request_failed' ELSE 'request_completed' END AS event, event_type AS path, CASE WHEN event_type <> 'error' THEN 200 END AS status, event_id % 5000 AS duration_ms, CASE WHEN event_id % 3 > 0 THEN 'r' || event_id END AS request_id FROM events",
    ),
}
