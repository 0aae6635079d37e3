"""Queries on the event stream, run over all its rows at once with the operators of the streaming jobs."""

from __future__ import annotations

from ..runtime import table as t
from ..streaming import jobs
from .registry import query

_DAY = """SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL"""


@query(_DAY)
def stream_tumbling(spark, d):
    """Events per day and type."""
    return jobs.windowed_counts(t(spark, d, "events"), "ts", ["event_type"], "1 day")


@query("""SELECT date_trunc('hour', ts) - i * INTERVAL 1 HOUR AS window_start, date_trunc('hour', ts) + (2 - i) * INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n
FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY ALL""")
def stream_sliding(spark, d):
    """Events in two hours, every hour."""
    return jobs.windowed_counts(t(spark, d, "events"), "ts", ["event_type"], "2 hours", "1 hour")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    """Sessions of each user with gaps below six hours."""
    return jobs.session_counts(t(spark, d, "events"), "ts", ["user_id"], "6 hours")
