"""Streaming queries, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.plans.base import query
from pairloom.streaming import incremental as inc


def _events(spark, d):
    return inc.stream_table(spark, f"{d}/events.parquet")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    return inc.available_now(inc.first_seen(_events(spark, d).select("user_id", "event_type"), ["user_id", "event_type"]), "first-seen")


@query("SELECT user_id, min((value, event_id))[1] AS value, min((value, event_id))[2] AS event_id FROM events WHERE value IS NOT NULL GROUP BY 1")
def stream_best_so_far(spark, d):
    updates = inc.available_now(inc.best_so_far(_events(spark, d), "user_id", "value", ["event_id"]), "best", mode="update")
    return inc.latest_update(updates, ["user_id"])


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    updates = inc.available_now(inc.windowed_counts(_events(spark, d), "ts", ["event_type"], "1 day", "2 days"), "windows", mode="update")
    return inc.latest_update(updates, ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH f AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY event_id) AS k FROM f WHERE bad) SELECT user_id, event_id AS at, 2 AS run FROM r WHERE k = 2""")
def stream_failures(spark, d):
    e = _events(spark, d).withColumn("bad", F.col("event_type") == "error")
    return inc.available_now(inc.failures(e, "user_id", "event_id", "bad", 2), "failures")


@query("""WITH l AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY event_id) AS k FROM g)
SELECT user_id, event_type AS value, event_id AS at FROM r WHERE k = 2""")
def stream_settled(spark, d):
    return inc.available_now(inc.settled(_events(spark, d), "user_id", "event_id", "event_type", 2), "settled")


@query("SELECT user_id, list(event_id ORDER BY event_id)[-5:] AS items FROM events GROUP BY 1")
def stream_queue(spark, d):
    updates = inc.available_now(inc.queue(_events(spark, d), "user_id", "event_id", "event_id", 5), "queue", mode="update")
    return inc.latest_update(updates, ["user_id"])


@query("SELECT event_id, user_id FROM events WHERE event_type = 'signup'")
def stream_resume(spark, d):
    """Two runs over one checkpoint: the second finds nothing new and adds nothing."""
    from pairloom.session import scratch_path

    checkpoint, out = scratch_path(spark, "resume-checkpoint"), scratch_path(spark, "resume")
    for _ in range(2):
        s = _events(spark, d).where("event_type = 'signup'").select("event_id", "user_id")
        found = inc.available_now(s, "resume", checkpoint=checkpoint, out=out)
    return found
