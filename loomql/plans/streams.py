"""Event-time operators on the events table, as batch plans and as streams run to completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.plans.registry import Registry, Tables
from loomql.streaming import events as ev

R = Registry()


@R.query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(t: Tables) -> DataFrame:
    return ev.tumbling(t("events"), "1 hour")


@R.query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1")
def sliding_window(t: Tables) -> DataFrame:
    return ev.sliding(t("events"), "2 hours", "1 hour")


@R.query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def session_windows(t: Tables) -> DataFrame:
    return ev.sessions(t("events"), "30 minutes")


@R.query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_window(t: Tables) -> DataFrame:
    return ev.run_to_completion(t.spark, t.sf_dir, lambda s: ev.tumbling(s, "1 hour"), "complete")


@R.query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(t: Tables) -> DataFrame:
    return ev.run_to_completion(t.spark, t.sf_dir, lambda s: s.select("user_id", "event_type").dropDuplicates(), "append")


@R.query("SELECT event_id, n_name FROM events JOIN nation ON n_nationkey = user_id % 25 WHERE event_type = 'error'")
def stream_static_join(t: Tables) -> DataFrame:
    n = t("nation")
    return ev.run_to_completion(t.spark, t.sf_dir, lambda s: s.where("event_type = 'error'").join(n, F.col("user_id") % 25 == n.n_nationkey).select("event_id", "n_name"), "append")


@R.query("SELECT user_id, max_by(event_type, event_id) AS last_type, max(event_id) AS last_id FROM events GROUP BY 1")
def change_stream_apply(t: Tables) -> DataFrame:
    return ev.apply_changes(t.spark, t.sf_dir)
