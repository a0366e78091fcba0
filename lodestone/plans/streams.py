"""Event queries with their SQL; the frames are batches of the same operators that streams use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import events as S


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tumbling(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


WINDOWS = "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id"""


def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_seen(table(spark, sf_dir, "events"), ["user_id", "event_type"]).groupBy("event_type").agg(F.count("*").alias("users"))


FIRST = "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"
QUERIES = {"event_windows": (event_windows, WINDOWS), "event_sessions": (event_sessions, SESSIONS), "first_events": (first_events, FIRST)}
