"""Windows over event time that read the same on a table and on a stream.

On a stream, `late` sets the watermark: state of windows older than that is dropped, and later events are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import rules
from lintel.sources.tables import load

LATE, HOUR, STEP, GAP = "2 hours", "1 hour", "30 minutes", "10 minutes"


def _marked(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def _start() -> Column:
    """A window's start without a time zone, as in the tables."""
    return F.col("w.start").cast("timestamp_ntz").alias("start")


def tumbling(events: DataFrame, size: str = HOUR, late: str = LATE) -> DataFrame:
    """(start, event_type, n) for windows side by side."""
    found = _marked(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(_start(), "event_type", "n")


def sliding(events: DataFrame, size: str = HOUR, step: str = STEP, late: str = LATE) -> DataFrame:
    """(start, n) for windows that overlap."""
    found = _marked(events, late).groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"))
    return found.select(_start(), "n")


def sessions(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """(user_id, start, n) for runs of a user's events that are no further apart than `gap`."""
    found = _marked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", _start(), "n")


def append_findings(statements: DataFrame, folder: str, checkpoint: str):
    """A stream of statements (query_id, text) judged by all content rules and appended to `folder`; the started query."""
    return rules.findings(statements).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(load(spark, sf_dir, "events"))


def ext_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding(load(spark, sf_dir, "events"))


def ext_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(load(spark, sf_dir, "events"))


QUERIES = {f.__name__: f for f in (ext_tumbling, ext_sliding, ext_session)}

ORACLE = {
    "ext_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "ext_sliding": "SELECT time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES AS start, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1",
    "ext_session": """WITH s AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 MINUTES THEN 1 ELSE 0 END AS fresh FROM events),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, run""",
}
