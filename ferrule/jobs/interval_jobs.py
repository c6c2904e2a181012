"""Intervals of a user's events: an event lasts ten minutes for each unit of its value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.jobs.registry import query
from ferrule.operators import intervals
from ferrule.sources.tables import table

_SPANS = "e AS (SELECT event_id, user_id, event_type, epoch(date_trunc('second', ts))::BIGINT AS start, epoch(date_trunc('second', ts))::BIGINT + 600 * floor(value)::BIGINT AS end_ FROM events)"


def spans(spark: SparkSession, folder: str) -> DataFrame:
    start = F.unix_timestamp("ts")
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", start.alias("start"), (start + 600 * F.floor("value").cast("long")).alias("end"))


@query(f"""WITH {_SPANS}, j AS (SELECT p.event_id, s.event_id AS scope, row_number() OVER (PARTITION BY p.event_id ORDER BY s.start DESC NULLS LAST, s.event_id DESC) AS r
  FROM e p LEFT JOIN (SELECT * FROM e WHERE event_type = 'signup') s ON p.user_id = s.user_id AND s.start <= p.start AND p.start <= s.end_ WHERE p.event_type <> 'signup')
SELECT event_id, scope FROM j WHERE r = 1""")
def scope_binding(spark: SparkSession, folder: str) -> DataFrame:
    """Each event with the innermost signup interval of its user that covers its start."""
    found = spans(spark, folder)
    points = found.where("event_type <> 'signup'").select("event_id", "user_id", F.col("start").alias("at"))
    scopes = found.where("event_type = 'signup'").select("user_id", "start", "end", F.col("event_id").alias("ord"))
    return intervals.innermost(points, scopes, ["user_id"], ["event_id"]).select("a.event_id", F.col("b.ord").alias("scope"))


@query(f"""WITH {_SPANS} SELECT a.event_id AS inner_id, b.event_id AS outer_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.start <= a.start AND a.end_ <= b.end_
  AND (b.start < a.start OR a.end_ < b.end_) WHERE a.event_type = 'purchase' AND b.event_type = 'view'""")
def containment_join(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases within views."""
    found = spans(spark, folder)
    pairs = intervals.containing(found.where("event_type = 'purchase'"), found.where("event_type = 'view'"), ["user_id"])
    return pairs.select(F.col("a.event_id").alias("inner_id"), F.col("b.event_id").alias("outer_id"))


@query(f"WITH {_SPANS} SELECT a.event_id, a.user_id FROM e a ANTI JOIN e b ON a.user_id = b.user_id AND b.start <= a.start AND a.end_ <= b.end_ AND (b.start < a.start OR a.end_ < b.end_)")
def outermost_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.outermost(spans(spark, folder), ["user_id"]).select("event_id", "user_id")


@query(f"WITH {_SPANS} SELECT a.event_id AS a_id, b.event_id AS b_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.start <= a.end_ + 60 AND b.end_ >= a.start - 180 WHERE a.event_type = 'error' AND b.event_type = 'click'")
def interval_intersect(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks that meet an error, or come three minutes before it at most or one after."""
    found = spans(spark, folder)
    pairs = intervals.near(found.where("event_type = 'error'"), found.where("event_type = 'click'"), ["user_id"], before=180, after=60)
    return pairs.select(F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"))
