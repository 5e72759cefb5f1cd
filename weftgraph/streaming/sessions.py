"""Build sessions as a stream of state changes: the current state, recovery after a restart, and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a session.
STATES = ("queued", "building", "ready", "failed")
TERMINAL = ("ready", "failed")


def current(changes: DataFrame) -> DataFrame:
    """token, state, since, tries of the latest change of every session; batch, or a stream in update mode."""
    last = F.max_by(F.struct("state", "ts"), F.struct("ts", "state"))
    return changes.groupBy("token").agg(last.alias("x"), F.count_if(F.col("state") == "building").alias("tries")).select("token", "x.state", F.col("x.ts").alias("since"), "tries")


def recovered(sessions: DataFrame) -> DataFrame:
    """After a restart: interrupted builds are queued once more, then fail."""
    state = F.when((F.col("state") == "building") & (F.col("tries") <= 1), "queued").when(F.col("state") == "building", "failed").otherwise(F.col("state"))
    return sessions.withColumn("state", state)


def expired(sessions: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Terminal sessions whose time is over."""
    return sessions.where(F.col("state").isin(*TERMINAL) & (F.col("since") + F.make_dt_interval(secs=F.lit(ttl_seconds)) <= now))
