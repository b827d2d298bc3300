"""The leased queue, replayed from the event ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.streaming import queue

from .search import table


def actions(spark: SparkSession, d: str) -> DataFrame:
    """Events as actions on 50 jobs per user: each job is enqueued and leased again and again, and sometimes ends."""
    kind = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("lease")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select((F.col("user_id") % 500).alias("job_id"), F.col("event_id").alias("seq"), kind.alias("action"), F.lit("lease").alias("lease_id"), at.alias("at"))


def lease_replay(spark: SparkSession, d: str) -> DataFrame:
    return queue.replayed(actions(spark, d))


QUERIES = {"lease_replay": lease_replay}
ORACLE_SQL: dict[str, str] = {}
