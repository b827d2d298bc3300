"""Queries of ingestion, recommendation and retention, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import research as X

from .search import table


def ingest_plan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    failures = docs.where(F.col("doc_id") % 4 == 1).select("sha", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 5 + 1).cast("int")))).select("sha")
    return X.to_ingest(docs, docs.where(F.col("doc_id") % 3 == 0), failures)


def skill_recommendation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat("event_type", F.lit("-"), "props").alias("slug"), F.col("user_id").alias("session"))
    return X.recommended(e, e.where(F.col("session") == 1).select("slug").distinct())


def ttl_retention(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), "ts", (F.col("event_id") % 5 == 0).alias("protected"))
    return X.expired(e, {"click": 7 * 86400, "view": 86400, "error": 14 * 86400}, F.lit("2024-01-20").cast("timestamp")).select("event_id")


def plan_status(spark: SparkSession, d: str) -> DataFrame:
    boxes = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("p_size") % 4).cast("int")), lambda i: F.when(F.pmod(i + F.col("p_partkey"), F.lit(2)) == 0, "- [x] a").otherwise("- [ ] b")), "\n")
    return table(spark, d, "part").select("p_partkey", X.plan_progress(boxes).alias("p")).select("p_partkey", "p.done", "p.open", "p.status")


QUERIES = {f.__name__: f for f in (ingest_plan, skill_recommendation, ttl_retention, plan_status)}

ORACLE_SQL = {
    "ingest_plan": """
WITH d AS (SELECT sha256(text) AS sha, doc_id FROM documents),
g AS (SELECT sha, bool_or(doc_id % 3 = 0) AS known, sum(CASE WHEN doc_id % 4 = 1 THEN doc_id % 5 + 1 ELSE 0 END) AS failed FROM d GROUP BY sha)
SELECT sha, CASE WHEN known THEN 'skip' WHEN failed >= 3 THEN 'quarantine' ELSE 'ingest' END AS action FROM g""",
    "skill_recommendation": """
WITH e AS (SELECT event_type || '-' || props AS slug, user_id FROM events)
SELECT slug, count(*) AS times, count(DISTINCT user_id) AS sessions FROM e WHERE slug NOT IN (SELECT slug FROM e WHERE user_id = 1)
GROUP BY slug HAVING count(*) >= 3 AND count(DISTINCT user_id) >= 2""",
    "ttl_retention": """SELECT event_id FROM events WHERE event_id % 5 <> 0
AND (epoch_us('2024-01-20'::TIMESTAMP) - epoch_us(ts)) / 1e6 > CASE event_type WHEN 'click' THEN 604800 WHEN 'view' THEN 86400 WHEN 'error' THEN 1209600 END""",
    "plan_status": """
WITH b AS (SELECT p_partkey, p_size % 4 + 1 AS n, len(list_filter(range(0, p_size % 4 + 1), lambda i: (i + p_partkey) % 2 = 0)) AS done FROM part)
SELECT p_partkey, done, n - done AS open, CASE WHEN done = n THEN 'done' WHEN done > 0 THEN 'active' ELSE 'open' END AS status FROM b""",
}
