"""Queries of memory: search over ledgers, compaction, the session before, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators import memory as M
from siltstone.session import expire, shared_dir
from siltstone.sources.versions import Versions

from .ledgers import LIVE, NOW, decisions
from .search import BM25, indexed, table


LEDGERS = ["decisions", "lessons", "sessions", "notes"]


def memory_search(spark: SparkSession, d: str) -> DataFrame:
    """What lives in four ledgers, by confidence, relevance to each item and recency; relevance is BM25 over its sum with one."""
    all_ = decisions(spark, d)
    ledger = M.union_of([all_.where(F.pmod("id", F.lit(4)) == i).withColumn("ledger", F.lit(name)) for i, name in enumerate(LEDGERS)])
    live = M.live(ledger, F.lit(NOW).cast("timestamp")).select(F.col("id").alias("doc"), "ledger").distinct()
    prior = M.recall_score(F.lit(0.5) + (F.col("doc") % 10) / 20, F.lit(1.0), F.pmod("doc", F.lit(90)))
    priors = live.select("doc", prior.alias("prior"))
    found = M.recalled(indexed(spark, d), priors, table(spark, d, "benchmark"))
    return found.join(live, "doc").select("item_id", F.col("doc").alias("doc_id"), "ledger", "recall", "rank")


def forget_version(spark: SparkSession, d: str) -> DataFrame:
    """The current version of a ledger in eight parts, once toxic documents are forgotten: rows that stand and tombstones, by part."""
    store = Versions(spark, expire(f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", F.pmod("doc_id", F.lit(8)).cast("string").alias("part"))
    store.commit(store.version(), store.stage(ledger=rows), ["ledger"])
    version, _ = M.forget(store, "ledger", "id long, n_chars long", table(spark, d, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("id")))
    stands = store.read("ledger", version, "id long, n_chars long, part string").groupBy("part").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    gone = store.read("tombstones", version, "id long, tombstone_id string, part string").groupBy("part").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("chars"))
    return stands.unionByName(gone)


def forget_compaction(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return M.compacted(rows, table(spark, d, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("id")))


def resume_prior(spark: SparkSession, d: str) -> DataFrame:
    """The last five events of each user's day before the last."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "ts")
    prior = M.prior_session(e, "user_id", "day", "ts")
    return M.last_of(prior, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "event_id", "rank")


QUERIES = {f.__name__: f for f in (memory_search, forget_compaction, forget_version, resume_prior)}

_REQUEST = "'tomb-' || left(sha256(count(*) || ':' || min(id) || ':' || max(id) || ':' || bit_xor(('0x' || left(md5(id::VARCHAR), 15))::BIGINT)), 16)"

ORACLE_SQL = {
    "memory_search": LIVE.rstrip() + ", " + BM25.strip()[len("WITH ") :] + """, m AS (SELECT item_id, doc_id, round((0.5 + (doc_id % 10) / 20) * (score / (score + 1)) * pow(0.5, (doc_id % 90) / 30.0), 6) AS recall FROM t SEMI JOIN live ON id = doc_id)
SELECT item_id, doc_id, ['decisions', 'lessons', 'sessions', 'notes'][doc_id % 4 + 1] AS ledger, recall, row_number() OVER (PARTITION BY item_id ORDER BY recall DESC, doc_id) AS rank FROM m QUALIFY rank <= 5""",
    "forget_version": f"""
WITH g AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT (doc_id % 8)::VARCHAR AS part, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id NOT IN (SELECT id FROM g) GROUP BY ALL
UNION ALL SELECT {_REQUEST} AS part, count(*) AS n, NULL AS chars FROM g HAVING count(*) > 0""",
    "forget_compaction": """
WITH g AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r AS (SELECT 'tomb-' || left(sha256(count(*) || ':' || min(id) || ':' || max(id) || ':' || bit_xor(('0x' || left(md5(id::VARCHAR), 15))::BIGINT)), 16) AS tombstone_id FROM g)
SELECT doc_id AS id, false AS tombstone, NULL::VARCHAR AS tombstone_id FROM documents WHERE doc_id NOT IN (SELECT id FROM g)
UNION ALL SELECT id, true, tombstone_id FROM g, r""",
    "resume_prior": """
WITH e AS (SELECT user_id, ts::DATE AS day, event_id, ts FROM events),
s AS (SELECT user_id, day, max(ts) AS last, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, day DESC) AS r,
      first_value(max(ts)) OVER (PARTITION BY user_id ORDER BY max(ts) DESC, day DESC) AS now FROM e GROUP BY user_id, day),
p AS (SELECT user_id, day FROM s WHERE r = 2 AND last >= now - INTERVAL 14 DAY)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
FROM e JOIN p USING (user_id, day) QUALIFY rank <= 5""",
}
