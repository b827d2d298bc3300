"""Queries of the reconciliation, memory, operations and research families, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as T
from siltstone.functions.nested import cleaned_rows
from siltstone.functions.schema import packaged, violations
from siltstone.operators import evals as E
from siltstone.operators import memory as M
from siltstone.operators import reconcile as C
from siltstone.sources import readers, sinks

from .search import table

NOW = "2024-02-01 00:00:00"


def manifest_drift(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), "doc_id")
    listed = docs.select(path.alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"))
    there = docs.where(F.col("doc_id") % 11 != 0).select(path.alias("path"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("text")), 256).alias("sha256"), (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size"))
    return C.manifest_status(listed, there)


def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return g.where(F.col("copies") > 1)


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Between different texts: copies are one item of the earliest id."""
    own = E.distinct_texts(table(spark, d, "documents"))
    items = own.select("id", F.pmod("id", F.lit(30)).alias("day"), "text")
    return E.near_pairs(items).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def near_dup_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    """As near_dup_pairs, without a window of days, since documents have no date."""
    own = E.distinct_texts(table(spark, d, "documents"))
    items = own.select("id", F.lit(0).alias("day"), "text")
    return E.near_pairs(items, days=None).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def parity_compare(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    left = n.select("n_nationkey", "n_name", F.col("n_regionkey").alias("region"), F.lit(True).alias("ready"))
    right = n.select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("n_name"), F.col("n_regionkey").alias("region"), F.when(F.col("n_nationkey") % 7 != 0, True).alias("ready"))
    return C.field_mismatches(left, right, "n_nationkey", ["n_name", "region", "ready"])


def orphan_prune_plan(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    path = F.concat(F.lit("commands/"), F.when(F.col("p_partkey") % 4 == 0, "x-").otherwise("own-"), F.col("p_partkey"))
    before = p.where(F.col("p_partkey") % 3 == 0).select(path.alias("path"))
    now = p.where(F.col("p_partkey") % 6 == 0).select(path.alias("path"))
    return C.orphans(before, p.select(path.alias("path")), now, "x-", ["own-1"])


def settings_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 20).alias("command"), F.col("event_id").alias("pos"))
    return C.merged_entries(e.where(F.col("pos") % 2 == 0), e.where(F.col("pos") % 2 == 1), ["event_type", "command"], "pos")


def findings_unnest(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    vulns = F.collect_list(F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("V-"), F.col("l_linenumber"))).otherwise("").alias("id"), F.concat(F.lit("N-"), F.col("l_partkey")).alias("name"), F.array().cast("array<string>").alias("fix_versions"), F.array("l_returnflag").alias("fixes"), F.concat(F.lit(" a\n"), F.col("l_linestatus")).alias("description")))
    deps = li.groupBy("l_orderkey").agg(F.array(F.struct(F.col("l_orderkey").cast("string").alias("name"), F.lit("1.0").alias("version"), vulns.alias("vulns"))).alias("dependencies"))
    return C.findings(deps).withColumn("fix_versions", F.array_join("fix_versions", ","))


def hash_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    body = F.concat_ws("|", F.col("event_id"), "event_type", "props")
    w = Window.partitionBy("user_id").orderBy("event_id")
    prev = F.sha2(F.lag(body).over(w), 256)
    chained = e.select("user_id", "event_id", body.alias("line"), F.when(F.row_number().over(w) > 2, F.when(F.col("event_id") % 97 == 0, F.lit("bad")).otherwise(prev)).alias("prev_sha"))
    s = C.chain_status(chained, "user_id", "event_id", "line", "prev_sha")
    return s.groupBy("user_id").agg(F.count("*").alias("lines"), F.count_if(~F.col("ok")).alias("mismatches"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "labels")
    return l.select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, F.array(F.col("doc_id") + 1)).otherwise(F.array().cast("array<bigint>")).alias("contradicts"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("2024-01-31")).when(F.col("doc_id") % 5 == 1, F.lit("2024-02-01")).when(F.col("doc_id") % 5 == 2, F.lit("2024-01-31T23:30:00-02:00")).alias("expires_at"),
        (F.col("toxic") == 1).alias("tombstone"), F.array(F.concat(F.lit("t"), F.col("doc_id") % 4)).alias("tags"),
    )


LIVE = """
WITH r AS (SELECT doc_id AS id, quality, toxic, CASE doc_id % 5 WHEN 0 THEN '2024-01-31 23:59:59'::TIMESTAMP WHEN 1 THEN '2024-02-01 23:59:59'::TIMESTAMP WHEN 2 THEN '2024-02-01 01:30:00'::TIMESTAMP END AS bound FROM labels),
live AS (SELECT id FROM r WHERE toxic <> 1 AND id NOT IN (SELECT id + 1 FROM r WHERE quality = 0 AND toxic <> 1) AND (bound IS NULL OR bound >= '2024-02-01 00:00:00'::TIMESTAMP))
"""


def live_decisions(spark: SparkSession, d: str) -> DataFrame:
    return M.live(decisions(spark, d), F.lit(NOW).cast("timestamp")).select("id")


def tag_mining(spark: SparkSession, d: str) -> DataFrame:
    return M.live(decisions(spark, d), F.lit(NOW).cast("timestamp")).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = decisions(spark, d).where(~F.col("tombstone"))
    edges = r.select("id", F.explode("contradicts").alias("other"))
    return edges.join(r.select(F.col("id").alias("other")), "other").select("id", "other")


def taint_closure(spark: SparkSession, d: str) -> DataFrame:
    """Orders derive from the order of half their number; the tainted are those of prime customers 7 and 11."""
    o = table(spark, d, "orders")
    edges = o.where(F.col("o_orderkey") > 1).select(F.floor(F.col("o_orderkey") / 2).alias("parent"), F.col("o_orderkey").alias("child"))
    return M.derived_from(edges, o.where(F.col("o_custkey").isin(7, 11)).select(F.col("o_orderkey").alias("node")))


def todo_fold(spark: SparkSession, d: str) -> DataFrame:
    return M.folded(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


def session_resume(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("kind"), F.col("event_id").alias("item"), "ts")
    n = F.when(F.col("kind") == "click", 12).when(F.col("kind") == "view", 10).otherwise(5)
    return M.last_of(e, ["session", "kind"], [F.desc("ts"), F.desc("item")], 12).where(F.col("rank") <= n).select("session", "kind", "item", "rank")


def memory_recall(spark: SparkSession, d: str) -> DataFrame:
    r = M.live(decisions(spark, d), F.lit(NOW).cast("timestamp")).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars"), "id")
    score = M.recall_score(F.lit(0.5) + (F.col("id") % 10) / 20, 1 / (1 + F.log10(F.col("n_chars") + 1)), F.pmod("id", F.lit(90)))
    return r.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


def forget_receipt(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return M.forgotten(rows, table(spark, d, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("id")))[1]


def usage_by_role(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def hook_breakdown(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(F.octet_length("props")).cast("long").alias("bytes"), F.sum(k).alias("k"))


def queue_age(spark: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(x) for x in ("pending", "processing", "dead")]), (F.col("event_id") % 3 + 1).cast("int"))
    return E.queue_ages(table(spark, d, "events").select(F.col("event_id").alias("id"), state.alias("state"), "ts"), F.lit(NOW).cast("timestamp"))


def retention_plan(spark: SparkSession, d: str) -> DataFrame:
    return sinks.beyond_rank(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("doc_id")], 20).select("source", "doc_id")


def byte_cap_rotation(spark: SparkSession, d: str) -> DataFrame:
    return sinks.within_bytes(table(spark, d, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("b")), ["source"], [F.desc("doc_id")], F.col("b"), 20_000).select("source", "doc_id", "running_bytes")


def cooldown_scan(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    ts = F.col("ts").cast("timestamp")
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))
    return table(spark, d, "events").withColumn("g", gap).where(F.col("g") < 3600 * 1_000_000).select("event_id")


def ratchet_best(spark: SparkSession, d: str) -> DataFrame:
    return E.ratchet(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").groupBy("user_id").agg(F.count_if("keep").alias("kept"), F.max("value").alias("best"))


def section_membership(spark: SparkSession, d: str) -> DataFrame:
    lines = readers.numbered_lines(table(spark, d, "documents"), "doc_id", "text")
    s = readers.sections(lines, "doc_id", r"^([A-Z][a-z]+) .*$")
    return s.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_distinct("section").alias("sections"), F.count_if(F.col("section").isNull()).alias("before_any"))


def line_anchors(spark: SparkSession, d: str) -> DataFrame:
    return readers.anchors(readers.numbered_lines(table(spark, d, "documents"), "doc_id", "text")).select("doc_id", "line_no", "anchor")


def host_tier(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "pages").select(T.host_of(F.col("url")).alias("host"))
    tier = F.when(F.col("host").rlike(r"\.com$"), "trusted").when(F.col("host").rlike(r"\.net$"), "known").otherwise("unknown")
    return hosts.groupBy("host", tier.alias("tier")).agg(F.count("*").alias("pages"))


def url_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.fetch_allowed(F.col("url")).alias("allowed"))


def wiki_lint_orphans(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    slug = F.concat(F.lit("/"), F.regexp_extract("url", r"/([0-9]+)", 1))
    links = p.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("slug")).distinct()
    return p.select("page_id", slug.alias("slug")).join(links, "slug", "left_anti").select("page_id")


def schema_conformance(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    doc = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, "news").otherwise("gossip").alias("category"), F.lit("en").alias("language"), (F.col("event_id") % 2 == 0).alias("isSpam"), F.transform(F.sequence(F.lit(1), (F.col("event_id") % 7 + 1).cast("int")), lambda i: i.cast("string")).alias("topics"), F.when(F.col("event_id") % 11 == 0, 1).alias("more")))
    return e.select("event_id", F.array_join(E.classification_errors(doc), ",").alias("errors"))


def _comment(kind: str) -> Column:
    """A JSON reply that breaks rules by its number."""
    n = F.col("event_id")
    level = F.when(n % 5 == 0, F.lit("severe")).otherwise("low").alias("riskLevel")
    said = F.when(n % 7 == 0, F.lit("")).otherwise("fine").alias("comment")
    if kind == "generated_comment":
        reason = F.when(n % 11 != 0, F.repeat(F.lit("r"), F.when(n % 3 == 0, 241).otherwise(240))).alias("reason")
        return F.to_json(F.struct(said, level, reason, (n % 2 == 0).alias("shouldPost"), F.when(n % 17 == 0, "angry").alias("tone")))
    return F.to_json(F.struct(F.lit("p1").alias("postId"), said, level, F.when(n % 2 == 0, F.lit(True)).alias("dryRun"), F.when(n % 3 == 0, 1).alias("zeal"), F.when(n % 4 == 0, 1).alias("care")))


def schema_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong, and where, with each event as one of three kinds of JSON, by schemas read as data."""
    e, n = table(spark, d, "events").select("event_id"), F.col("event_id")
    topics = F.transform(F.sequence(F.lit(1), (n % 7 + 1).cast("int")), lambda i: F.when((i == 3) & (n % 2 == 0), F.lit("")).otherwise("t"))
    label = F.to_json(F.struct(F.when(n % 3 == 0, "news").otherwise("gossip").alias("category"), F.when(n % 4 != 0, "en").alias("language"), F.lit(False).alias("isSpam"), topics.alias("topics")))
    out = None
    for name, text in (("content_classification", label), ("generated_comment", _comment("generated_comment")), ("post_comment", _comment("post_comment"))):
        own = e.select("event_id", F.lit(name).alias("kind"), F.array_join(violations(text, packaged(name)), "; ").alias("errors"))
        out = own if out is None else out.unionByName(own)
    return out


def event_chain(spark: SparkSession, d: str) -> DataFrame:
    """Breaks of one hash chain through all events, some of whose lines have been changed afterwards."""
    e = table(spark, d, "events").select("event_id", F.concat_ws("|", F.col("event_id"), "event_type", "props").alias("line"))
    written = C.chained(e, "event_id", "line")
    changed = written.withColumn("line", F.when(F.col("event_id") % 997 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    return C.whole_chain_status(changed, "event_id", "line", "prev_sha").where(~F.col("ok")).select("event_id")


def nested_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Events as nested rows with secrets and paths at every depth, cleaned."""
    n, secret = F.col("event_id"), F.concat(F.lit("token="), F.md5(F.col("event_id").cast("string")))
    place = F.concat(F.lit("see /home/u"), F.col("user_id"), F.lit("/x"))
    rows = table(spark, d, "events").select(
        "event_id", F.struct(secret.alias("a"), F.array(place, F.lit("plain"), F.lit(None).cast("string")).alias("b"), F.when(n % 2 == 0, F.create_map(F.lit("token=k"), F.array(F.struct(secret.alias("c"))))).alias("m")).alias("body"),
        F.parse_json(F.concat(F.lit('{"token=key": ["a \\"q\\" '), secret, F.lit(' z", 1, {"p": "'), place, F.lit('"}]}'))).alias("raw"),
    )
    c = cleaned_rows(rows)
    return c.select("event_id", F.col("body.a").alias("a"), F.array_join("body.b", ",", "null").alias("b"), F.map_values("body.m")[0][0]["c"].alias("c"), F.map_keys("body.m")[0].alias("k"), F.to_json("raw").alias("raw"))


def verify_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Whether each passage cited from a document is in it."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"), (F.col("item_id") * 5).alias("doc_id"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return b.join(docs, "doc_id", "left").select("item_id", F.when(F.col("text").isNull(), "no_source").when(F.contains("text", "quote"), "ok").otherwise("not_in_source").alias("verdict"))


def ancestor_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.concat(F.lit("r/"), F.col("p_size") % 7, F.lit("/"), F.col("p_size") % 5, F.lit("/f"), F.col("p_partkey")).alias("path"))
    marks = spark.createDataFrame([("r/1",), ("r/1/2",), ("r/3/4",)], "folder string")
    return C.nearest_ancestor(p, marks)


QUERIES = {f.__name__: f for f in (
    manifest_drift, exact_dup_groups, near_dup_pairs, near_dup_pairs_all, parity_compare, orphan_prune_plan, settings_merge, findings_unnest, hash_chain_verify, live_decisions, tag_mining, conflict_pairs, taint_closure,
    todo_fold, session_resume, memory_recall, forget_receipt, usage_by_role, hook_breakdown, queue_age, retention_plan, byte_cap_rotation, cooldown_scan, ratchet_best, section_membership, line_anchors,
    host_tier, url_guard, wiki_lint_orphans, schema_conformance, schema_errors, event_chain, nested_redaction, verify_quotes, ancestor_lookup,
)}

ORACLE_SQL = {
    "manifest_drift": "SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 AND text <> 'x' THEN 'sha_mismatch' WHEN doc_id % 5 = 0 THEN 'size_mismatch' ELSE 'ok' END AS status FROM documents",
    "exact_dup_groups": "SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY sha HAVING count(*) > 1",
    "near_dup_pairs": r"""
WITH own AS (SELECT min(doc_id) AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents GROUP BY text),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM own),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id AND abs(a.id % 30 - b.id % 30) <= 7 GROUP BY ALL)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) > 0.6""",
    "near_dup_pairs_all": r"""
WITH own AS (SELECT min(doc_id) AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents GROUP BY text),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM own),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) > 0.6""",
    "parity_compare": """SELECT n_nationkey, 'n_name' AS field, n_name AS left, lower(n_name) AS right FROM nation WHERE n_nationkey % 5 = 0 AND n_name <> lower(n_name)
UNION ALL SELECT n_nationkey, 'ready', 'true', NULL FROM nation WHERE n_nationkey % 7 = 0""",
    "orphan_prune_plan": """SELECT 'commands/' || CASE WHEN p_partkey % 4 = 0 THEN 'x-' ELSE 'own-' END || p_partkey AS path FROM part
WHERE p_partkey % 6 <> 0 AND (p_partkey % 3 = 0 OR p_partkey % 4 = 0 OR p_partkey = 1)""",
    "settings_merge": """SELECT event_type, user_id % 20 AS command, event_id % 2 AS side, event_id AS pos FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 20 ORDER BY event_id % 2, event_id) = 1""",
    "findings_unnest": "SELECT l_orderkey::VARCHAR AS package, '1.0' AS version, CASE WHEN l_linenumber % 2 = 0 THEN 'V-' || l_linenumber ELSE 'N-' || l_partkey END AS id, l_returnflag AS fix_versions, 'a ' || l_linestatus AS description FROM lineitem",
    "hash_chain_verify": """SELECT user_id, count(*) AS lines, count(*) FILTER (i > 2 AND event_id % 97 = 0) AS mismatches
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) GROUP BY user_id""",
    "live_decisions": LIVE + "SELECT id FROM live",
    "tag_mining": LIVE + "SELECT 't' || (id % 4) AS tag, count(*) AS n FROM live GROUP BY tag",
    "conflict_pairs": "SELECT a.doc_id AS id, b.doc_id AS other FROM labels a JOIN labels b ON b.doc_id = a.doc_id + 1 WHERE a.quality = 0 AND a.toxic <> 1 AND b.toxic <> 1",
    "taint_closure": """
WITH RECURSIVE e AS (SELECT o_orderkey // 2 AS parent, o_orderkey AS child FROM orders WHERE o_orderkey > 1),
c AS (SELECT o_orderkey AS node, 0 AS depth FROM orders WHERE o_custkey IN (7, 11) UNION ALL SELECT child, depth + 1 FROM c JOIN e ON node = parent)
SELECT node, min(depth) AS depth FROM c GROUP BY node""",
    "todo_fold": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "session_resume": """SELECT user_id AS session, event_type AS kind, event_id AS item, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events
QUALIFY rank <= CASE event_type WHEN 'click' THEN 12 WHEN 'view' THEN 10 ELSE 5 END""",
    "memory_recall": LIVE + """SELECT id, round((0.5 + (id % 10) / 20) * (1 / (1 + log10(n_chars + 1))) * pow(0.5, (id % 90) / 30.0), 6) AS score
FROM live JOIN documents ON doc_id = id ORDER BY score DESC, id LIMIT 20""",
    "forget_receipt": """
WITH g AS (SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT (SELECT count(*) FROM g) AS removed_rows, (SELECT 'tomb-' || left(sha256(count(*) || ':' || min(id) || ':' || max(id) || ':' || bit_xor(('0x' || left(md5(id::VARCHAR), 15))::BIGINT)), 16) FROM (SELECT DISTINCT id FROM g)) AS tombstone_id, true AS union_merge_restorable""",
    "usage_by_role": "SELECT role, count(*) AS turns, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes FROM conversations GROUP BY role",
    "hook_breakdown": "SELECT event_type, count(*) AS events, sum(strlen(props))::BIGINT AS bytes, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type",
    "queue_age": "SELECT ['pending', 'processing', 'dead'][event_id % 3 + 1] AS state, count(*) AS jobs, arg_min(event_id, (ts, event_id)) AS oldest_id, (epoch_us('2024-02-01'::TIMESTAMP) - epoch_us(min(ts))) // 1000000 AS oldest_age_s FROM events GROUP BY state",
    "retention_plan": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) > 20",
    "byte_cap_rotation": "SELECT * FROM (SELECT source, doc_id, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id DESC)::BIGINT AS running_bytes FROM documents) WHERE running_bytes <= 20000",
    "cooldown_scan": "SELECT event_id FROM (SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS g FROM events) WHERE g < 3600000000",
    "ratchet_best": """SELECT user_id, count(*) FILTER (b IS NULL OR value > b) AS kept, max(value) AS best
FROM (SELECT user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) GROUP BY user_id""",
    "section_membership": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, last_value(nullif(regexp_extract(line, '^([A-Z][a-z]+) .*$', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l)
SELECT doc_id, count(*) AS lines, count(DISTINCT section) AS sections, count(*) FILTER (section IS NULL) AS before_any FROM s GROUP BY doc_id""",
    "line_anchors": "SELECT doc_id, i AS line_no, left(sha256(line), 8) AS anchor FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)",
    "host_tier": r"SELECT host, CASE WHEN host LIKE '%.com' THEN 'trusted' WHEN host LIKE '%.net' THEN 'known' ELSE 'unknown' END AS tier, count(*) AS pages FROM (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)) AS host FROM pages) GROUP BY ALL",
    "url_guard": "SELECT page_id, lower(url) LIKE 'https://%' AS allowed FROM pages",
    "wiki_lint_orphans": """SELECT page_id FROM pages WHERE '/' || regexp_extract(url, '/([0-9]+)', 1) NOT IN (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages)""",
    "schema_conformance": "SELECT event_id, concat_ws(',', CASE WHEN event_id % 3 <> 0 THEN 'category' END, CASE WHEN event_id % 7 + 1 > 5 THEN 'topics' END, CASE WHEN event_id % 11 = 0 THEN 'additional' END) AS errors FROM events",
    "schema_errors": """
WITH c AS (SELECT event_id, 'content_classification' AS kind, list_filter([CASE WHEN event_id % 3 <> 0 THEN '$.category: enum' END, CASE WHEN event_id % 4 = 0 THEN '$.language: required' END,
             CASE WHEN event_id % 7 + 1 > 5 THEN '$.topics: maxItems' END, CASE WHEN event_id % 2 = 0 AND event_id % 7 + 1 >= 3 THEN '$.topics[2]: minLength' END], lambda x: x IS NOT NULL) AS x FROM events
  UNION ALL SELECT event_id, 'generated_comment', list_filter([CASE WHEN event_id % 7 = 0 THEN '$.comment: minLength' END, CASE WHEN event_id % 5 = 0 THEN '$.riskLevel: enum' END,
             CASE WHEN event_id % 11 = 0 THEN '$.reason: required' WHEN event_id % 3 = 0 THEN '$.reason: maxLength' END, CASE WHEN event_id % 17 = 0 THEN '$.tone: enum' END], lambda x: x IS NOT NULL) FROM events
  UNION ALL SELECT event_id, 'post_comment', list_filter([CASE WHEN event_id % 7 = 0 THEN '$.comment: minLength' END, CASE WHEN event_id % 5 = 0 THEN '$.riskLevel: enum' END,
             CASE WHEN event_id % 2 <> 0 THEN '$.dryRun: required' END, CASE WHEN event_id % 4 = 0 THEN '$.care: additionalProperties' END, CASE WHEN event_id % 3 = 0 THEN '$.zeal: additionalProperties' END], lambda x: x IS NOT NULL) FROM events)
SELECT event_id, kind, coalesce(array_to_string(x, '; '), '') AS errors FROM c""",
    "event_chain": "SELECT event_id FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS before FROM events) WHERE before % 997 = 0",
    "nested_redaction": """
SELECT event_id, 'token[REDACTED]' AS a, 'see [PATH],plain,null' AS b, CASE WHEN event_id % 2 = 0 THEN 'token[REDACTED]' END AS c, CASE WHEN event_id % 2 = 0 THEN 'token=k' END AS k,
       '{"token=key":["a \\"q\\" token[REDACTED] z",1,{"p":"see [PATH]"}]}' AS raw FROM events""",
    "verify_quotes": "SELECT item_id, CASE WHEN d.text IS NULL THEN 'no_source' WHEN contains(d.text, b.text) THEN 'ok' ELSE 'not_in_source' END AS verdict FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 5",
    "ancestor_lookup": "SELECT 'r/' || (p_size % 7) || '/' || (p_size % 5) || '/f' || p_partkey AS path, CASE WHEN p_size % 7 = 1 AND p_size % 5 = 2 THEN 'r/1/2' WHEN p_size % 7 = 1 THEN 'r/1' WHEN p_size % 7 = 3 AND p_size % 5 = 4 THEN 'r/3/4' END AS root FROM part",
}
