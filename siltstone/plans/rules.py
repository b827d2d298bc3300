"""Queries of the scoring, policy and redaction families, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import policy as P
from siltstone.operators import scoring as S

from .search import REDACT, table


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Events of the ledger as evidence: the type is the candidate, the words of value and props the note."""
    e = table(spark, d, "events")
    word = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "signup", "token").otherwise("seen")
    return e.select(
        F.col("event_type").alias("event"), F.lit("ledger").alias("source"), F.concat("event_type", F.lit("-"), F.col("user_id") % 50).alias("candidate"),
        word.alias("signal"), F.col("props").alias("note"), F.array(F.lit("useful")).alias("tags"),
        (F.col("event_id") % 3000).alias("token_estimate"), F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 5) / 8).alias("confidence_hint"), F.lit(None).cast("double").alias("risk_hint"),
    )


def candidate_score(spark: SparkSession, d: str) -> DataFrame:
    s = S.scored(evidence(spark, d))
    return s.select("candidate", "events", "token_budget", F.round("confidence", 6).alias("confidence"), F.round("risk", 6).alias("risk"), "decision", F.array_join("reasons", ";").alias("reasons"))


def candidate_top(spark: SparkSession, d: str) -> DataFrame:
    return S.ranked(candidate_score(spark, d), limit=10).select("candidate", "decision", "confidence")


def keyword_bag(spark: SparkSession, d: str) -> DataFrame:
    bag = T.word_set(F.col("text"))
    terms = ["the", "and", "license", "token", "secret", "password", "public"]
    return table(spark, d, "documents").select("doc_id", F.size(bag).cast("long").alias("words"), T.hits(bag, terms).cast("long").alias("hits"))


COMMANDS = ["git branch -d ", "rm -rf /", "git commit -m ", "rg ", "find . -name ", "grep -rn ", "git push origin --delete ", "npm install ", "ls ", "cat a && rg ", "rg x | head ", "grep x "]


def commands(spark: SparkSession, d: str) -> DataFrame:
    """A command per event, made from a fixed list and a branch name."""
    verb = F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("event_id") % len(COMMANDS) + 1).cast("int"))
    name = F.when(F.col("user_id") % 3 == 0, F.lit("main")).otherwise(F.concat(F.lit("topic-"), F.col("user_id")))
    return table(spark, d, "events").select("event_id", "user_id", F.concat(verb, name).alias("command"))


def policy_decision(spark: SparkSession, d: str) -> DataFrame:
    return commands(spark, d).select("event_id", P.command_decision(F.col("command")).alias("x")).select("event_id", "x.decision")


COMMANDS_SQL = "SELECT event_id, user_id, event_id % 12 AS v, user_id % 3 = 0 AS shared, ([" + ", ".join(f"'{c}'" for c in COMMANDS) + "])[event_id % 12 + 1] || CASE WHEN user_id % 3 = 0 THEN 'main' ELSE 'topic-' || user_id END AS command FROM events"
DECISION_SQL = f"SELECT event_id, user_id, CASE WHEN v = 1 OR (v IN (0, 6) AND shared) THEN 'deny' WHEN v IN (2, 6, 7) THEN 'ask' ELSE 'allow' END AS decision FROM ({COMMANDS_SQL})"


def worst_decision(spark: SparkSession, d: str) -> DataFrame:
    return P.worst(commands(spark, d).select("user_id", P.command_decision(F.col("command"))["decision"].alias("decision")), "user_id")


def precall_routing(spark: SparkSession, d: str) -> DataFrame:
    return commands(spark, d).select("event_id", P.routed(F.col("command")).alias("route"))


def path_policy(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("src\\"), F.element_at(F.array(*[F.lit(x) for x in (".env", "secrets/a", "main.py", "k.pem", ".env.local", "environment")]), (F.col("p_partkey") % 6 + 1).cast("int")))
    rows = table(spark, d, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", P.path_decision(F.col("path"))["decision"].alias("decision"), T.secret_like_path(T.unix_path(F.col("path"))).alias("secret_like"), T.safe_path(T.unix_path(F.col("path"))).alias("safe"), T.build_excluded(T.unix_path(F.col("path"))).alias("excluded"))


def prompt_nudges(spark: SparkSession, d: str) -> DataFrame:
    n = P.nudges(table(spark, d, "conversations"), "text")
    return n.select("conv_id", "turn", "decision", *[F.array_join(c, ",").alias(c) for c in ("approval", "research", "verification")])


def redact_text(spark: SparkSession, d: str) -> DataFrame:
    t = T.redacted(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha"), (t != F.col("text")).alias("changed"))


def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat("source", F.lit("/"), F.col("doc_id"), F.when(F.col("doc_id") % 9 == 0, ".map").otherwise(".txt")).alias("path"))
    allowed = docs.where(F.col("doc_id") % 2 == 0).select("path")
    return P.secret_scan(docs, "path", "text", allowed).select("doc_id", "state")


def rates_axes(spark: SparkSession, d: str) -> DataFrame:
    from siltstone.operators.evals import rate

    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "left")
    tell = T.any_of(F.col("text"), T.AI_TELLS)
    return rows.agg(rate(F.count_if(F.col("toxic") == 1), F.count("*")).alias("spam_rate"), rate(F.count_if(F.col("quality") == 0), F.count("*")).alias("policy_violation_rate"), rate(F.count_if(tell), F.count("*")).alias("ai_tell_rate"))


#: The axes and their targets.
AXES = {"spam_rate": "< 0.02", "context_fit_rate": "> 0.85", "duplicate_rate": "< 0.05", "ai_tell_rate": "< 0.05", "policy_violation_rate": "< 0.10"}
SAMPLE = 50


def axes_report(spark: SparkSession, d: str) -> DataFrame:
    """(axis, value, target, met): each axis against its target. The judge's verdict is the label `quality`, of a sample of 50; documents are dated by their id."""
    from siltstone.operators import evals as E

    fit = E.sampled(table(spark, d, "labels"), "doc_id", SAMPLE).agg(E.rate(F.count_if(F.col("quality") == 1), F.count("*")).alias("context_fit_rate"))
    dated = table(spark, d, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(30)).alias("day"))
    row = rates_axes(spark, d).join(F.broadcast(fit)).join(F.broadcast(E.duplicate_share(dated).select(F.col("rate").alias("duplicate_rate"))))  # one row each
    axes = row.select(F.inline(F.array(*[F.struct(F.lit(x).alias("axis"), F.col(x).alias("value"), F.lit(t).alias("target")) for x, t in AXES.items()])))
    bound = F.substring("target", 3, 9).cast("double")
    return axes.withColumn("met", F.when(F.col("target").startswith("<"), F.col("value") < bound).otherwise(F.col("value") > bound))


QUERIES = {f.__name__: f for f in (candidate_score, candidate_top, keyword_bag, policy_decision, worst_decision, precall_routing, path_policy, prompt_nudges, redact_text, secret_scan, rates_axes, axes_report)}


def _keywords(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"array_to_string(list_filter([{listed}], lambda k: contains(lower(text), k)), ',')"


SCORES = r"""
WITH e AS (SELECT event_type || '-' || (user_id % 50) AS candidate, event_id,
    list_distinct(regexp_extract_all(lower(event_type || ' ledger ' || event_type || '-' || (user_id % 50) || ' ' || CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'token' ELSE 'seen' END || ' ' || props || ' useful'), '[a-z0-9가-힣_-]+')) AS bag FROM events),
h AS (SELECT candidate, event_id, len(list_intersect(bag, ['adopt', 'pass', 'passed', 'success', 'verified', 'repeat', 'repeated', 'useful', 'saved'])) AS p,
    len(list_intersect(bag, ['fail', 'failed', 'broken', 'stale', 'noisy', 'reject', 'regression'])) AS n,
    len(list_intersect(bag, ['secret', 'credential', 'token', 'oauth', 'billing', 'production', 'prod', 'deploy', 'destructive', 'delete', 'remote'])) AS r FROM e),
g AS (SELECT candidate, count(*) AS events, sum(p) AS p, sum(n) AS n, sum(r) AS r, avg((event_id % 5) / 8) FILTER (event_id % 4 = 0) AS ch,
    avg(event_id % 3000) FILTER (event_id % 3000 > 0) AS tokens FROM h GROUP BY candidate),
x AS (SELECT *, greatest(0, least(1, 0.35 + 0.25 * least(events, 5) / 5 + 0.25 * (p - n) / greatest(p + n, 1) + 0.15 * coalesce(ch, 0.5)))::DOUBLE AS c,
    greatest(0, least(1, 0.15 + 0.2 * n + 0.25 * r + 0.25 * 0.25))::DOUBLE AS k FROM g),
scores AS (SELECT candidate, events, least(6000, greatest(400, ceil(coalesce(tokens, 800 + 250 * events) / 100) * 100))::BIGINT AS token_budget,
    round(c, 6) AS confidence, round(k, 6) AS risk, CASE WHEN c >= 0.65 AND k <= 0.45 THEN 'promote' ELSE 'reject' END AS decision,
    coalesce(nullif(concat_ws(';', CASE WHEN p > 0 THEN 'positive_signals=' || p END, CASE WHEN n > 0 THEN 'negative_signals=' || n END, CASE WHEN r > 0 THEN 'risk_terms=' || r END, CASE WHEN ch IS NOT NULL THEN 'confidence_hint' END), ''), 'insufficient_signal') AS reasons FROM x)
"""

ORACLE_SQL = {
    "candidate_score": SCORES + "SELECT * FROM scores",
    "candidate_top": SCORES + "SELECT candidate, decision, confidence FROM scores ORDER BY decision <> 'promote', confidence DESC, risk, candidate LIMIT 10",
    "keyword_bag": """SELECT doc_id, len(bag) AS words, len(list_intersect(bag, ['the', 'and', 'license', 'token', 'secret', 'password', 'public'])) AS hits
FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9가-힣_-]+')) AS bag FROM documents)""",
    "policy_decision": f"SELECT event_id, decision FROM ({DECISION_SQL})",
    "worst_decision": f"SELECT user_id, CASE max(CASE decision WHEN 'deny' THEN 2 WHEN 'ask' THEN 1 ELSE 0 END) WHEN 2 THEN 'deny' WHEN 1 THEN 'ask' ELSE 'allow' END AS decision, CASE max(CASE decision WHEN 'deny' THEN 2 WHEN 'ask' THEN 1 ELSE 0 END) WHEN 2 THEN 10 WHEN 1 THEN 20 ELSE 0 END AS exit_code FROM ({DECISION_SQL}) GROUP BY user_id",
    "precall_routing": f"SELECT event_id, CASE WHEN v IN (3, 4, 5) THEN 'block' ELSE 'allow' END AS route FROM ({COMMANDS_SQL})",
    "path_policy": "SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1, 3, 4) THEN 'deny' ELSE 'allow' END AS decision, p_partkey % 6 IN (0, 1, 4) AS secret_like, true AS safe, false AS excluded FROM part",
    "prompt_nudges": f"SELECT *, CASE WHEN approval || research || verification <> '' THEN 'nudge' ELSE 'allow' END AS decision FROM (SELECT conv_id, turn, {_keywords(P.APPROVAL)} AS approval, {_keywords(P.RESEARCH)} AS research, {_keywords(P.VERIFY)} AS verification FROM conversations)",
    "redact_text": f"SELECT doc_id, sha256(t) AS sha, t <> text AS changed FROM (SELECT doc_id, text, {REDACT.format('text')} AS t FROM documents)",
    "secret_scan": f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'acknowledged' ELSE 'flagged' END AS state FROM documents WHERE doc_id % 9 <> 0 AND {REDACT.format('text')} <> text",
    "rates_axes": r"""SELECT round(count(*) FILTER (toxic = 1) / count(*), 6) AS spam_rate, round(count(*) FILTER (quality = 0) / count(*), 6) AS policy_violation_rate,
round(count(*) FILTER (regexp_matches(text, '(?i)as an ai|i''?m happy to help|great question')) / count(*), 6) AS ai_tell_rate FROM labels LEFT JOIN documents USING (doc_id)""",
    "axes_report": r"""
WITH c AS (SELECT doc_id, doc_id % 30 AS day, min(doc_id) OVER (PARTITION BY text) AS id FROM documents),
own AS (SELECT min(doc_id) AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents GROUP BY text),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM own),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
near AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) > 0.6),
dup AS (SELECT (SELECT count(*) FROM near JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE abs(x.day - y.day) <= 7)
  + (SELECT count(*) FROM c x JOIN c y ON x.id = y.id AND x.doc_id < y.doc_id AND abs(x.day - y.day) <= 7) AS k, (SELECT count(*) FROM c x JOIN c y ON x.doc_id < y.doc_id AND abs(x.day - y.day) <= 7) AS n),
fit AS (SELECT quality FROM labels ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 50)
SELECT 'spam_rate' AS axis, round(count(*) FILTER (toxic = 1) / count(*), 6) AS value, '< 0.02' AS target, value < 0.02 AS met FROM labels
UNION ALL SELECT 'context_fit_rate', round(count(*) FILTER (quality = 1) / count(*), 6) AS v, '> 0.85', v > 0.85 FROM fit
UNION ALL SELECT 'duplicate_rate', round(k / n, 6) AS v, '< 0.05', v < 0.05 FROM dup
UNION ALL SELECT 'ai_tell_rate', round(count(*) FILTER (regexp_matches(text, '(?i)as an ai|i''?m happy to help|great question')) / count(*), 6) AS v, '< 0.05', v < 0.05 FROM labels LEFT JOIN documents USING (doc_id)
UNION ALL SELECT 'policy_violation_rate', round(count(*) FILTER (quality = 0) / count(*), 6) AS v, '< 0.10', v < 0.10 FROM labels""",
}
