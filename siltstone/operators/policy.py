"""Ordered policies, nudges and secret scans over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

#: Commands that are denied, commands that need approval, paths that are denied, in order.
DENY = [
    r"\brm\s+-rf\s+(/|~|\*|\.)",
    r"\bgit\s+reset\s+--hard\b",
    r"\bgit\s+clean\s+-fd\b",
    r"\bdropdb\b",
    r"\bdrop\s+database\b",
    r"\bprisma\s+migrate\s+reset\b",
    r"\bsequelize\s+db:drop\b",
    r"\bkubectl\s+delete\b",
    r"\bterraform\s+destroy\b",
    r"\bpulumi\s+destroy\b",
    r"\bgit(?:\s+-C\s+\S+)?\s+branch\b[^\n;&|]*(?:-d|-D|--delete)\b[^\n;&|]*(?<![A-Za-z0-9._/-])(?:refs/heads/)?(?:main|master|develop|development|trunk|prod|production|staging)(?![A-Za-z0-9._/-])",
    r"\bgit\s+push\b.*(--force\b|--force-with-lease|\s-f\b)",
    r"\bgit(?:\s+-C\s+\S+)?\s+push\b[^\n;&|]*(?:--delete|-d)\b[^\n;&|]*(?<![A-Za-z0-9._/-])(?:refs/heads/)?(?:main|master|develop|development|trunk|prod|production|staging)(?![A-Za-z0-9._/-])",
    r"\bgit(?:\s+-C\s+\S+)?\s+push\b[^\n;&|]*(?<!\S):(?:refs/heads/)?(?:main|master|develop|development|trunk|prod|production|staging)(?![A-Za-z0-9._/-])",
    r"\bgit\s+filter-branch\b",
    r"\bgit\s+filter-repo\b",
    r"\bgit\s+update-ref\s+-d\b",
    r"\bgit\s+reflog\s+expire\b",
]
ASK = [
    r"\bgit\s+(commit|push|merge|rebase)\b",
    r"\bgh\s+repo\s+create\b",
    r"\bgh\s+workflow\s+run\b",
    r"\b(npm|pnpm|yarn)\s+(install|add|publish)\b",
    r"\b(pip\s+install|uv\s+add)\b",
]
DENIED_PATHS = [r"(^|/)\.env($|\.)", r"(^|/)secrets?/", r"credentials\.json$", r"\.pem$", r"\.key$", r"id_rsa$", r"id_ed25519$"]
#: Words that nudge towards approval, research or verification, in order.
APPROVAL = ["production", "deploy", "billing", "auth", "permission", "delete data", "database reset", "secret", "token", "oauth"]
RESEARCH = ["latest", "recent", "current", "recommend", "library", "plugin", "mcp", "hook", "skill"]
VERIFY = ["fix", "bug", "implement", "upgrade", "refactor", "release"]
SEVERITY = {"deny": 10, "ask": 20, "allow": 0}


def first_match(c: Column, patterns: list[str]) -> Column:
    """The first pattern that is found, in order; null if none is."""
    return F.coalesce(*[F.when(c.rlike("(?i)" + p), F.lit(p)) for p in patterns])


def command_decision(c: Column) -> Column:
    """struct(decision, pattern)."""
    deny, ask = first_match(c, DENY), first_match(c, ASK)
    return F.struct(F.when(deny.isNotNull(), "deny").when(ask.isNotNull(), "ask").otherwise("allow").alias("decision"), F.coalesce(deny, ask).alias("pattern"))


def path_decision(c: Column) -> Column:
    found = first_match(T.unix_path(c), DENIED_PATHS)
    return F.struct(F.when(found.isNotNull(), "deny").otherwise("allow").alias("decision"), found.alias("pattern"))


def keywords(c: Column, terms: list[str]) -> Column:
    """The terms that the lower-cased text holds, in order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))


def nudges(df: DataFrame, text: str) -> DataFrame:
    out = df.withColumns({"approval": keywords(F.col(text), APPROVAL), "research": keywords(F.col(text), RESEARCH), "verification": keywords(F.col(text), VERIFY)})
    some = (F.size("approval") > 0) | (F.size("research") > 0) | (F.size("verification") > 0)
    return out.withColumn("decision", F.when(some, "nudge").otherwise("allow"))


def worst(df: DataFrame, group: str, decision: str = "decision") -> DataFrame:
    """The gravest decision of each group: deny, ask, allow."""
    rank = F.when(F.col(decision) == "deny", 2).when(F.col(decision) == "ask", 1).otherwise(0)
    code = F.when(F.col("decision") == "deny", SEVERITY["deny"]).when(F.col("decision") == "ask", SEVERITY["ask"]).otherwise(0)
    return df.groupBy(group).agg(F.max_by(decision, rank).alias("decision")).withColumn("exit_code", code)


def routed(c: Column) -> Column:
    """'block' for commands that print a tree of files or search one, 'allow' for piped, redirected, compound and other commands."""
    compound = c.rlike(r"&&|\|\||;")
    bounded = c.rlike(r"\|\s*(head|tail|wc|less|more)\b") | c.rlike(r">\s*/dev/null")
    wide = c.rlike(r"^\s*(rg|find|tree|ack|ag)\b") | c.rlike(r"^\s*grep\s+(-[A-Za-z]*\s+)*-[A-Za-z]*[rR]")
    return F.when(compound | bounded, "allow").when(wide, "block").otherwise("allow")


#: Files in which a hit is noise.
IGNORED = r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lock|Cargo\.lock|Gemfile\.lock|composer\.lock|go\.sum|poetry\.lock|firebase_options\.dart)$|\.(map|min\.js|min\.css)$|(^|/)(\.playwright-mcp|\.dart_tool|source-maps)/"


def secret_scan(df: DataFrame, path: str, text: str, allowed: DataFrame) -> DataFrame:
    """Rows with a secret: flagged, or acknowledged where `allowed` (path) lists them."""
    hits = df.where(T.any_of(F.col(text), [p for p, _ in T.SECRETS]) & ~F.col(path).rlike(IGNORED))
    known = allowed.select(F.col("path").alias(path)).distinct().withColumn("_known", F.lit(True))
    return hits.join(known, path, "left").withColumn("state", F.when(F.col("_known"), "acknowledged").otherwise("flagged")).drop("_known")
