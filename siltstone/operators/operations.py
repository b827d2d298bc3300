"""Operations: provenance, wiring, configuration checks, roll-ups, gates, caches, batch results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as T


def digest_status(required: DataFrame, provenance: DataFrame, subjects: str = "subjects") -> DataFrame:
    """(path, status): ok, missing or mismatch of required (path, sha) against maps path -> sha."""
    known = provenance.select(F.explode(subjects).alias("path", "_sha"))
    status = F.when(F.col("_sha").isNull(), "missing").when(F.col("sha") == F.col("_sha"), "ok").otherwise("mismatch")
    return required.join(known, "path", "left").select("path", status.alias("status"))


def wired_commands(settings: DataFrame, hooks: str = "hooks") -> DataFrame:
    """(event, matcher, command) of map<event, array<struct<matcher, hooks array<struct<command>>>>>."""
    entries = settings.select(F.explode(hooks).alias("event", "entries")).select("event", F.explode("entries").alias("e"))
    return entries.select("event", "e.matcher", F.explode("e.hooks.command").alias("command"))


def unwired(required: DataFrame, settings: DataFrame) -> DataFrame:
    """Required (event, command) that no setting wires."""
    return required.join(wired_commands(settings).select("event", "command").distinct(), ["event", "command"], "left_anti")


def assets(source: DataFrame, installed: DataFrame) -> DataFrame:
    """(name, status) over both sides (name, sha)."""
    both = source.select("name", F.col("sha").alias("_s")).join(installed.select("name", F.col("sha").alias("_i")), "name", "full_outer")
    return both.select("name", T.asset_status(F.col("_s"), F.col("_i")).alias("status"))


def managed_replaced(current: Column, managed: Column, is_managed) -> Column:
    """Entries of others in their order, then the managed ones."""
    return F.concat(F.filter(current, lambda x: ~is_managed(x)), managed)


def callers(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, callers, callees): how many edges (source, target) of other nodes end and begin at each name."""
    into = edges.groupBy(F.col("target").alias("name")).agg(F.count_distinct("source").alias("callers"))
    out = edges.groupBy(F.col("source").alias("name")).agg(F.count_distinct("target").alias("callees"))
    zero = F.lit(0).cast("long")
    both = names.select("name").join(into, "name", "left").join(out, "name", "left")
    return both.select("name", F.coalesce("callers", zero).alias("callers"), F.coalesce("callees", zero).alias("callees"))


def batch_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(custom_id, status): ok, error or missing for each request; unknown for a result that nobody asked for."""
    a = requests.select("custom_id", F.lit(True).alias("_asked"))
    both = a.join(results.select("custom_id", "error", F.lit(True).alias("_got")), "custom_id", "full_outer")
    status = F.when(F.col("_asked").isNull(), "unknown").when(F.col("_got").isNull(), "missing").when(F.col("error").isNotNull(), "error").otherwise("ok")
    return both.select("custom_id", status.alias("status"))


def pair_status(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """keys and status: both, or the name of the only side that has them."""
    a, b = (x.select(*keys).distinct().withColumn(c, F.lit(True)) for x, c in ((left, "_a"), (right, "_b")))
    status = F.when(F.col("_b").isNull(), names[0]).when(F.col("_a").isNull(), names[1]).otherwise("both")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def trust_tier(pages: DataFrame, tiers: DataFrame, url: str = "url", default: str = "unknown") -> DataFrame:
    """pages with host and tier, by the tiers (host, tier) of a host or of the longest domain above it. tiers is a policy list: its size is checked before it is broadcast."""
    host = T.host_of(F.col(url))
    parts = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    rows = pages.withColumn("host", host).withColumn("_row", F.monotonically_increasing_id())
    hits = rows.select("_row", F.posexplode(domains).alias("_depth", "_domain")).join(small(tiers.select(F.col("host").alias("_domain"), "tier")), "_domain")
    best = hits.groupBy("_row").agg(F.min_by("tier", "_depth").alias("tier"))
    return rows.join(best, "_row", "left").withColumn("tier", F.coalesce("tier", F.lit(default))).drop("_row")


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for a broadcast if it has `most` rows at most, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ok_of(checks: DataFrame, group: list[str], ok: str = "ok") -> DataFrame:
    """all_ok and any_ok of each group; null counts as failed."""
    value = F.coalesce(F.col(ok), F.lit(False))
    return checks.groupBy(*group).agg(F.bool_and(value).alias("all_ok"), F.bool_or(value).alias("any_ok"))


def report(checks: DataFrame) -> DataFrame:
    """One row over checks (name, ok): ok, and the sorted names of the failed ones."""
    value = F.coalesce(F.col("ok"), F.lit(False))
    return checks.agg(F.bool_and(value).alias("ok"), F.sort_array(F.collect_list(F.when(~value, F.col("name")))).alias("failed"))


def single_root(members: DataFrame, group: str, path: str = "path") -> DataFrame:
    """The only top folder of each archive's members; null where there are several."""
    root = F.split(path, "/")[0]
    return members.groupBy(group).agg(F.when(F.count_distinct(root) == 1, F.min(root)).alias("root"))


def recent_distinct(actions: DataFrame, group: str, action: str, ts: str, n: int = 10) -> DataFrame:
    """The n actions of each group that happened last, each once."""
    last = actions.groupBy(group, action).agg(F.max(ts).alias("last"))
    w = Window.partitionBy(group).orderBy(F.desc("last"), action)
    return last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def over_caps(files: DataFrame, caps: dict[str, int], area: str = "area", size: str = "bytes") -> DataFrame:
    """(area, entries, bytes, cap, over) of each area; areas without a cap are never over."""
    cap = F.coalesce(*[F.when(F.col(area) == k, F.lit(v)) for k, v in caps.items()], F.lit(None).cast("long"))
    sums = files.groupBy(area).agg(F.count("*").alias("entries"), F.sum(size).alias("bytes")).withColumn("cap", cap.cast("long"))
    return sums.withColumn("over", F.coalesce(F.col("bytes") > F.col("cap"), F.lit(False)))


def deletion_order(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths with depth, deepest first, so that folders are empty when they go; ties by path, descending."""
    return paths.withColumn("depth", F.size(F.split(path, "/"))).orderBy(F.desc("depth"), F.desc(path))


def sorted_map(m: Column) -> Column:
    """A map's entries in order of key."""
    return F.array_sort(F.map_entries(m))


def leased_first(jobs: DataFrame, n: int, priority: str = "priority", ts: str = "ts", key: str = "job_id") -> DataFrame:
    """The n jobs to lease next: P0 before P3, then the oldest."""
    return jobs.orderBy(priority, ts, key).limit(n)


def paged(memories: DataFrame, salience: Column, hot: int, group: str, key: str = "id") -> DataFrame:
    """memories with salience, rank and tier: the `hot` most salient of each group are paged in, the others out."""
    w = Window.partitionBy(group).orderBy(F.desc("salience"), key)
    out = memories.withColumn("salience", salience).withColumn("rank", F.row_number().over(w))
    return out.withColumn("tier", F.when(F.col("rank") <= hot, "hot").otherwise("cold"))


def memory_data(path: Column, folder: str = "memory") -> Column:
    """Whether a path is memory data: all in the folder but .gitkeep."""
    return path.rlike(rf"(^|/){folder}/") & ~path.rlike(r"(^|/)\.gitkeep$")


#: Rules that deny whole tools.
TOO_BROAD = ["*", "Bash", "Bash(*)", "Read", "Read(*)", "Edit", "Edit(*)", "Write", "Write(*)"]


def too_broad(denied: Column, forbidden: list[str] = TOO_BROAD) -> Column:
    """The entries of a deny list that would deny a whole tool."""
    return F.array_sort(F.array_intersect(denied, F.array(*[F.lit(x) for x in forbidden])))


def config_findings(config: DataFrame, key: str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """(key, rule, level) of each rule: (condition, level where it is broken); ok where it holds, null counts as broken."""
    rows = [F.struct(F.lit(name).alias("rule"), F.when(F.coalesce(holds, F.lit(False)), "ok").otherwise(level).alias("level")) for name, (holds, level) in rules.items()]
    return config.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.rule", "r.level")


def handler_rules(h: str = "handler") -> dict[str, tuple[Column, str]]:
    """Rules of a hook handler struct (type, command, asynchronous, timeout)."""
    c = F.col(h)
    return {
        "type": (c["type"] == "command", "fail"),
        "command": (F.length(F.trim(c["command"])) > 0, "fail"),
        "async": (~F.coalesce(c["asynchronous"], F.lit(False)), "warn"),
        "timeout": (c["timeout"].isNull() | (c["timeout"] > 0), "fail"),
    }


def indexed(path: Column, opted_in: list[str] = ()) -> Column:
    """Whether a path enters the index: no runtime state and no vendored payload, unless opted in by prefix."""
    out = ~path.rlike(r"(^|/)(\.agents?|\.cache|runtime|node_modules|vendor|third_party|dist|\.git)/")
    for prefix in opted_in:
        out = out | path.startswith(prefix)
    return out


#: Command classes that only read.
READ_ONLY = ["read", "search", "status", "doctor", "report", "verify"]


def ci_allowed(command_class: Column, ci: Column) -> Column:
    """Outside of CI everything goes; in it, classes that only read."""
    return ~F.coalesce(ci, F.lit(False)) | F.coalesce(command_class.isin(READ_ONLY), F.lit(False))


#: Profiles, each with all tools of those before.
PROFILES = ["usage", "core", "full", "full-all"]


def visible(tool_profile: Column, profile: Column) -> Column:
    """Whether a profile shows a tool that belongs to tool_profile; unknown profiles show nothing."""
    names = F.array(*[F.lit(x) for x in PROFILES])
    own, at = F.array_position(names, tool_profile), F.array_position(names, profile)
    return F.coalesce((own > 0) & (own <= at), F.lit(False))


def usage_of(transcripts: DataFrame) -> DataFrame:
    """(session, model, messages, input_tokens, output_tokens) of nested transcript lines: sessionId, message.id, message.model and message.usage; a message counts once, by its last line."""
    flat = transcripts.where(F.col("message.usage").isNotNull()).select(F.col("sessionId").alias("session"), "message.id", "message.model", "message.usage.input_tokens", "message.usage.output_tokens", "line")
    once = flat.groupBy("session", "id").agg(F.max_by(F.struct("model", "input_tokens", "output_tokens"), "line").alias("m"))
    zero = F.lit(0).cast("long")
    return once.groupBy("session", F.col("m.model").alias("model")).agg(F.count("*").alias("messages"), F.sum(F.coalesce("m.input_tokens", zero)).alias("input_tokens"), F.sum(F.coalesce("m.output_tokens", zero)).alias("output_tokens"))


def iso_seconds(ts: Column) -> Column:
    """A timestamp in UTC, second precision, with Z."""
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def route_query(q: Column) -> Column:
    """The retriever of a query: lexical for identifiers and paths, graph for questions about callers, dense for long questions, else hybrid. Rules of our own."""
    words = F.size(F.split(F.trim(q), r"\s+"))
    return F.when(q.rlike(r"(?i)\b(callers?|references?|depends? on)\b"), "graph").when((words <= 2) & q.rlike(r"[_/.]|[a-z][A-Z]"), "lexical").when(words >= 12, "dense").otherwise("hybrid")


def expanded(queries: DataFrame, synonyms: DataFrame, key: str, term: str = "term") -> DataFrame:
    """(key, term) of the query terms (key, term) and their synonyms (term, variant)."""
    more = queries.join(small(synonyms), term).select(key, F.col("variant").alias(term))
    return queries.select(key, term).unionByName(more).distinct()


def reranked(found: DataFrame, score: Column, query: str, key: str, shortlist: int = 30, first: str = "score", keep: int | None = None) -> DataFrame:
    """The shortlist of each query by a scorer's score, blended with the first score by position; rank anew."""
    from .retrieval import blended

    short = found.where(F.col("rank") <= shortlist).withColumn("second", score)
    both = short.withColumn("blend", F.round(blended(F.col(first), F.col("second"), F.col("rank")), 6))
    w = Window.partitionBy(query).orderBy(F.desc("blend"), key)
    out = both.withColumn("rank", F.row_number().over(w))
    return out if keep is None else out.where(F.col("rank") <= keep)


def forget_note(snapshots: DataFrame, needle: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Snapshots without those that embed the note, and these. A note of under 4 characters is refused, since it would match too much."""
    if len(needle) < 4:
        raise ValueError("a note to forget has 4 characters at least")
    held = F.coalesce(F.contains(F.col(text), F.lit(needle)), F.lit(False))
    return snapshots.where(~held), snapshots.where(held)


def better_index(default: DataFrame, other: DataFrame, metric: str = "recall") -> DataFrame:
    """One row: mean metric of both, and enabled where the other is strictly better."""
    a, b = default.agg(F.round(F.avg(metric), 6).alias("default")), other.agg(F.round(F.avg(metric), 6).alias("other"))
    return a.crossJoin(b).withColumn("enabled", F.col("other") > F.col("default"))  # one row each


def cited(ranked: DataFrame, query: str, source: str) -> DataFrame:
    """(query, citations): the sources of its hits in order of rank, numbered from 1."""
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col(source).cast("string").alias("source"))))
    return ranked.groupBy(query).agg(F.array_join(F.transform(listed, lambda x, i: F.concat(F.lit("["), i + 1, F.lit("] "), x["source"])), "; ").alias("citations"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), conditions, F.lit(True))
