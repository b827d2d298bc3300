"""Temporal memory: what is live, folds of append-only ledgers, recall, forgetting, derivation."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as T
from siltstone.session import stored
from siltstone.sources.versions import Version, Versions

from .index import Index


def live(records: DataFrame, now: Column, include_expired: bool = False) -> DataFrame:
    """Records that are not tombstones, tombstoned, refuted or expired. records: (id, contradicts, expires_at, tombstone). Null flags count as false."""
    gone = records.where(F.coalesce("tombstone", F.lit(False))).select("id").distinct()
    standing = records.where(~F.coalesce("tombstone", F.lit(False))).join(gone, "id", "left_anti")
    refuted = standing.select(F.explode("contradicts").alias("id")).distinct()
    out = standing.join(refuted, "id", "left_anti")
    if include_expired:
        return out
    bound = T.expires(F.col("expires_at"))
    return out.where(F.col("expires_at").isNull() | (bound >= now))


def folded(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The last value of each key in an append-only ledger."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def last_of(rows: DataFrame, group: list[str], newest: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*newest)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recall_score(confidence: Column, relevance: Column, age_days: Column, half_life: float = 30.0) -> Column:
    """confidence * relevance * recency, recency halving every half_life days."""
    return confidence * relevance * F.pow(F.lit(0.5), age_days / half_life)


def request_id() -> Column:
    """The tombstone id of a request, an aggregate over all of its ids, so that two different requests have different ones."""
    drawn = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 15), 16, 10).cast("long")
    parts = F.concat_ws(":", F.count("*").cast("string"), F.min("id").cast("string"), F.max("id").cast("string"), F.bit_xor(drawn).cast("string"))
    return F.concat(F.lit("tomb-"), F.substring(F.sha2(parts, 256), 1, 16))


def forgotten(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows without the ids, and the receipt: one row."""
    kept = rows.join(ids.select("id"), "id", "left_anti")
    hit = rows.join(ids.select("id"), "id", "left_semi")
    request = hit.select("id").distinct().agg(request_id().alias("tombstone_id"))
    receipt = hit.agg(F.count("*").alias("removed_rows")).crossJoin(request)  # two single rows
    return kept, receipt.withColumn("union_merge_restorable", F.lit(True))


def forget(store: Versions, table: str, schema: str, ids: DataFrame) -> tuple[Version, DataFrame]:
    """A version of a ledger (id, ..) without the ids, and their tombstones (id, tombstone_id).

    Only parts that hold such rows are written anew; the tombstones go to the
    part `tombstones` of a table beside it. Readers of the version before still
    see it until the store is vacuumed, so a request ends with that.
    """
    base = store.version()
    rows = store.read(table, base, f"{schema}, part string")
    hit = stored(rows.join(ids.select("id").distinct(), "id", "left_semi").select("id", "part"))
    touched = sorted(r.part for r in hit.select("part").distinct().collect())  # parts of the ledger
    gone = hit.select("id").distinct()
    request = gone.agg(request_id().alias("tombstone_id"))
    tombstones = gone.crossJoin(request).withColumn("part", F.lit(request.first()[0]))
    if not touched:
        return base, tombstones.drop("part")
    folder = store.stage(**{table: rows.where(F.col("part").isin(touched)).join(gone, "id", "left_anti").select(*rows.columns), "tombstones": tombstones})
    new = store.commit(base, folder, [table, "tombstones"], [*touched, *store.staged(folder, "tombstones")])
    return new, tombstones.drop("part")


def derived_from(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth) of all that derives from the seeds, at its least depth. edges: (parent, child). Rounds go on until nothing new is found, however deep, and end on cycles too; each is written to the shared folder."""
    edges = edges.select("parent", "child").distinct()
    front = seeds.select(F.col("node")).distinct().withColumn("depth", F.lit(0))
    seen = front
    for depth in count(1):
        new = front.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        new = stored(new)
        if new.isEmpty():
            break
        seen, front = seen.unionByName(new), new
    return seen


def union_of(ledgers: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ledgers)


def compacted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, tombstone, tombstone_id): the ledger rewritten without the ids, and a tombstone for each of these that it held.

    The tombstone's id comes from all ids of the request, so that two different requests have different ones.
    """
    gone = rows.select("id").join(ids.select("id").distinct(), "id", "left_semi").distinct()
    request = gone.agg(request_id().alias("tombstone_id"))
    kept = rows.select("id").join(gone, "id", "left_anti").select("id", F.lit(False).alias("tombstone"), F.lit(None).cast("string").alias("tombstone_id"))
    return kept.unionByName(gone.join(F.broadcast(request)).select("id", F.lit(True).alias("tombstone"), "tombstone_id"))  # the request is one row


def prior_session(rows: DataFrame, owner: str, session: str, ts: str, days: int = 14) -> DataFrame:
    """The rows of each owner's session before the current one, where it ended at most `days` before the current one's end."""
    ends = rows.groupBy(owner, session).agg(F.max(ts).alias("_end"))
    w = Window.partitionBy(owner).orderBy(F.desc("_end"), F.desc(session))
    prior = ends.withColumn("_r", F.row_number().over(w)).withColumn("_now", F.first("_end").over(w)).where((F.col("_r") == 2) & (F.col("_end") >= F.col("_now") - F.make_dt_interval(F.lit(days))))
    return rows.join(prior.select(owner, session), [owner, session], "left_semi")


def recalled(index: Index, priors: DataFrame, queries: DataFrame, k: int = 5, first: int = 20, query: str = "item_id") -> DataFrame:
    """(query, doc, recall, rank): the k documents of highest prior * s / (s + 1), s their BM25 score. priors: (doc, prior), each doc once, within 0 and 1.

    Each segment of the index takes the priors of its documents and returns its
    best products, so no pair of a query and a document leaves its task without
    being among them. The result is exact; documents without a word of the query
    are in none. `first` is the least number of products that a segment keeps.
    """
    best = Window.partitionBy(query).orderBy(F.desc("recall"), "doc")
    out = index.recalled(queries, priors, max(k, first), query).select(query, "doc", F.round("score", 6).alias("recall"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
