"""Lexical, dense and fused retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import spread, stored

from .dictionary import found

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", terms: Column | None = None) -> DataFrame:
    """(key, term, tf, len): partial counts are made before the one shuffle."""
    bag = terms if terms is not None else tokens(F.col(text))
    own = spread(docs).select(F.col(key), bag.alias("bag")).withColumn("len", F.size("bag").cast("long"))
    exploded = own.select(key, "len", F.explode_outer("bag").alias("term")).where(F.col("term").isNotNull())
    return exploded.groupBy(key, "len", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n, avgdl."""
    return spread(docs.select(text)).agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl"))


def index_stats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: postings, tokens, terms, n, avgdl of docs (key, text).

    A document's postings are its different words, so they are counted where it
    is read; only the terms are shuffled, and what stands under repeated keys.
    """
    twice = docs.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") > 1).select(F.col(key).alias("_k"))
    own = spread(docs).select(key, tokens(F.col("text")).alias("bag")).withColumn("different", F.array_distinct("bag"))
    counted = own.agg(F.nullif(F.sum(F.size("bag")), F.lit(0)).alias("tokens"), F.sum(F.size("different")).alias("postings"), F.count("*").alias("n"), F.round(F.avg(F.size("bag")), 6).alias("avgdl"))
    again = F.lit(0)
    if not twice.isEmpty():  # words that a key holds in several rows are one posting
        held = own.join(twice, F.col(key).eqNullSafe(F.col("_k")), "left_semi").select(key, F.explode("different").alias("term"))
        again = F.lit(held.groupBy(key, "term").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0))).first()[0])
    terms = own.select(F.explode_outer("different").alias("term")).where(F.col("term").isNotNull()).distinct().agg(F.count("*").alias("terms"))
    return counted.crossJoin(terms).select((F.coalesce("postings", F.lit(0)) - again).alias("postings"), "tokens", "terms", "n", "avgdl")  # one row each


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", query: str = "item_id", digits: int = 6) -> DataFrame:
    """(query, key, score, rank): the k best of each query, ties to the lower key.

    Only postings of query terms are made: the terms of all queries, a small
    table of their own, meet the exploded words before any count is shuffled.
    The postings are written once, since counts and scores both read them.
    """
    q = queries.select(query, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    vocabulary = q.select("term").distinct()
    own = spread(docs).select(key, tokens(F.col("text")).alias("bag")).withColumn("len", F.size("bag"))
    # explode would make Spark compute the bag again for a filter on its size
    hits = own.select(key, "len", F.explode_outer("bag").alias("term")).join(vocabulary, "term")
    posts = stored(hits.groupBy("term", key, "len").agg(F.count("*").alias("tf")))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    stats = corpus_stats(docs).first()  # two numbers
    n, avgdl = F.lit(stats.n), F.lit(stats.avgdl)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avgdl))
    scored = posts.join(df, "term").select("term", key, weight.alias("w"))
    total = q.join(scored, "term").groupBy(query, key).agg(F.round(F.sum("w"), digits).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def holding(docs: DataFrame, passages: DataFrame, key: str, passage: str) -> DataFrame:
    """(passage, key) of the documents (key, text) that hold a passage (passage, text) as it stands, of any length."""
    named = passages.select(passage, F.col("text").alias("phrase"))
    return found(docs, named, key).join(named, "phrase").select(passage, key)


#: Bytes of query vectors that travel to the executors at once; more queries are matched in several passes.
QUERY_BYTES = 64 << 20
#: Similarities that a task holds at once.
CELLS = 1 << 21
#: Decimal places to which similarities tie.
TIES = 9


def _matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of vectors of full length without nulls, of the length of the first, and the vectors."""
    sizes = np.asarray(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    dims = sizes[sizes > 0][0] if (sizes > 0).any() else 0
    at = np.flatnonzero((sizes == dims) & (dims > 0))
    values = np.asarray(rows.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(at), -1 if len(at) else max(int(dims), 1))
    fine = np.isfinite(values).all(axis=1)
    return at[fine], values[fine]


def _unit(values: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    return np.divide(values, norms, out=np.full_like(values, np.nan), where=norms > 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the lower id; nan is no score."""
    at = np.flatnonzero(~np.isnan(scores))
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def dense(vectors: DataFrame, queries: DataFrame, metric: str = "cosine", k: int = 5, digits: int = 4) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k vectors most similar to each query's, itself left out; metric: cosine or dot.

    A block of query vectors of bounded size travels to the executors, is
    multiplied with batches of vectors as matrices of at most CELLS products,
    and each task keeps its k best for each query, so k rows for each query and task are shuffled. Ranks
    follow scores of TIES places, ties going to the lower id; `digits` is for
    show. Vectors that are null, of another length than the queries', with null
    or non-finite entries, or of length zero (cosine) have no similarity. Ids
    are longs, each standing once.
    """
    size = queries.select(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    passes = max(1, -(-size.n * max(size.d or 0, 1) * 8 // QUERY_BYTES))
    near = None
    for part in range(passes):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == part).select("vec_id", "embedding").toArrow()
        column = own.column(1).combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
        at, wanted = _matrix(column)
        query_ids = np.asarray(own.column(0).to_numpy())[at]
        own = _matched(vectors, query_ids, _unit(wanted) if metric == "cosine" else wanted, metric, k)
        near = own if near is None else near.unionByName(own)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("score", F.round("score", digits))


def _matched(vectors: DataFrame, query_ids: np.ndarray, wanted: np.ndarray, metric: str, k: int) -> DataFrame:
    """The k best of each task for each query."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids, best = [np.zeros(0, np.int64)] * len(query_ids), [np.zeros(0)] * len(query_ids)
        for b in it:
            at, values = _matrix(b.column(1))
            if not len(at) or not len(query_ids) or values.shape[1] != wanted.shape[1]:
                continue
            ids = np.asarray(b.column(0).to_numpy(zero_copy_only=False))[at].astype(np.int64)
            values = _unit(values) if metric == "cosine" else values
            step = max(1, CELLS // len(ids))
            for lo in range(0, len(query_ids), step):
                scores = np.round(wanted[lo : lo + step] @ values.T, TIES)
                for q, own in enumerate(scores, lo):
                    own[ids == query_ids[q]] = np.nan
                    top = _best(ids, own, k)
                    i, s = np.concatenate([best_ids[q], ids[top]]), np.concatenate([best[q], own[top]])
                    top = _best(i, s, k)
                    best_ids[q], best[q] = i[top], s[top]
        counts = [len(x) for x in best_ids]
        if sum(counts):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, counts).astype(np.int64)), pa.array(np.concatenate(best_ids)), pa.array(np.concatenate(best))], names=["query_id", "vec_id", "score"])

    return spread(vectors.select("vec_id", "embedding")).mapInArrow(batches, "query_id long, vec_id long, score double")


def dense_or_lexical(vectors: DataFrame | None, query_vectors: DataFrame, docs: DataFrame, queries: DataFrame, metric: str = "cosine", k: int = 10, key: str = "vec_id", query: str = "query_id") -> DataFrame:
    """(query, key, score, rank, arm): dense hits, or BM25's where there are no vectors. docs: (key, text), queries: (query, text)."""
    if vectors is not None and not vectors.isEmpty():
        hits = dense(vectors, query_vectors, metric, k).select(F.col("query_id").alias(query), F.col("vec_id").alias(key), "score", "rank")
        return hits.withColumn("arm", F.lit("dense"))
    return bm25(docs, queries, k, key, query).select(query, key, "score", "rank").withColumn("arm", F.lit("lexical"))


def fused(arms: list[DataFrame], constant: Column, query: str, key: str) -> DataFrame:
    """Reciprocal-rank fusion of (query, key, rank) lists."""
    rows = arms[0].select(query, key, "rank")
    for a in arms[1:]:
        rows = rows.unionByName(a.select(query, key, "rank"))
    total = rows.groupBy(query, key).agg(F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("score"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key)))


def blended(first: Column, second: Column, rank: Column) -> Column:
    """Retrieval and rerank scores by position: 75/25 up to rank 3, 60/40 up to 10, 40/60 beyond."""
    share = F.when(rank <= 3, 0.75).when(rank <= 10, 0.6).otherwise(0.4)
    return share * first + (1 - share) * second


def metrics(ranked: DataFrame, relevant: DataFrame, k: int, query: str, key: str) -> DataFrame:
    """(query, recall, rr, ndcg) of every query with a relevant key. ranked: (query, key, rank)."""
    right = ranked.where(F.col("rank") <= k).join(relevant.select(query, key), [query, key])
    gains = right.groupBy(query).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    all_ = relevant.groupBy(query).agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    out = all_.join(gains, query, "left")
    zero = F.lit(0.0)
    return out.select(
        query,
        F.round(F.coalesce(F.col("hits") / F.col("n"), zero), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), zero), 6).alias("rr"),
        F.round(F.coalesce(F.col("dcg") / ideal, zero), 6).alias("ndcg"),
    )


def packed_context(ranked: DataFrame, query: str, size: Column, budget: int) -> DataFrame:
    """Ranked rows of each query as long as their running size stays within the budget."""
    w = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("bytes_so_far", F.sum(size).over(w)).where(F.col("bytes_so_far") <= budget)


def freshness(indexed: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, reason): current, dirty, missing from the index, or deleted from the source. Both sides: (key, sha)."""
    both = indexed.select(key, F.col("sha").alias("old")).join(current.select(key, F.col("sha").alias("new")), key, "full_outer")
    reason = F.when(F.col("old").isNull(), "missing").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "current").otherwise("dirty")
    return both.select(key, reason.alias("reason"))
