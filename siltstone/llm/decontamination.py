"""Operator 7: benchmark decontamination by containment.

Words are runs of letters and digits, lower-cased; shingles are five words. A
shorter item is one shingle of all its words, and documents are searched for
runs of that many words too, where there are such items. Items are partitioned
by their number of distinct shingles n. In each partition an item is sketched by its k
least hashes (a bottom-k MinHash), k = floor((1 - t) * n_max) + 1 with n_max
the partition's largest n: a document that holds t of an item's shingles
misses at most floor((1 - t) * n) of them and so holds one of these k. Thus no
document is lost, however long. Documents that share a sketch hash and are
large enough for the partition are candidates; the exact share of the item's
shingles decides.

The sketches are joined by hash: Spark broadcasts them where their written size
is under its threshold, and else sorts and merges, splitting skewed keys. Tables
on the way are of few rows and written to few files.

Defined cases: null texts count as empty; texts and items without words match
nothing; documents under five words only hold shorter items; repeated rows of
one doc_id are one document; null ids are ids; equal items are reported each;
empty tables give empty results; very long texts are searched whole; other
columns, whatever their names, are not read and kept by `decontaminated`, which
takes each text without an id as a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, row_key, table, with_windows, written

SHINGLE = 5
CONTAINMENT = 0.8
#: Ids of documents that a join broadcasts at most.
BROADCAST = 1_000_000


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def doc_words(text: Column) -> Column:
    """As plain_words, without a look at each word: an empty first or last word adds no shingle of five real words."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def runs_of(df: DataFrame, words: Column, lengths: list[int]) -> DataFrame:
    """df with h: the hashes of its runs of each of these numbers of words, repeats included."""
    out = df.withColumn("__w", words)
    for k in lengths:
        out = with_windows(out, "__w", k, f"__h{k}")
    made = [f"__h{k}" for k in lengths]
    return out.withColumn("h", F.concat(*made)).drop("__w", *made)


def shingled(items: DataFrame, lengths: list[int]) -> DataFrame:
    """items with h: the distinct hashes of their shingles."""
    own = F.when(F.size("__all") >= SHINGLE, SHINGLE).otherwise(F.size("__all"))
    out = items.withColumn("__all", plain_words(F.col("text"))).withColumn("__own", own).withColumn("h", F.array().cast("array<bigint>"))
    for k in lengths:
        out = with_windows(out, "__all", k, "__h").withColumn("h", F.when(F.col("__own") == k, F.array_distinct("__h")).otherwise(F.col("h"))).drop("__h")
    return out.drop("__all", "__own")


def few(df: DataFrame) -> DataFrame:
    """df in two parts a core at most: a table of few rows, which as many parts as a shuffle has would leave in as many small files."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def size_class(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item, n, hashes, sketch): items in partitions by size, k from each partition's largest."""
    sized = items.where(F.size("h") > 0).withColumn("n", F.size("h"))
    sized = sized.withColumn("part", size_class(F.col("n")))
    largest = sized.groupBy("part").agg(F.max("n").alias("n_max"))
    k = F.floor(F.round((1 - F.lit(containment)) * F.col("n_max"), 6)).cast("int") + 1
    return sized.join(largest, "part").select("item", "n", "part", "h", F.slice(F.array_sort("h"), F.lit(1), k).alias("sketch"))


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles): the items that documents hold. docs: (doc_id, text), items: (item_id, text)."""
    found = items.select(F.struct(F.col("item_id").alias("id")).alias("item"), "text")
    short = items.select(F.size(plain_words(F.col("text"))).alias("n")).where(F.col("n").between(1, SHINGLE - 1)).distinct()
    lengths = [SHINGLE, *sorted(r.n for r in short.collect())]  # four more at most
    sk = written(few(sketches(shingled(found, lengths), containment)))
    probes = sk.select("item", "n", F.explode("sketch").alias("s"))
    probes = probes.groupBy("s").agg(F.min("n").alias("least"))
    named = docs.select(F.struct(F.col("doc_id").alias("id")).alias("doc"), "text")
    words = doc_words(F.col("text"))
    # explode_outer, since Spark derives a filter on the array's size from explode and computes the array a second time for it;
    # the size is a column before it, so that no exploded row carries the array along
    hits = runs_of(named, words, lengths).withColumn("m", F.size("h")).select("doc", "m", F.explode_outer("h").alias("s")).join(written(few(probes)), "s").where(F.col("m") >= F.floor(F.col("least") * containment))
    hits = hits.select("doc", "s").distinct()
    pairs = written(few(hits.join(sk.select("item", F.explode("sketch").alias("s")), "s").select("doc", "item").distinct()))
    full = sk.select("item", "n", F.explode("h").alias("s"))
    # only the texts of pairs are hashed again; the semi-join stands before the hashing
    close = pairs.select("doc").distinct()
    close = F.broadcast(close) if close.count() <= BROADCAST else close
    again = runs_of(named.join(close, "doc", "left_semi"), words, lengths).select("doc", F.explode_outer("h").alias("s"))
    shared = again.join(full, "s").groupBy("doc", "item", "n").agg(F.count_distinct("s").alias("shared"))
    right = shared.where(F.col("shared") >= F.ceil(F.round(F.col("n") * containment, 6))).join(pairs, ["doc", "item"], "left_semi")
    return right.select(F.col("doc.id").alias("doc_id"), F.col("item.id").alias("item_id"), "shared", F.col("n").cast("long").alias("n_shingles"))


def decontaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """docs without those that hold an item. Rows of one doc_id are one document; rows without an id are documents of their own."""
    key = row_key()
    name = fresh(docs, "key")
    keyed = docs.withColumn(name, F.when(F.col("doc_id").isNull(), key).otherwise(key.withField("t", F.lit(None).cast("long")).withField("n", F.lit(None).cast("int"))))
    leaks = contained(keyed.select(F.col(name).alias("doc_id"), "text"), items, containment).select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(leaks, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH iw AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), s AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM iw
), n AS (
  SELECT item_id, count(*) AS n FROM s GROUP BY item_id
), dw AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), k AS (
  SELECT 5 AS k UNION SELECT len(w) FROM iw WHERE len(w) BETWEEN 1 AND 4
), d AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM dw, k WHERE len(w) >= k
)
SELECT doc_id, item_id, count(*) AS shared, any_value(n.n) AS n_shingles
FROM d JOIN s USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil(any_value(n.n) * 0.8)
"""
