"""Operator 1: quality rules by cross-document line frequency.

Normalised lines are hashed and the distinct documents of each (line, host)
counted; the host is the source. A line held by more than
max(min_docs, share * documents of the host) documents is removed there from
all of them but the first (least doc_id). A document that keeps less than
min_left of the characters in its lines is depleted and rejected.

The base rules measure each text on its own: see `base_metrics`.

Defined cases: null text counts as empty (no words: base_failed); a null host
is a host of its own, a null doc_id a document of its own; very long texts are
measured whole; repeated rows are one document for the line counts and are
judged alike; an empty table gives an empty result; other columns, whatever
their names, pass through `kept_documents` and `edited_documents`. The latter
returns the texts without the lines; a line of the first document stays there
even where that document is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, as_rows, table, unpacked, with_windows, words_of, written

SYMBOLS = "[#*$%&|<>]"
#: White space but for space and line feed.
INNER = r"[\x09\x0B-\x0D]"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_DOCS = 20
SHARE = 0.01
MIN_LEFT = 0.3


def placed_windows(windows: Column) -> Column:
    """(hash, position) pairs in order of hash."""
    return F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_positions(placed: str) -> Column:
    """Sorted positions of the windows whose hash has an equal neighbour. placed: a column's name, since a lambda would compute an expression anew for every element."""

    def twice(x: Column, j: Column) -> Column:
        before = F.when(j > 0, F.get(F.col(placed), j - 1)["h"])
        after = F.get(F.col(placed), j + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    return F.array_sort(F.transform(F.filter(placed, twice), lambda x: x["i"]))


def union_length(at: Column) -> Column:
    """Length of the union of [i, i + window) over sorted positions."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-REPEAT_WINDOW).alias("last"))
    return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(REPEAT_WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])


def base_metrics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed: projections only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__words", words_of(F.col("text")))
    out = out.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    n = F.size("__words")
    out = with_windows(out, "__words", REPEAT_WINDOW, "__wins")
    repeats = F.size(F.array_distinct("__wins")) < F.size("__wins")
    out = out.withColumn("__placed", F.when(repeats, placed_windows(F.col("__wins"))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    out = out.withColumn("n_words", n.cast("long")).withColumn("word_chars", F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)))
    out = out.withColumn("n_symbols", F.when(text.rlike(SYMBOLS), F.size(F.split(text, SYMBOLS)) - 1).otherwise(0).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    out = out.withColumn("n_repeat_words", union_length(repeated_positions("__placed")).cast("long"))
    # a filter on these columns must not be pushed down into the expressions, where lambdas would compute columns anew; it stops at the explode
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = out.select(*docs.columns, F.explode(F.array(F.struct(*names))).alias("__m")).select(*docs.columns, *[F.col(f"__m.{x}").alias(x) for x in names])
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def line_hash(line: Column) -> Column:
    """The hash that document_lines gives to a line."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, f"( |{INNER})+", " "))))


def document_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc, host, h, chars): the distinct lines of each row that hold a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = F.lower(F.when(text.rlike(f"{INNER}| {{2}}"), F.regexp_replace(text, f"( |{INNER})+", " ")).otherwise(text))
    lines = F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    hashed = F.array_distinct(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("chars"))))
    return docs.select(F.struct(F.col("doc_id").alias("id")).alias("doc"), F.coalesce(F.col(host), F.lit("\u0000")).alias("host"), F.explode_outer(hashed).alias("l")).select("doc", "host", "l.h", "l.chars").where(F.col("h").isNotNull())


def depletion(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, host: str = "source") -> DataFrame:
    """(doc, left, gone): the share of the characters in its distinct lines that each document keeps, and the hashes of those it loses, where it loses any."""
    lines = written(document_lines(docs, host))
    counts = lines.groupBy("h", "host").agg(F.count_distinct("doc").alias("docs"), F.min("doc").alias("first_doc"))
    hosts = docs.groupBy(F.coalesce(F.col(host), F.lit("\u0000")).alias("host")).agg(F.count_distinct("doc_id").alias("in_host"))
    common = counts.where(F.col("docs") > min_docs).join(hosts, "host").where(F.col("docs") > F.ceil(F.col("in_host") * share)).select("h", "host", "first_doc")
    judged = lines.join(common, ["h", "host"], "left")
    gone = F.col("first_doc").isNotNull() & (F.col("doc") != F.col("first_doc"))
    sums = judged.groupBy("doc").agg(F.sum(F.when(gone, F.col("chars")).otherwise(0)).alias("lost"), F.sum("chars").alias("all"), F.collect_set(F.when(gone, F.col("h"))).alias("gone"))
    return sums.where(F.col("lost") > 0).select("doc", (1 - F.col("lost") / F.col("all")).alias("left"), "gone")


def judged(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, min_left: float = MIN_LEFT, host: str = "source", texts: bool = True, gone: bool = False) -> DataFrame:
    """row (docs as structs; of doc_id alone without texts), the base metrics, left_share and kept; gone: with gone_lines, the hashes of the lines above the limits."""
    names = [F.col("left").alias("left_share"), F.col("gone").alias("gone_lines")][: 1 + gone]
    slim = docs.select("doc_id", "text", F.col(host).alias("host"))
    left = depletion(slim, min_docs, share, "host").select(F.col("doc.id").alias("id"), *names)
    rows = as_rows(docs).select("row", F.col("row.text").alias("text")) if texts else docs.select(F.struct("doc_id").alias("row"), "text")
    base = base_metrics(rows).drop("text")
    out = base.join(left, F.col("row.doc_id").eqNullSafe(F.col("id")), "left").drop("id")
    out = out.withColumn("left_share", F.coalesce(F.col("left_share"), F.lit(1.0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("left_share") >= min_left))


def verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, min_left: float = MIN_LEFT, host: str = "source") -> DataFrame:
    """doc_id, the base metrics, left_share and kept of each row, without the texts."""
    out = judged(docs, min_docs, share, min_left, host, texts=False)
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "left_share", "kept")


def kept_documents(docs: DataFrame, **limits: float) -> DataFrame:
    """docs without the rejected rows; other columns pass through."""
    return unpacked(judged(docs, **limits).where("kept"), docs.columns)


def edited_documents(docs: DataFrame, **limits: float) -> DataFrame:
    """docs without the rejected rows, and their texts without the lines above the limits; other columns pass through."""
    out = judged(docs, gone=True, **limits).where("kept")
    lines = F.filter(F.split("row.text", "\n"), lambda x: ~F.array_contains("gone_lines", line_hash(x)))
    edited = F.when(F.col("gone_lines").isNull(), F.col("row.text")).otherwise(F.array_join(lines, "\n"))
    return unpacked(out, docs.columns, text=edited)


def op1_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).drop("left_share")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1
), cov AS (
  SELECT doc_id, sum(least(8, coalesce(i - p, 8))) AS n
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rep) GROUP BY doc_id
), l AS (
  SELECT DISTINCT doc_id, host, norm, length(norm) AS words
  FROM (SELECT doc_id, host, trim(regexp_replace(lower(unnest(ls)), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM d)
), hosts AS (
  SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY host
), common AS (
  SELECT norm, host, first_doc FROM (
    SELECT norm, host, count(DISTINCT doc_id) AS c, min(doc_id) AS first_doc FROM l GROUP BY norm, host
  ) JOIN hosts USING (host) WHERE c > 20 AND c > ceil(n * 0.01)
), lost AS (
  SELECT doc_id, sum(CASE WHEN first_doc IS NOT NULL AND first_doc <> doc_id THEN words ELSE 0 END) AS gone, sum(words) AS total
  FROM l LEFT JOIN common USING (norm, host) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(1 - gone / total, 1) AS left_share
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_share >= 0.3 AS kept
FROM m
"""
