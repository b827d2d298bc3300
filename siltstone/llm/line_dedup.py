"""Operator 8: cross-site boilerplate lines by distinct-site spread.

A line is compared lower-cased, with runs of white space as one space. One
aggregation by line hash merges HyperLogLog sketches of the lines' sites, built
per task, and finds the first document. An estimate of more than `margin` above
min_sites decides by itself, one of more than `margin` below it as well; only
lines in between get an exact count of distinct sites. A line on min_sites sites
or more is removed from every document but the first (least doc_id) that holds
it, so no line vanishes from the corpus. Sketches of up to some hundred sites
are exact in practice, so `margin` is far wider than their error there.

Defined cases: null text counts as empty and stays null; very long texts are
edited whole; lines without a word are never removed; a null site is a site of
its own; rows with a null doc_id are one document, first only where no other
holds the line; repeated rows are edited alike; empty tables give empty results;
other columns, whatever their names, pass through `dedup_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, as_rows, table, unpacked, written

MIN_SITES = 10
MARGIN = 0.1
LG_K = 12
#: Line hashes that a join broadcasts at most: 16 bytes each.
BROADCAST = 200_000


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, f"[{SPACE}]+", " ")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def site_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """(doc, site, h): the distinct lines with a word of each row."""
    solid = F.filter(lines_of(F.col("text")), lambda x: x.rlike(f"[^{SPACE}]"))
    return docs.select(F.col("doc_id").alias("doc"), F.coalesce(F.col(site), F.lit("\u0000")).alias("site"), F.explode(F.array_distinct(F.transform(solid, line_hash))).alias("h"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(h, first_doc) of the lines on min_sites or more sites. lines: (doc, site, h)."""
    sketch = F.hll_sketch_agg(F.xxhash64("site"), LG_K)
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(sketch).alias("sites"), F.min("doc").alias("first_doc"))
    spread = written(spread.where(F.col("sites") >= int(min_sites * (1 - margin))))
    sure = F.col("sites") > min_sites * (1 + margin)
    near = held_by(lines, spread.where(~sure)).select("h", "site").distinct()
    exact = near.groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where(sure).select("h", "first_doc").unionByName(spread.where(~sure).select("h", "first_doc").join(exact.select("h"), "h", "left_semi"))


def held_by(lines: DataFrame, some: DataFrame) -> DataFrame:
    """lines joined to some of the hashes (h, first_doc). These travel to the lines where there are BROADCAST at most, so that the commonest line isn't gathered; beyond that the join sorts both, and Spark splits skewed hashes."""
    small = some.count() <= BROADCAST
    return lines.join(F.broadcast(some) if small else some, "h")


def removals(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, site: str = "source") -> DataFrame:
    """(row, n_lines, n_removed, text): docs as structs, and their texts without boilerplate lines."""
    rows = written(site_lines(docs, site))
    bad = written(boilerplate(rows, min_sites, margin))
    hits = held_by(rows, bad).where(~F.col("doc").eqNullSafe(F.col("first_doc"))).groupBy("doc").agg(F.collect_set("h").alias("bad"))
    out = as_rows(docs).select("row", F.col("row.doc_id").alias("id"))
    out = out.join(hits, F.col("id").eqNullSafe(F.col("doc")), "left")
    lines = lines_of(F.col("row.text"))
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("bad"), line_hash(x)) | ~x.rlike(f"[^{SPACE}]")))
    out = out.withColumn("kept", kept).withColumn("n_lines", F.when(F.col("row.text").isNotNull(), F.size(lines)).otherwise(0).cast("long"))
    removed = F.when(F.col("bad").isNotNull(), F.col("n_lines") - F.size("kept")).otherwise(0).cast("long")
    return out.select("row", "n_lines", removed.alias("n_removed"), F.when(F.col("bad").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("row.text")).alias("text"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, site: str = "source") -> DataFrame:
    """docs with their boilerplate lines gone."""
    return unpacked(removals(docs, min_sites, margin, site), docs.columns, text=F.col("text"))


def op8_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return removals(slim).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text"), 256).alias("text_sha256"))


OP8_SQL = """
WITH l AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, i, raw,
         lower(trim(regexp_replace(raw, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), bad AS (
  SELECT norm, min(doc_id) AS first_doc FROM l WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT site) >= 10
), k AS (
  SELECT l.*, (bad.norm IS NOT NULL AND l.doc_id <> bad.first_doc) AS gone FROM l LEFT JOIN bad ON l.norm = bad.norm
), t AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM k GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, length(text) AS n_chars_left, sha256(text) AS text_sha256 FROM t
"""
