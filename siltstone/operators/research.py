"""Ingestion, plans, recommendations and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_ingest(staged: DataFrame, known: DataFrame, failures: DataFrame, most: int = 3) -> DataFrame:
    """(sha, action) of staged items: skip what is known by its hash, quarantine what failed `most` times, else ingest. staged, known: (sha), failures: one row (sha) each."""
    f = failures.groupBy("sha").agg(F.count("*").alias("_failed"))
    k = known.select("sha").distinct().withColumn("_known", F.lit(True))
    rows = staged.select("sha").distinct().join(k, "sha", "left").join(f, "sha", "left")
    action = F.when(F.col("_known"), "skip").when(F.coalesce("_failed", F.lit(0)) >= most, "quarantine").otherwise("ingest")
    return rows.select("sha", action.alias("action"))


def plan_progress(text: Column) -> Column:
    """struct(done, open, status) from the check boxes of a plan's text."""
    boxes = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"- \[( |x)\]"), 1)
    done, all_ = F.size(F.filter(boxes, lambda b: b == "x")), F.size(boxes)
    status = F.when(all_ == 0, "empty").when(done == all_, "done").when(done > 0, "active").otherwise("open")
    return F.struct(done.alias("done"), (all_ - done).alias("open"), status.alias("status"))


def recommended(signals: DataFrame, rejected: DataFrame, least: int = 3, sessions: int = 2) -> DataFrame:
    """(slug, times, sessions) of signals seen `least` times in `sessions` sessions; the rejected never return. signals: (slug, session)."""
    seen = signals.groupBy("slug").agg(F.count("*").alias("times"), F.count_distinct("session").alias("sessions"))
    return seen.where((F.col("times") >= least) & (F.col("sessions") >= sessions)).join(rejected.select("slug"), "slug", "left_anti")


def expired(items: DataFrame, ttl_seconds: dict[str, int], now: Column) -> DataFrame:
    """Items whose kind has a lifetime that is over and that nothing protects. items: (kind, ts, protected)."""
    life = F.coalesce(*[F.when(F.col("kind") == k, F.lit(s)) for k, s in ttl_seconds.items()])
    age = (F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return items.where(life.isNotNull() & (age > life) & ~F.coalesce("protected", F.lit(False)))


def package_hashes(sdist: Column, wheels: Column) -> Column:
    """The hashes of a package's source archive and wheels, those that are there."""
    return F.concat(F.array_compact(F.array(sdist)), F.filter(wheels, lambda w: w.isNotNull()))
