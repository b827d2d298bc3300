"""Evidence scoring of captured events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

#: Words that speak for, against, or of risk.
POSITIVE = ["adopt", "pass", "passed", "success", "verified", "repeat", "repeated", "useful", "saved"]
NEGATIVE = ["fail", "failed", "broken", "stale", "noisy", "reject", "regression"]
RISKY = ["secret", "credential", "token", "oauth", "billing", "production", "prod", "deploy", "destructive", "delete", "remote"]


def scored(events: DataFrame) -> DataFrame:
    """One row per candidate, unrounded. events: (event, source, candidate, signal, note, tags, token_estimate, confidence_hint, risk_hint).

    Hints are averaged where present (0.5 and 0.25 where none is); estimates
    count where positive. One shuffle, on the candidate.
    """
    words = T.word_set(F.concat_ws(" ", "event", "source", "candidate", "signal", "note", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    own = events.select(T.candidate_key(F.col("candidate"), F.col("signal"), F.col("note")).alias("candidate"), words.alias("bag"), "token_estimate", "confidence_hint", "risk_hint")
    sums = own.groupBy("candidate").agg(
        F.count("*").alias("events"),
        F.sum(T.hits(F.col("bag"), POSITIVE)).alias("pos"),
        F.sum(T.hits(F.col("bag"), NEGATIVE)).alias("neg"),
        F.sum(T.hits(F.col("bag"), RISKY)).alias("risky"),
        F.avg("confidence_hint").alias("ch"),
        F.avg("risk_hint").alias("rh"),
        F.avg(F.when(F.col("token_estimate") > 0, F.col("token_estimate"))).alias("tokens"),
    )
    volume = F.least(F.col("events"), F.lit(5)) / 5
    balance = (F.col("pos") - F.col("neg")) / F.greatest(F.col("pos") + F.col("neg"), F.lit(1))
    confidence = T.clamp(0.35 + 0.25 * volume + 0.25 * balance + 0.15 * F.coalesce("ch", F.lit(0.5)))
    risk = T.clamp(0.15 + 0.2 * F.col("neg") + 0.25 * F.col("risky") + 0.25 * F.coalesce("rh", F.lit(0.25)))
    out = sums.withColumn("confidence", confidence).withColumn("risk", risk)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("pos") > 0, F.concat(F.lit("positive_signals="), F.col("pos"))),
            F.when(F.col("neg") > 0, F.concat(F.lit("negative_signals="), F.col("neg"))),
            F.when(F.col("risky") > 0, F.concat(F.lit("risk_terms="), F.col("risky"))),
            F.when(F.col("ch").isNotNull(), F.lit("confidence_hint")),
            F.when(F.col("rh").isNotNull(), F.lit("risk_hint")),
        )
    )
    return out.select(
        "candidate",
        "events",
        T.token_budget(F.coalesce("tokens", 800 + 250 * F.col("events"))).alias("token_budget"),
        "confidence",
        "risk",
        F.when((F.col("confidence") >= 0.65) & (F.col("risk") <= 0.45), "promote").otherwise("reject").alias("decision"),
        F.slice(F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("insufficient_signal"))), 1, 4).alias("reasons"),
    )


def ranked(scores: DataFrame, candidate: str | None = None, limit: int = 10) -> DataFrame:
    """Promoted first, then by confidence, risk and name; limit of 0 or less means all."""
    rows = scores if candidate is None else scores.where(F.col("candidate") == candidate)
    order = [F.asc(F.when(F.col("decision") == "promote", 0).otherwise(1)), F.desc("confidence"), F.asc("risk"), F.asc("candidate")]
    rows = rows.orderBy(*order)
    return rows.limit(limit) if limit > 0 else rows
