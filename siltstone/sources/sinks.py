"""Sinks: ledgers, canonical JSON, checksums, managed blocks, retention plans."""

from __future__ import annotations

import json
import os
import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def canonical_json(value: object) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def replace_file(path: str, text: str) -> None:
    """Whole or not at all, readable by the owner only."""
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(tmp, 0o600)
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise


def checksum_lines(files: DataFrame) -> DataFrame:
    """'sha256  path' lines in order of path."""
    return files.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))


def managed_block(text: str, block: str, begin: str, end: str) -> str:
    """text with the block between the markers replaced or appended. Incomplete markers fail."""
    if text.count(begin) != text.count(end) or text.count(begin) > 1:
        raise ValueError("incomplete markers of the managed block")
    if begin in text and text.index(begin) > text.index(end):
        raise ValueError("the managed block ends before it begins")
    rest = re.sub(rf"\n*{re.escape(begin)}.*?{re.escape(end)}\n*", "\n", text, flags=re.S).rstrip("\n")
    return (rest + "\n\n" if rest else "") + f"{begin}\n{block.strip()}\n{end}\n"


def top_lines(scores: DataFrame, n: int = 3, limit: int = 600) -> DataFrame:
    """At most n lines of context, limit characters in all."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    line = F.format_string("- %s (confidence=%.2f, risk=%.2f, budget=%d)", "candidate", "confidence", "risk", "token_budget")
    top = scores.where(F.col("rank") <= n).select("rank", line.alias("line"))
    return top.withColumn("chars", F.sum(F.length("line") + 1).over(w)).where(F.col("chars") <= limit).select("rank", "line")


def beyond_rank(df: DataFrame, group: list[str], newest: list[Column], keep: int) -> DataFrame:
    """Rows past the `keep` newest of each group; 0 disables pruning."""
    if keep <= 0:
        return df.limit(0)
    w = Window.partitionBy(*group).orderBy(*newest)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > keep).drop("_r")


def within_bytes(df: DataFrame, group: list[str], newest: list[Column], size: Column, cap: int) -> DataFrame:
    """The newest rows of each group whose sizes add up to cap bytes at most."""
    w = Window.partitionBy(*group).orderBy(*newest).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_bytes", F.sum(size).over(w)).where(F.col("running_bytes") <= cap)
