"""Sources: JSON-lines ledgers, JSON objects, archives, TOML, text lines, TSV, queue folders."""

from __future__ import annotations

import io
import tarfile
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_lines(spark: SparkSession, path: str, fields: dict[str, str], on_error: str = "fail") -> DataFrame:
    """A ledger with typed fields. A missing file is empty; blank lines and non-objects are skipped; a field of another type is null.

    Bad JSON fails with its file, or with on_error 'skip' is left out, or with 'flag' becomes a row whose _bad is true.
    """
    schema = ", ".join(f"`{k}` {t}" for k, t in fields.items())
    if not exists(spark, path):
        return spark.createDataFrame([], schema + (", _bad boolean" if on_error == "flag" else ""))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    if on_error == "fail":
        fine = F.assert_true(F.col("v").isNotNull(), F.concat(F.lit("bad JSON in "), F.col("file"))).isNull()
        parsed = parsed.where(fine)
    bad = F.col("v").isNull()
    objects = parsed.where(F.schema_of_variant("v").startswith("OBJECT") | (bad if on_error == "flag" else F.lit(False)))
    out = [F.try_variant_get("v", f"$['{k}']", t).alias(k) for k, t in fields.items()]
    return objects.select(*out, *([bad.alias("_bad")] if on_error == "flag" else []))


def json_object(spark: SparkSession, path: str) -> DataFrame:
    """One row with the variant `v` of a file that must hold a JSON object."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return whole.where(F.assert_true(is_object, F.lit(f"{path} must hold a JSON object")).isNull())


def installed_paths(spark: SparkSession, path: str, field: str = "files") -> DataFrame:
    """(path) of a manifest's list of installed paths. A missing or corrupt manifest, or another type in the field, gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string")
    whole = spark.read.text(path, wholetext=True).select(F.try_variant_get(F.try_parse_json("value"), f"$['{field}']", "array<string>").alias("p"))
    return whole.select(F.explode("p").alias("path")).where(F.col("path").isNotNull()).distinct()


def json_fragment(c):
    """The variant between the first { and the last } of a noisy text; null where that is no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")))


def toml(spark: SparkSession, text: str, table: str) -> DataFrame:
    """Rows of an array of tables in a TOML text, as JSON."""
    import json

    rows = tomllib.loads(text).get(table, [])
    return spark.createDataFrame([(json.dumps(r, sort_keys=True, default=str),) for r in rows], "value string")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, sha256) of all files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, mode, size, kind, sha256) of the members of tar archives, read on the executors."""
    import hashlib

    def members(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: list[tuple] = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        kind = "file" if m.isfile() else "dir" if m.isdir() else "other"
                        digest = hashlib.sha256(tar.extractfile(m).read()).hexdigest() if m.isfile() else None
                        rows.append((name, m.name, f"{m.mode & 0o777:04o}", m.size, kind, digest))
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["archive", "path", "mode", "size", "kind", "sha256"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInArrow(members, "archive string, path string, mode string, size long, kind string, sha256 string")


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line)."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def anchors(lines: DataFrame, width: int = 8) -> DataFrame:
    """Lines with the first hex digits of their hash."""
    return lines.withColumn("anchor", F.substring(F.sha2("line", 256), 1, width))


def sections(lines: DataFrame, key: str, header: str = r"^\[(.+)\]$") -> DataFrame:
    """Lines with the name of the section that they stand in; null before the first."""
    name = F.when(F.col("line").rlike(header), F.regexp_extract("line", header, 1))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(name, ignorenulls=True).over(w))


def fetched(spark: SparkSession, path: str, output_id: str, first: int | None = None, last: int | None = None, holding: str | None = None) -> DataFrame:
    """Lines of a stored output by its 16-hex id: a range, or those that hold a string."""
    import re

    if not re.fullmatch(r"[0-9a-f]{16}", output_id):
        raise ValueError("an output id has 16 hex digits")
    whole = spark.read.text(f"{path}/{output_id}.txt", wholetext=True).select(F.lit(output_id).alias("id"), F.substring("value", 1, 4 << 20).alias("text"))
    lines = numbered_lines(whole, "id", "text")
    if first is not None or last is not None:
        lines = lines.where(F.col("line_no").between(first or 1, last or 2**31 - 1))
    return lines.where(F.contains("line", F.lit(holding))) if holding is not None else lines


def experiment_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="commit string, metric double, status string, description string")


def chronicle(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").rlike(r"^## \["))


def queue_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Jobs of the pending, processing and dead folders; _bad marks malformed files, which count but never fail."""
    out = None
    fields = {"id": "string", "kind": "string", "attempts": "int", "lease_id": "string", "enqueued_at": "timestamp"}
    for state in ("pending", "processing", "dead"):
        jobs = json_lines(spark, f"{root}/{state}", fields, on_error="flag").withColumn("state", F.lit(state))
        out = jobs if out is None else out.unionByName(jobs)
    return out
