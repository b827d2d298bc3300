"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import spread

#: ASCII white space, as a Java or RE2 character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    jsc = spark.sparkContext._jsc.sc()
    known = jsc.getCheckpointDir()
    if known.isDefined():
        return str(known.get())
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
    return str(jsc.getCheckpointDir().get())


#: Tables of written() that are not dropped yet, by the scratch() that they were made in.
_made: list[list[DataFrame]] = [[]]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path  # for drop()
    _made[-1].append(out)
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by written(), once nothing reads it any more."""
    path = getattr(df, "written_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        for tables in _made:
            tables[:] = [x for x in tables if x is not df]


@contextmanager
def scratch() -> Iterator[None]:
    """Drops at its end the tables written inside, which nothing may read after that."""
    _made.append([])
    try:
        yield
    finally:
        tables = list(_made[-1])
        for df in tables:
            drop(df)
        _made.pop()


def kept(df: DataFrame) -> DataFrame:
    """df written inside a scratch(), to stay after it."""
    out = written(df)
    _made[-2].append(_made[-1].pop())
    return out


def drop_all() -> None:
    """Delete every table that is left, when the results of all queries have been read."""
    for df in [x for tables in _made for x in tables]:
        drop(df)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df lacks."""
    taken = {x.lower() for x in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def as_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """df as one struct column, so that no helper column can clash with one of its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpacked(df: DataFrame, columns: list[str], name: str = "row", **changed: Column) -> DataFrame:
    """The columns of as_rows again, some of them changed."""
    return df.select(*[(changed[c] if c in changed else F.col(f"{name}.`{c}`")).alias(c) for c in columns])


def row_key() -> Column:
    """Rows with one key have the same doc_id and text; keys sort by id, null first, then by hash."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), F.length("text").alias("n"))


def one_row_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of docs for each row_key in keys (key)."""
    key, n = fresh(docs, "key"), fresh(docs, "n")
    kept = docs.withColumn(key, row_key()).join(keys.select(F.col("key").alias(key)), key, "left_semi")
    return kept.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))).where(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def words_of(text: Column) -> Column:
    """Words between ASCII white space; empty for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\u000b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \t\n\u000b\f\r]+"))


def with_windows(df: DataFrame, words: str, k: int, out: str) -> DataFrame:
    """df with 64-bit hashes of all runs of k words, in order, repeats included; empty for shorter texts.

    Runs are hashed by doubling: two hashes of runs of j make one of 2j. Each
    step is a column of its own, since Catalyst would otherwise compute the
    shared parts once for every use.
    """
    step = f"__run{k}_"
    df = df.withColumn(f"{step}1", F.transform(F.col(words), lambda w: F.xxhash64(w)))
    have, size, made = None, 1, [f"{step}1"]

    def joined(left: str, right: str, skip: int) -> Column:
        return F.zip_with(F.col(left), F.slice(F.col(right), skip + 1, F.greatest(F.size(right) - skip, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    while True:
        if k & size:
            if have is None:
                have = (f"{step}{size}", size)
            else:
                name = f"{step}sum{have[1] + size}"
                df = df.withColumn(name, joined(have[0], f"{step}{size}", have[1]))
                made.append(name)
                have = (name, have[1] + size)
        size *= 2
        if size > k:
            break
        df = df.withColumn(f"{step}{size}", joined(f"{step}{size // 2}", f"{step}{size // 2}", size // 2))
        made.append(f"{step}{size}")
    n = F.size(words) - (k - 1)
    return df.withColumn(out, F.when(n > 0, F.slice(F.col(have[0]), F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))).drop(*made)
