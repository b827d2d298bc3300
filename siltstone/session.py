"""The session that the library expects."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "siltstone", **conf: str) -> SparkSession:
    """UTC timestamps, last-wins maps, adaptive execution; conf: further settings, dots as double underscores."""
    b = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.adaptive.enabled": "true"}
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpointing(spark: SparkSession) -> None:
    """Make checkpoint() work: in the folder that the cluster names, or in local mode in a temporary one."""
    import tempfile

    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if not named and not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltstone-"))


#: Bytes of a plan's input under which a shuffle costs more than idle cores.
SPREAD_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, where its files have fewer row groups than there are cores.

    For input whose rows are costly to work on. Tables of many files have more
    parts than cores and stay as they are; so do small ones.
    """
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES or "Exchange" in plan.executedPlan().toString():
        return df  # the parts of a plan with an exchange are only known once it runs
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if plan.toRdd().getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables on the way: the cluster's checkpoint folder."""
    checkpointing(spark)
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get())


#: Folders of stored() that are not dropped yet.
_stored: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: computed once, its lineage cut. drop_stored() deletes it."""
    path = f"{shared_dir(df.sparkSession)}/s-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def expire(path: str) -> str:
    """The path of a folder that drop_stored() is to delete."""
    _stored.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables of stored(), when the results of all queries have been read."""
    while _stored:
        delete(spark, _stored.pop())
