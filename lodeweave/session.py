"""Session settings, table reading and cutting of lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lodeweave").config("spark.driver.memory", memory)
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(cpus), **more}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written as a table in the shared checkpoint folder so that later stages don't compute them again.

    The folder is the one the session names in spark.checkpoint.dir. Where none is named, a session on one machine gets a
    temporary one; a cluster is refused, as its machines share no such folder. A table is compressed and read by column, unlike a checkpoint; it goes when the session
    ends, or with discard().
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodeweave-"))
    path = f"{context.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    # A compressed table looks far smaller than it is in memory, so its size is no ground for a broadcast.
    out = spark.read.schema(df.schema).parquet(path).hint("merge")
    out._cut = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the table of a cut() that nothing reads any more."""
    path = getattr(df, "_cut", None)
    if path:
        context = df.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
