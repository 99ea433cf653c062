"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import diff_merge
from ..plans.terms import Term, output, predicate


def list_lines(views: DataFrame, terms: list[Term], template: str) -> DataFrame:
    """song_no, line of each view the query matches, in list order."""
    return views.filter(predicate(terms)).select("song_no", output(template).alias("line")).orderBy("song_no")


def save_diff(spark: SparkSession, folder: str, version: int, new: DataFrame, key: str) -> DataFrame:
    """Writes the next numbered snapshot of a table and returns what changed since the last one.

    A snapshot is only ever added, so a reader of an older one isn't disturbed, and a lost executor repeats its own tasks.
    """
    old = spark.read.parquet(f"{folder}/v={version}") if version else new.limit(0)
    changes = diff_merge(old, new, key).filter("action != 'keep'")
    new.write.mode("errorifexists").parquet(f"{folder}/v={version + 1}")
    return changes


def snapshot(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/v={version}")


def undo(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The snapshot before a run's."""
    return snapshot(spark, folder, max(1, version - 1))


def export(views: DataFrame, folder: str, by: str) -> None:
    """A partitioned copy, one folder for each value of a column of few values."""
    views.repartition(by).write.mode("errorifexists").partitionBy(by).parquet(folder)


def text_lines(lines: DataFrame, folder: str) -> None:
    lines.select(F.col("line").alias("value")).write.mode("errorifexists").text(folder)
