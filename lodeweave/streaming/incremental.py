"""Incremental measuring and settling as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.incremental import unmeasured


def measure_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, key: list[str], method: str, measure: Callable[[DataFrame], DataFrame]):
    """Starts a query that measures new rows of a growing folder once for each revision and method.

    Each micro-batch leaves out what is measured already and appends the rest in a folder of its own number, so a batch
    run again after a failure writes over itself and nothing twice.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.withColumn("method", F.lit(method)).dropDuplicates([*key, "rev", "method"])
        try:
            done = spark.read.option("basePath", out).parquet(f"{out}/batch=*").filter(F.col("batch") != number)
        except Exception as e:  # nothing is measured yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        todo = unmeasured(rows, done, key, ["rev", "method"]) if done is not None else rows
        measure(todo).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settling(files: DataFrame, wait_ms: int) -> DataFrame:
    """path, settled_at (epoch ms) of files that haven't changed for a time.

    files: a stream of path, at (epoch ms of the change seen). Each change starts the wait anew; state is one number a file.
    """

    def step(k: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"path": [k[0]], "settled_at": [last + wait_ms]})
            return
        last = max([state.get[0]] if state.exists else [0])
        for b in batches:
            last = max(last, int(b["at"].max()))
        state.update((last,))
        state.setTimeoutDuration(wait_ms)

    return files.groupBy("path").applyInPandasWithState(step, "path string, settled_at bigint", "last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_stream(events: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """The latest time of each key in hourly windows, rows later than the bound left to the next batch run."""
    return events.withWatermark(at, late).groupBy(*key, F.window(at, "1 hour")).agg(F.max(at).alias("latest"), F.count("*").alias("n"))
