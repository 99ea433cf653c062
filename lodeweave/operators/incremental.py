"""Incremental behaviour: stamps, diff merges, backoff, history, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import backoff_s, recheck_s


def unmeasured(sources: DataFrame, measured: DataFrame, key: list[str], stamps: list[str]) -> DataFrame:
    """Sources no measure of the same stamps (revision, method) stands for."""
    return sources.join(measured.select(*key, *stamps).dropDuplicates(), [*key, *stamps], "left_anti")


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def diff_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, action of each row of either side: insert, update, delete or keep. Rows are compared by digest alone."""
    rest = [c for c in new.columns if c != key]
    a = old.select(F.col(key), row_digest(rest).alias("_a"))
    b = new.select(F.col(key), row_digest(rest).alias("_b"))
    met = a.join(b, key, "full")
    return met.select(key, F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.col("_a") != F.col("_b"), "update").otherwise("keep").alias("action"))


def merged(old: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """The union of two caches, the latest row of each key."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max(F.struct(F.col(at).alias("_at"), F.struct(*rest).alias("_row"))).alias("_m")).select(*key, "_m._row.*")


def due(failures: DataFrame, now: Column) -> DataFrame:
    """Failures (count, last in epoch seconds) whose wait is over."""
    return failures.withColumn("due_at", F.col("last") + backoff_s(F.col("count"))).filter(F.col("due_at") <= now)


def lookup_due(outcome: Column, at: Column, failures: Column, unchanged: Column, recheck: int) -> Column:
    """When a lookup is made again: failed ones back off, missing ones after the recheck, short ones after a growing recheck, others never."""
    return F.when(outcome == "failed", at + backoff_s(failures)).when(outcome == "missing", at + F.lit(recheck)).when(outcome == "short", at + recheck_s(unchanged, recheck))


def per_run(df: DataFrame, provider: str, order: list[str], most: int) -> DataFrame:
    """At most so many rows of each provider, the rest later."""
    w = Window.partitionBy(provider).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def history_budget(runs: DataFrame, run: str, size: str, most: int) -> DataFrame:
    """runs with kept: the newest runs whose sizes fit the budget together. Runs are few, one row each."""
    w = Window.orderBy(F.desc(run)).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("kept", F.sum(size).over(w) <= most)


def redo(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """What of a plan is made again: build where a built part changed, else tag, else sidecars, else nothing."""
    differs = lambda parts: reduce(lambda a, b: a | b, [~old[p].eqNullSafe(new[p]) for p in parts], F.lit(False))
    groups = {"build": [p for p in new if p.startswith("audio")], "tag": [p for p in new if p.startswith("tag")], "sidecars": [p for p in new if p.startswith("side")]}
    out = F.when(differs(groups["build"]), "build")
    for name in ("tag", "sidecars"):
        out = out.when(differs(groups[name]), name)
    return out.otherwise("nothing")


def song_verdicts(songs: DataFrame, outputs: DataFrame, key: str, stamp: str, path: str) -> DataFrame:
    """key, verdict of each song against what was written: new, changed, moved or kept; outputs without a song are left."""
    a = songs.select(key, F.col(stamp).alias("_s"), F.col(path).alias("_p"), F.lit(True).alias("_song"))
    b = outputs.select(key, F.col(stamp).alias("_t"), F.col(path).alias("_q"), F.lit(True).alias("_out"))
    met = a.join(b, key, "full")
    v = F.when(F.col("_out").isNull(), "new").when(F.col("_song").isNull(), "left").when(~F.col("_s").eqNullSafe(F.col("_t")), "changed").when(~F.col("_p").eqNullSafe(F.col("_q")), "moved").otherwise("kept")
    return met.select(key, v.alias("verdict"))


def released(new: DataFrame, old: DataFrame, drifted: DataFrame, key: str) -> DataFrame:
    """Rows as built before where their source drifted and isn't accepted yet, else as new."""
    held = drifted.select(key).dropDuplicates()
    return new.join(held, key, "left_anti").unionByName(old.join(held, key, "left_semi"))


def separate_paths(df: DataFrame, path: str, ident: str, order: str) -> DataFrame:
    """Rows of one folded path told apart: the first keeps it, the next gets its ID, rows equal even so a number."""
    w = Window.partitionBy(F.upper(path)).orderBy(order, ident)
    one = df.withColumn("_r", F.row_number().over(w)).withColumn("path_out", F.when(F.col("_r") == 1, F.col(path)).otherwise(F.concat(F.col(path), F.lit(" ["), F.col(ident).cast("string"), F.lit("]"))))
    v = Window.partitionBy(F.upper("path_out")).orderBy(order, ident)
    two = one.withColumn("_q", F.row_number().over(v))
    return two.withColumn("path_out", F.when(F.col("_q") == 1, F.col("path_out")).otherwise(F.concat("path_out", F.lit(" "), F.col("_q").cast("string")))).drop("_r", "_q")
