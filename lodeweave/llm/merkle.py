"""Copies hidden by formatting: bottom-up hashing of nested records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def normal_leaf(c: Column) -> Column:
    """A text leaf without letter case and without all but letters and digits. Null counts as empty."""
    return F.coalesce(alnum(c), F.lit(""))


def normal_bag(c: Column) -> Column:
    """The leaves of an array whose order doesn't matter, sorted. Null and empty arrays give null."""
    return F.when(F.size(c) > 0, F.array_sort(F.transform(c, normal_leaf)))


def leaf(c: Column) -> Column:
    return _digest(normal_leaf(c))


def exact_leaf(c: Column) -> Column:
    """Any value as it is; null has a digest of its own."""
    return _digest(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")))


def unordered(c: Column) -> Column:
    """A node whose children have no order: their digests are sorted before they are hashed."""
    children = F.array_sort(F.transform(c, lambda x: F.hex(leaf(x))))
    return _digest(F.array_join(children, "|"))


def node(*children: Column) -> Column:
    """A node of ordered children."""
    return _digest(F.concat(*children))


def copies(df: DataFrame, row_no: str, root: Column, structure: Column) -> DataFrame:
    """row_no, first_no and copies (the size of the group) of each row that has a copy.

    df: any rows; root: the digest of the record; structure: its normal form, which must be equal for rows to
    count as copies. Rows whose root is null stand alone. Rows of one digest but another structure (a
    collision) are grouped once more by the structure itself, so no group is wrong and none is lost.
    The group of a hot digest is never gathered: it is counted with partial sums, and each row meets
    one small row of its group. Ties: the smallest row_no is the first. Empty input gives no rows.
    """
    rows = df.select(F.col(row_no).alias("row_no"), root.alias("_root"), structure.alias("_form")).filter(F.col("_root").isNotNull())
    groups = (
        rows.groupBy("_root")
        .agg(F.min(F.struct("row_no", "_form")).alias("_first"), F.count("*").alias("copies"), F.max(F.xxhash64("_form")).alias("_hi"), F.min(F.xxhash64("_form")).alias("_lo"))
        .filter("copies > 1")
    )
    met = rows.join(groups, "_root")
    clean = F.col("_hi") == F.col("_lo")
    alike = F.col("_form").eqNullSafe(F.col("_first._form"))
    good = met.filter(clean & alike).select("row_no", F.col("_first.row_no").alias("first_no"), "copies")
    odd = met.filter(~(clean & alike)).select("row_no", "_root", "_form")
    again = odd.groupBy("_root", "_form").agg(F.min("row_no").alias("first_no"), F.count("*").alias("copies")).filter("copies > 1")
    rest = odd.join(again.withColumnsRenamed({"_root": "_r", "_form": "_f"}), (F.col("_root") == F.col("_r")) & F.col("_form").eqNullSafe(F.col("_f"))).select("row_no", "first_no", "copies")
    return good.unionByName(rest)


def video_copies(videos: DataFrame) -> DataFrame:
    texts, exact = ["title", "artist", "album", "channel"], ["upload_date", "duration_s"]
    held = videos.filter(normal_leaf(F.col("album")) != "").select("info_no", *texts, *exact)
    root = node(*[leaf(F.col(c)) for c in texts], *[exact_leaf(F.col(c)) for c in exact])
    return copies(held, "info_no", root, F.struct(*[normal_leaf(F.col(c)).alias(c) for c in texts], *exact))


def agreed_copies(agreed: DataFrame) -> DataFrame:
    held = agreed.filter(F.size("vals") > 0).select("agreed_no", "song_no", "field", "vals")
    root = node(exact_leaf(F.col("song_no")), exact_leaf(F.col("field")), unordered(F.col("vals")))
    return copies(held, "agreed_no", root, F.struct("song_no", "field", normal_bag(F.col("vals")).alias("vals")))


def found(videos: DataFrame, agreed: DataFrame) -> DataFrame:
    parts = [video_copies(videos).withColumn("tab", F.lit("video_infos")), agreed_copies(agreed).withColumn("tab", F.lit("agreed"))]
    both = reduce(DataFrame.unionByName, parts)
    return both.filter("row_no > first_no").select("tab", "first_no", "row_no")


def collapsed(videos: DataFrame, agreed: DataFrame) -> DataFrame:
    """Each record once, by its first row, with how many copies it had."""
    parts = []
    for tab, no, rows, groups in (("video_infos", "info_no", videos, video_copies(videos)), ("agreed", "agreed_no", agreed, agreed_copies(agreed))):
        all_rows = rows.select(F.col(no).alias("row_no"))
        kept = all_rows.join(groups, "row_no", "left").filter(F.col("first_no").isNull() | (F.col("first_no") == F.col("row_no")))
        parts.append(kept.select(F.lit(tab).alias("tab"), "row_no", F.coalesce("copies", F.lit(1)).alias("copies")))
    return reduce(DataFrame.unionByName, parts)
