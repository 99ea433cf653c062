"""Albums, releases, spellings and covers agreed among songs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .sequences import gated_level
from .votes import argmin, majority


def unit_releases(options: DataFrame, unit: str, song: str, release: str, order: list[Column], share: float = 0.6) -> DataFrame:
    """unit, release, songs: of the releases that hold so much of a unit's songs, the one most are on, then the first by order.

    options: unit, song, release and what order needs, one row for each release a song can be on.
    """
    size = options.groupBy(unit).agg(F.count_distinct(song).alias("_n"))
    held = options.groupBy(unit, release).agg(F.count_distinct(song).alias("songs"), *[F.min(o).alias(f"_o{i}") for i, o in enumerate(order)])
    good = held.join(size, unit).filter(F.col("songs") >= share * F.col("_n"))
    return argmin(good, [unit], [-F.col("songs"), *[F.col(f"_o{i}") for i in range(len(order))], F.col(release)]).select(unit, release, "songs")


def settled_release(options: DataFrame, unit: str, song: str, release: str, share: float = 0.6) -> DataFrame:
    """unit, release, songs of units that are on one release already."""
    n = options.groupBy(unit).agg(F.count_distinct(song).alias("_n"))
    return options.filter(F.col(release).isNotNull()).groupBy(unit, release).agg(F.count_distinct(song).alias("songs")).join(n, unit).filter(F.col("songs") >= share * F.col("_n")).select(unit, release, "songs")


def greedy_units(members: DataFrame, album: str, unit: str, song: str) -> DataFrame:
    """album, unit, song: units by size then key, a song used once; each album is a small group of its own."""
    schema = members.select(album, unit, song).schema

    def one(df: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        groups = sorted(((-len(set(g[song])), k, sorted(set(g[song]))) for k, g in df.groupby(unit)), key=lambda x: (x[0], x[1]))
        for _, k, songs in groups:
            left = [s for s in songs if s not in used]
            used.update(left)
            out += [(df[album].iloc[0], k, s) for s in left]
        return pd.DataFrame(out, columns=[album, unit, song])

    return members.select(album, unit, song).groupBy(album).applyInPandas(one, schema)


def artist_spelling(credits: DataFrame, artist: str, spelling: str, latin: Column | None = None) -> DataFrame:
    """artist, spelling of the most records' spelling in the wanted script; ties are kept."""
    if latin is not None:
        credits = credits.filter(latin)
    n = credits.groupBy(artist, spelling).agg(F.count("*").alias("records"))
    top = n.groupBy(artist).agg(F.max("records").alias("records"))
    return n.join(top, [artist, "records"]).select(artist, spelling, "records")


def folder_vote(songs: DataFrame, album: str, path: str) -> DataFrame:
    """album with its most common folder."""
    return majority(songs.select(album, F.regexp_replace(path, r"/[^/]*$", "").alias("folder")), [album], "folder")


def cover_holder(songs: DataFrame, path: str, album: str) -> DataFrame:
    """folder with the first song by path of the album most of its songs are of."""
    s = songs.withColumn("folder", F.regexp_replace(path, r"/[^/]*$", ""))
    most = majority(s, ["folder"], album).select("folder", album)
    return argmin(s.join(most, ["folder", album]).select("folder", path), ["folder"], [F.col(path)])


def design_vote(looks: DataFrame, group: str, key: str, dct: str, diff: str, width: str) -> DataFrame:
    """group with the sharpest picture of its largest set of alike ones; looks of one group are few and compared among
    themselves through bands of the hash, so that pictures far apart don't meet."""
    a = looks.select(group, F.col(key).alias("ka"), F.col(dct).alias("da"), F.col(diff).alias("fa"))
    b = looks.select(group, F.col(key).alias("kb"), F.col(dct).alias("db"), F.col(diff).alias("fb"))
    band = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.concat_ws(":", i.cast("string"), F.substring(F.lpad(F.hex(c), 16, "0"), i + 1, F.lit(1)))))
    met = a.withColumn("band", band(F.col("da"))).join(b.withColumn("band", band(F.col("db"))), [group, "band"]).filter("ka < kb").select(group, "ka", "kb", "da", "db", "fa", "fb").dropDuplicates([group, "ka", "kb"])
    alike = met.filter((F.bit_count(F.col("da").bitwiseXOR(F.col("db"))) <= 10) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= 10))
    label = components(alike.select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    each = looks.join(label.withColumnRenamed("node", key), key, "left").withColumn("design", F.coalesce("label", key))
    size = each.groupBy(group, "design").agg(F.count("*").alias("n"), F.max(width).alias("sharpest"), F.min(key).alias("first"))
    best = argmin(size, [group], [-F.col("n"), -F.col("sharpest"), F.col("first")]).select(group, "design", "n")
    return argmin(each.join(best, [group, "design"]), [group], [-F.col(width), F.col(key)]).select(group, key, "design")


def album_levels(hist: DataFrame, peaks: DataFrame, album: str) -> DataFrame:
    """album, level, peak: loudness pooled over all songs of the album and the greatest peak."""
    return gated_level(hist, [album]).join(peaks.groupBy(album).agg(F.max("peak").alias("peak")), album, "left")


def median_speed(pairs: DataFrame, source: str, ppm: str) -> DataFrame:
    """source with the median of its stretches against others, to whole parts per million."""
    return pairs.groupBy(source).agg(F.floor(F.median(ppm)).cast("bigint").alias("ppm"))


def recording_choice(groups: DataFrame, song: str, group: str) -> DataFrame:
    """song, group: the group a record fits, else the most whole one, else the one of most sources; only a single leader counts.

    groups: song, group, fits, whole, sources.
    """
    rank = F.struct(F.col("fits").cast("int"), F.col("whole").cast("int"), F.col("sources"))
    r = groups.withColumn("_r", rank)
    top = r.groupBy(song).agg(F.max("_r").alias("_r"))
    return r.join(top, [song, "_r"]).groupBy(song).agg(F.min(group).alias(group), F.count("*").alias("_n")).filter("_n = 1").select(song, group)
