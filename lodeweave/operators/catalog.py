"""Catalog matching and the ranking of releases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import Name, agree
from ..functions.measures import date_key
from ..functions.text import exactness, is_mbid, letters_key
from .votes import argmin

# A catalog's secondary types of releases.
SECONDARY = ("Compilation", "Live", "Remix", "Soundtrack", "DJ-mix", "Mixtape/Street", "Demo", "Spokenword", "Interview", "Audiobook")
_KIND = {"Album": 0, "EP": 1, "Single": 2}


def release_class(types: Column, status: Column, credit: Column, own: Column) -> Column:
    """Own album before others', without a secondary type first, official first, album before EP before single."""
    kind = F.least(*[F.when(F.array_contains(types, k), v).otherwise(3) for k, v in _KIND.items()])
    return F.struct((~F.coalesce(credit == own, F.lit(False))).cast("int").alias("other"), F.arrays_overlap(types, F.array(*map(F.lit, SECONDARY))).cast("int").alias("secondary"), (~F.coalesce(status == "Official", F.lit(False))).cast("int").alias("unofficial"), kind.alias("kind"))


def best_release(records: DataFrame) -> DataFrame:
    """id, release_id, release_date: of the releases a recording was seen on, the first by class, date and ID."""
    r = records.filter("id IS NOT NULL AND on_release.id IS NOT NULL").select("id", F.col("on_release.id").alias("release_id"), F.when(F.trim("on_release.release_date") != "", F.col("on_release.release_date")).alias("release_date"), release_class(F.col("on_release.types"), F.col("on_release.status"), F.col("on_release.credit"), F.col("credit")).alias("c"))
    return argmin(r, ["id"], [F.col("c.other"), F.coalesce("c.secondary", F.lit(0)), F.col("c.unofficial"), F.col("c.kind"), date_key(F.col("release_date")), F.col("release_id")]).select("id", "release_id", "release_date")


def other_editions(records: DataFrame) -> DataFrame:
    """id, edition: other releases of the group of the best one."""
    seen = records.select("id", F.col("on_release.group_id").alias("g"), F.col("on_release.id").alias("edition")).filter("id IS NOT NULL AND edition IS NOT NULL").dropDuplicates()
    best = best_release(records).join(seen.withColumnRenamed("edition", "release_id"), ["id", "release_id"]).select("id", "g", "release_id")
    return seen.join(best, ["id", "g"]).filter("edition != release_id").select("id", "edition").dropDuplicates()


def first_release(records: DataFrame) -> DataFrame:
    """group_id, release_id: the earliest album of a group without a secondary type."""
    r = records.select(F.col("on_release.group_id").alias("group_id"), F.col("on_release.id").alias("release_id"), F.when(F.trim("on_release.release_date") != "", F.col("on_release.release_date")).alias("d"), F.col("on_release.types").alias("types"))
    r = r.filter("group_id IS NOT NULL AND release_id IS NOT NULL").filter(~F.coalesce(F.arrays_overlap("types", F.array(*map(F.lit, SECONDARY))), F.lit(False))).filter(F.array_contains("types", "Album"))
    return argmin(r, ["group_id"], [date_key(F.col("d")), F.col("release_id")]).select("group_id", "release_id")


def recording_rank(title: Column, wanted: Column, gap_ms: Column, secondary: Column, releases: Column, date: Column, comment: Column, ident: Column) -> list[Column]:
    """Order of catalog recordings for a wanted name."""
    return [exactness(title, wanted), F.when(releases > 0, 0).otherwise(1), F.coalesce(secondary, F.lit(0)), -releases, F.floor(gap_ms / 1000), date_key(date), F.when(comment == "", 0).otherwise(1), ident]


def print_rank(title: Column, wanted: Column, length: Column, artist_same: Column, prints: Column, secondary: Column, score: Column, ident: Column) -> list[Column]:
    """Order of recordings found by a print."""
    return [exactness(title, wanted), length, F.when(artist_same, 0).otherwise(1), -prints, secondary, -F.round(score * 1000), ident]


def other_mix(comment: Column, channels: Column) -> Column:
    """Whether a comment names the other mix than the audio."""
    c = F.lower(comment)
    return F.when(c.rlike(r"\bmono\b"), channels != 1).when(c.rlike(r"\bstereo\b"), channels != 2).otherwise(False)


def joined_credit(names: Column, joins: Column) -> Column:
    """Artists' names with the phrases that join them."""
    return F.array_join(F.zip_with(names, joins, lambda n, j: F.concat(n, F.coalesce(j, F.lit("")))), "")


def named(upload_title: Column, channel: Column, track: Column, artist: Column) -> Column:
    """The title carries the track's name, and the artist is the channel or in the title."""
    k = letters_key
    return F.contains(k(upload_title), k(track)) & (k(track) != "") & ((k(channel) == k(artist)) | F.contains(k(upload_title), k(artist)))


def is_release_upload(channel: Column) -> Column:
    return F.coalesce(channel.endswith(" - Topic"), F.lit(False))


def lucene_phrase(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))


# Fixed values (seconds): how far a print's length may be off, a catalog's, a lyrics record's; what a listed track's and a compared one's may.
PRINT_GAP, CATALOG_GAP, LYRICS_GAP, LISTED_GAP, COMPARED_GAP = 10.0, 3.0, 2.0, 3.0, 60.0
#: Sources a recording without a length needs to be taken for a print's.
UNTIMED_SOURCES = 2


def first_artist(credit: Column) -> Column:
    """The first of the artists that a credit joins with commas: the one a search asks for."""
    return F.trim(F.split(credit, ", ")[0])


def print_fits(ident: Column, seconds: Column, sources: Column, wanted_seconds: Column) -> Column:
    """A recording with a catalog ID, about as long as the print; without a length, one of several sources."""
    near = F.when(seconds.isNull(), F.coalesce(sources, F.lit(0)) >= UNTIMED_SOURCES).otherwise(F.abs(seconds - wanted_seconds) <= PRINT_GAP)
    return F.coalesce(is_mbid(ident) & near, F.lit(False))


def another_song(title: Column, names: Column, wanted_title: Column, wanted_artist: Column) -> Column:
    """Title and first artist both disagree with the wanted ones; false where either isn't known or can't be told."""

    def series(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        def one(title, names, wanted, artist):
            if not (title and names and wanted and artist):
                return False
            return agree(Name(title), Name(wanted)) is False and agree(Name(names), Name(artist)) is False

        return pd.Series([one(*r) for r in zip(a, b, c, d, strict=True)], dtype=bool)

    return F.pandas_udf(series, "boolean")(title, names, wanted_title, first_artist(wanted_artist))


def work_languages(rows: DataFrame, key: str, order: str, languages: str) -> DataFrame:
    """key, languages of all its rows, each once, in the order first seen. Keys without a language are left out."""
    long = rows.select(key, order, F.posexplode(languages).alias("_i", "_x")).filter("_x IS NOT NULL")
    first = long.groupBy(key, "_x").agg(F.min(F.struct(order, "_i")).alias("_p"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda x: x["_x"]).alias(languages))


def lyrics_fits(track: Column, artist: Column, seconds: Column, title: Column, wanted_artist: Column, wanted_seconds: Column) -> Column:
    """A lyrics record is the song's by its names and length."""
    return F.coalesce((F.abs(seconds - wanted_seconds) <= LYRICS_GAP) & (exactness(track, title) < 2) & (exactness(artist, wanted_artist) < 2), F.lit(False))


def lyrics_rank(track: Column, title: Column, synced: Column, seconds: Column, wanted_seconds: Column, ident: Column) -> list[Column]:
    """Order of lyrics records that fit: timed ones, the exacter title, the nearer length, the ID."""
    return [F.when(synced, 0).otherwise(1), exactness(track, title), F.abs(seconds - wanted_seconds), ident]


def lyrics_text(body: Column, seconds: Column) -> Column:
    """Lyrics as a file: the record's length as its first line, in place of one the lyrics state themselves."""
    cs = F.round(seconds * 100).cast("bigint")
    head = F.format_string("[length:%02d:%02d.%02d]\n", F.floor(cs / 6000), F.pmod(F.floor(cs / 100), F.lit(60)), F.pmod(cs, F.lit(100)))
    bare = F.regexp_replace(body, r"(?im)^\s*\[length:.*(?:\r?\n|\z)", "")
    return F.when(seconds.isNull(), body).otherwise(F.concat(head, F.coalesce(bare, F.lit(""))))


def upload_choice(pairs: DataFrame, track: str, upload: str, named_: str, length: str, wanted: str, channel: str, artist: str) -> DataFrame:
    """track, picked, compared, official: of each track's listed uploads the first that is named so and about as long, those whose sound is to be compared, and those of the artist's own channel.

    Each list is cut by the rules alone; a track without a named upload gives no row.
    """
    gap = F.abs(F.col(length) - F.col(wanted))
    own = F.contains(letters_key(F.col(channel)), letters_key(F.col(artist))) & (letters_key(F.col(artist)) != "")
    some = lambda test: F.array_sort(F.collect_set(F.when(test, F.col(upload))))
    out = pairs.filter(F.col(named_)).groupBy(track).agg(F.min(F.when(gap <= LISTED_GAP, F.col(upload))).alias("picked"), some(gap <= COMPARED_GAP).alias("_c"), some(own).alias("_o"))
    return out.select(track, "picked", F.array_join(F.col("_c").cast("array<string>"), ",").alias("compared"), F.array_join(F.col("_o").cast("array<string>"), ",").alias("official"))
