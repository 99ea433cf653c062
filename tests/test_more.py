"""Readings of names and lines, albums, measures and templates."""

import numpy as np
from pyspark.sql import functions as F

from lodeweave.functions import labels as L
from lodeweave.operators import albums, media
from lodeweave.plans import templates


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_labels(spark):
    lit = F.lit
    assert one(spark, L.whole_word(lit("An Owl’s Éclair"), "eclair"), L.whole_word(lit("Owls"), "owl"), L.field_name(lit("Album Artist")), L.field_name(lit("My Field")), L.placeholder(lit(" Unknown Artist "))) == (True, False, "albumartist", "myfield", True)
    assert one(spark, L.soundtrack_credit(lit("X OST Vol. 2")), L.shows(lit(" ​ ")), L.id_in_name(lit("A [abc_DEF-123].opus")), L.id_in_name(lit("x.opus")), L.emoji(lit("a🎵"))) == (True, False, "abc_DEF-123", None, True)
    assert one(spark, L.sung(lit("[00:01.00]La\nLyrics by X\n[Chorus]\nlo")), L.language_fit("pt-br", lit("pt_PT")), L.language_fit("pt", lit("en")), L.language_role(lit("ja-Latn"), lit("ja"), lit(True)), L.language_role(lit("en"), lit("ja"), lit(True))) == ("La\nlo", 1, None, "romanization", "translation")
    assert one(spark, L.override_fields(lit("Bo - A - B"), "%artist% - %title%"), L.override_fields(lit("Bo"), "%artist% - %title%"), L.name_tags(lit("A (FLAC) [2001]-GRP")), L.portable_path(lit("a\\b//c"))) == (("Bo", "A - B"), None, ["FLAC", "2001", "GRP"], "a/b/c")
    assert one(spark, L.album_parts(lit("X (CD 3)")), L.lyrics_cue(lit("Verse 2")), L.suffixed(lit("a"), lit(3))) == (("X", 3), True, "a [3]")


def test_units(spark):
    o = spark.createDataFrame([("u", s, r) for s in range(5) for r in ("A", "B") if r == "A" or s < 2], "unit string, song int, release string")
    assert [tuple(r) for r in albums.unit_releases(o, "unit", "song", "release", []).collect()] == [("u", "A", 5)]
    assert albums.settled_release(o.filter("release = 'B' OR song > 1"), "unit", "song", "release").collect()[0]["release"] == "A"
    m = spark.createDataFrame([("al", "u1", s) for s in (1, 2, 3)] + [("al", "u2", s) for s in (3, 4)], "album string, unit string, song int")
    assert {tuple(r)[1:] for r in albums.greedy_units(m, "album", "unit", "song").collect()} == {("u1", 1), ("u1", 2), ("u1", 3), ("u2", 4)}
    c = spark.createDataFrame([("a", "X"), ("a", "X"), ("a", "Y"), ("a", "Y"), ("a", "Z")], "id string, s string")
    assert {r["s"] for r in albums.artist_spelling(c, "id", "s").collect()} == {"X", "Y"}
    p = spark.createDataFrame([("f/a", "A"), ("f/b", "B"), ("f/c", "B")], "path string, album string")
    assert [tuple(r) for r in albums.cover_holder(p, "path", "album").collect()] == [("f", "f/b")]
    assert [tuple(r) for r in albums.folder_vote(p, "album", "path").orderBy("album").collect()] == [("A", "f", 1), ("B", "f", 2)]
    g = spark.createDataFrame([(1, "x", True, False, 1), (1, "y", False, True, 9), (2, "p", False, False, 3), (2, "q", False, False, 3)], "song int, g string, fits boolean, whole boolean, sources int")
    assert [tuple(r) for r in albums.recording_choice(g, "song", "g").collect()] == [(1, "x")]
    looks = spark.createDataFrame([(1, 1, 0b1111, 7, 100), (1, 2, 0b1110, 7, 300), (1, 3, -1, -1, 900)], "grp int, k int, dct bigint, diff bigint, w int")
    assert [tuple(r) for r in albums.design_vote(looks, "grp", "k", "dct", "diff", "w").collect()] == [(1, 2, 1)]


def test_media(spark):
    lit = F.lit
    assert one(spark, media.integrity(lit(100000), lit(50000), lit(0)), media.integrity(lit(100000), lit(99500), lit(6000)), media.integrity(lit(None).cast("int"), lit(1), lit(0)), media.packet_bytes(lit("12\n30\nx"))) == ("cut", "padded", None, 42)
    ch = F.array(F.struct(lit(0).alias("start"), lit(10).alias("end"), lit("a").alias("title")), F.struct(lit(50).alias("start"), lit(90).alias("end"), lit("b").alias("title")))
    assert [tuple(x) for x in one(spark, media.chapters_within(ch, lit(60)))[0]] == [(0, 10, "a"), (50, 60, "b")]
    t = np.arange(8192) / 44100
    df = spark.createDataFrame([(1, np.sin(2 * np.pi * 5000 * t).tolist(), 44100), (2, None, 1)], "k int, s array<double>, r int")
    (k, hz, clip), = [tuple(r) for r in media.sound_measures(df, "k", "s", "r").collect()]
    assert k == 1 and abs(hz - 5000) < 30 and clip < 0.05
    px = (np.add.outer(np.arange(64), np.arange(64)) % 97).ravel().tolist()
    same = [min(255, x + 3) for x in px]
    got = {r["k"]: r for r in media.picture_measures(spark.createDataFrame([(1, px, 64), (2, same, 64), (3, [5] * 4096, 64), (4, None, 4)], "k int, p array<int>, w int"), "k", "p", "w").collect()}
    assert got[1]["dct"] == got[2]["dct"] and got[3]["flat"] and 4 not in got


def test_templates(spark):
    v = spark.createDataFrame([({"title": ["A/B"], "artist": ["X", "Y"]}, ["yt:1"]), ({}, [])], "tags map<string,array<string>>, keys array<string>")
    v = v.withColumns({"path": F.lit("p"), "cover": F.lit(True), "soft_cover": F.lit(False), "lyrics": F.lit(False), "timed": F.lit(False), "given": F.array().cast("array<string>"), "from": F.array().cast("array<string>")})
    assert [r["p"] for r in v.select(templates.path_stem("{albumartist|artist}/{title}").alias("p")).collect()] == ["X, Y/A_B", "Unknown/Unknown"]
    verdict = templates.lookup_verdict([["title:a"]], [["lyrics:yes"]], {"yt"}, F.lit(False), F.lit(True), F.lit(False))
    assert [r["x"] for r in v.select(verdict.alias("x")).collect()] == ["skip", "wait"]
    s = spark.createDataFrame([(1, 0)], "k int, n int")
    assert templates.rounds(s, lambda d: d.withColumn("n", F.least(F.col("n") + 1, F.lit(2))), 5).first()["n"] == 2
    o = templates.overridden(spark.createDataFrame([("g", "t"), ("h", "t")], "ch string, title string"), spark.createDataFrame([("g", ["title"])], "ch string, drops array<string>"), "ch", ["title"])
    assert {tuple(r) for r in o.collect()} == {("g", None), ("h", "t")}
