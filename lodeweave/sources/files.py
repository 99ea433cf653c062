"""Listings, tag files, cue sheets, subtitles, song lists and metainfo as DataFrames.

Texts are parsed where they lie: a folder is read as whole files by the executors and parsed in Arrow batches.
"""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SONGS = "song_no bigint, sources array<string>, album string, track int, audio string, cover string, lyrics string, lyrics_offset_ms bigint, tags map<string,array<string>>, release string"
TAG_ROWS = "path string, section int, name string, value string"
CUE_ROWS = "path string, file string, track int, title string, performer string, isrc string, start_ms bigint, length_ms bigint"


def song_list(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """songs, albums and removed of a TOML song list, each with its number: order is the last tie-break.

    A list is written by hand and read by the driver whole.
    """
    doc = tomllib.loads(text)
    many = lambda v: None if v is None else [str(x) for x in (v if isinstance(v, list) else [v])]
    tags = lambda d: {k.lower(): many(v) for k, v in (d or {}).items()}
    song = lambda i, s: (i, many(s.get("sources")) or [], s.get("album"), s.get("track"), s.get("audio"), s.get("cover"), s.get("lyrics"), s.get("lyrics_offset_ms"), tags(s.get("tags")), s.get("release"))
    albums = [(i, a.get("source"), a.get("tracks"), tags(a.get("tags"))) for i, a in enumerate(doc.get("album", []), 1)]
    removed = [(i, many(r.get("sources")) or [], r.get("note"), r.get("title"), r.get("artist"), tags(r.get("tags"))) for i, r in enumerate(doc.get("removed", []), 1)]
    return {
        "songs": spark.createDataFrame([song(i, s) for i, s in enumerate(doc.get("song", []), 1)], SONGS),
        "albums": spark.createDataFrame(albums, "album_no bigint, source string, tracks int, tags map<string,array<string>>"),
        "removed": spark.createDataFrame(removed, "removed_no bigint, sources array<string>, note string, title string, artist string, tags map<string,array<string>>"),
    }


def settings(text: str, known: dict[str, type], overrides: list[str] = ()) -> dict[str, object]:
    """'table.key' settings of a TOML text with overrides 'table.key=value'; unknown keys and wrong types are refused."""
    flat: dict[str, object] = {}

    def walk(d: dict, path: str) -> None:
        for k, v in d.items():
            if isinstance(v, dict):
                walk(v, f"{path}{k}.")
            else:
                flat[path + k] = v

    walk(tomllib.loads(text), "")
    for o in overrides:
        k, sep, v = o.partition("=")
        if not sep:
            raise ValueError(f"no value: {o}")
        try:
            flat[k] = tomllib.loads(f"v = {v}")["v"]
        except tomllib.TOMLDecodeError:
            flat[k] = v
    for k, v in flat.items():
        if k not in known:
            raise ValueError(f"no setting {k}")
        if not isinstance(v, known[k]) or (known[k] is int and isinstance(v, bool)):
            raise ValueError(f"{k} is no {known[k].__name__}")
    return flat


def migrate(flat: dict[str, object], renames: list[tuple[str, str]]) -> dict[str, object]:
    """Old settings under today's names; a name already there wins."""
    out = dict(flat)
    for old, new in renames:
        if old in out:
            out.setdefault(new, out.pop(old))
            out.pop(old, None)
    return out


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, name, length, mtime of the files below a folder, hidden ones left out; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.col("modificationTime").alias("mtime")).filter(~F.col("name").startswith("."))


def settled(files: DataFrame, listed: DataFrame, now: Column, wait_s: int) -> DataFrame:
    """Files no song lists, with ready: unchanged for the wait."""
    loose = files.join(listed.select("path"), "path", "left_anti")
    return loose.withColumn("ready", F.unix_timestamp(now) - F.unix_timestamp("mtime") >= wait_s)


def tag_format(path: Column, first_line: Column) -> Column:
    """json, ffmetadata or vorbis, by extension or the first line."""
    return F.when(F.lower(path).endswith(".json") | F.trim(first_line).startswith("{"), "json").when(F.lower(path).endswith(".ffmetadata") | first_line.startswith(";FFMETADATA"), "ffmetadata").otherwise("vorbis")


def parse_tags(path: str, text: str) -> list[tuple[int, str, str]]:
    """Section (0, or the chapter's), name in lower case and value of each tag of a tag file."""
    first = text.lstrip("﻿ \r\n").split("\n", 1)[0]
    if path.lower().endswith(".json") or first.startswith("{"):
        try:
            doc = json.loads(text)
        except ValueError:
            return []
        pairs = doc.items() if isinstance(doc, dict) else []
        return [(0, str(k).lower(), str(x)) for k, v in pairs for x in (v if isinstance(v, list) else [v]) if isinstance(x, (str, int, float)) and not isinstance(x, bool)]
    ff = path.lower().endswith(".ffmetadata") or first.startswith(";FFMETADATA")
    out, section, keep = [], 0, ""
    for line in text.lstrip("﻿").splitlines():
        if ff and line.endswith("\\"):
            keep += line[:-1] + "\n"
            continue
        line, keep = keep + line, ""
        if not line.strip() or (ff and line.startswith((";", "#"))) or (not ff and line.startswith("#")):
            continue
        if ff and line.startswith("["):
            section += 1
            continue
        name, sep, value = line.partition("=")
        if sep and name.strip():
            out.append((section, name.strip().lower(), re.sub(r"\\(.)", r"\1", value) if ff else value))
    return out


def parse_cue(text: str) -> list[tuple]:
    """file, track, title, performer, ISRC, start and length in ms; the last track of a file has no length. A second has 75 frames."""
    file, rows, track = "", [], None
    unquote = lambda s: s[1:-1] if len(s) > 1 and s[0] == s[-1] == '"' else s
    album_artist = None
    for raw in text.lstrip("﻿").splitlines():
        word, _, rest = raw.strip().partition(" ")
        rest, word = rest.strip(), word.upper()
        if word == "FILE":
            file, track = unquote(re.sub(r"\s+\w+$", "", rest)), None
        elif word == "TRACK" and (m := re.match(r"(\d+)", rest)):
            track = [file, int(m[1]), None, album_artist, None, None]
            rows.append(track)
        elif word == "TITLE" and track:
            track[2] = unquote(rest)
        elif word == "PERFORMER":
            if track:
                track[3] = unquote(rest)
            else:
                album_artist = unquote(rest)
        elif word == "ISRC" and track:
            track[4] = rest
        elif word == "INDEX" and track and (m := re.fullmatch(r"0?1 (\d+):(\d{2}):(\d{2})", rest)):
            track[5] = round((int(m[1]) * 60 + int(m[2])) * 1000 + int(m[3]) * 1000 / 75)
    out = []
    for i, r in enumerate(rows):
        n = rows[i + 1] if i + 1 < len(rows) else None
        length = n[5] - r[5] if n and n[0] == r[0] and n[5] is not None and r[5] is not None else None
        out.append((*r, length))
    return out


def _texts(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def tag_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, section, name, value of all tag files below a folder."""

    def batches(it):
        for df in it:
            yield pd.DataFrame([(p, *t) for p, x in zip(df["path"], df["text"], strict=True) for t in parse_tags(p, x)], columns=["path", "section", "name", "value"])

    return _texts(spark, folder, glob).mapInPandas(batches, TAG_ROWS)


def cue_sheets(spark: SparkSession, folder: str, glob: str = "*.cue") -> DataFrame:
    names = ["path", "file", "track", "title", "performer", "isrc", "start_ms", "length_ms"]

    def batches(it):
        for df in it:
            rows = pd.DataFrame([(p, *t) for p, x in zip(df["path"], df["text"], strict=True) for t in parse_cue(x)], columns=names)
            yield rows.astype({"track": "Int32", "start_ms": "Int64", "length_ms": "Int64"})

    return _texts(spark, folder, glob).mapInPandas(batches, CUE_ROWS)


def webvtt_cues(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, cue (from 1), start_ms, words of WebVTT texts, tags left out."""
    stamp = r"(?:(\d+):)?(\d{2}):(\d{2})\.(\d{3})"
    parts = df.select(key, F.posexplode(F.split(text, r"\r?\n\s*\r?\n")).alias("at", "part")).filter(F.col("part").rlike(rf"{stamp}\s+-->"))
    n = lambda i: F.coalesce(F.nullif(F.regexp_extract("part", stamp, i), F.lit("")).cast("bigint"), F.lit(0))
    words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("part", r"(?s)^.*?-->[^\n]*\n?", ""), r"<[^>]+>", ""), r"\s*\n\s*", " "))
    cue = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return parts.select(key, cue.alias("cue"), (n(1) * 3600000 + n(2) * 60000 + n(3) * 1000 + n(4)).alias("start_ms"), words.alias("words"))


def bencoded(data: bytes, at: int = 0):
    """The value at a place of a bencoded text, and where it ends."""
    c = data[at : at + 1]
    if c == b"i":
        end = data.index(b"e", at)
        return int(data[at + 1 : end]), end + 1
    if c in (b"l", b"d"):
        at, items = at + 1, []
        while data[at : at + 1] != b"e":
            v, at = bencoded(data, at)
            items.append(v)
        return (items if c == b"l" else dict(zip(items[::2], items[1::2], strict=True))), at + 1
    colon = data.index(b":", at)
    n = int(data[at:colon])
    return data[colon + 1 : colon + 1 + n], colon + 1 + n


def torrent_files(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, path, length of the files a metainfo names."""

    def batches(it):
        for b in it:
            rows = []
            for k, c in zip(b[key], b[content], strict=True):
                try:
                    info = bencoded(bytes(c))[0][b"info"]
                except (ValueError, KeyError, IndexError, TypeError):
                    continue
                text = lambda x: x.decode("utf-8", "replace")
                if b"files" in info:
                    rows += [(k, "/".join([text(info[b"name"]), *map(text, f[b"path"])]), f[b"length"]) for f in info[b"files"]]
                else:
                    rows.append((k, text(info[b"name"]), info[b"length"]))
            yield pd.DataFrame(rows, columns=[key, "path", "length"])

    return df.select(key, content).mapInPandas(batches, f"{key} {df.schema[key].dataType.simpleString()}, path string, length bigint")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 or UTF-16 by their mark or form, else the usual single-byte set."""

    def series(values: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            b = bytes(b)
            for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
                if b.startswith(mark):
                    return b.decode(name, "replace")
            try:
                return b.decode("utf-8")
            except UnicodeDecodeError:
                return b.decode("cp1252", "replace")

        return values.map(one)

    return F.pandas_udf(series, "string")(content)


def print_words(content: Column) -> Column:
    """Little-endian 32-bit words of raw bytes; null where they are none or not whole."""

    def series(values: pd.Series) -> pd.Series:
        import numpy as np

        return values.map(lambda b: None if b is None or not len(b) or len(b) % 4 else np.frombuffer(bytes(b), "<u4").astype("int64"))

    return F.pandas_udf(series, "array<bigint>")(content)


VIDEO = "id string, title string, track string, artists array<string>, artist string, creator string, album string, upload_date string, uploader string, channel string, duration double, webpage_url string"


def site_info(json_text: Column) -> Column:
    """A site's info JSON; a badly typed field loses that field only."""
    fields = [f.strip().split(" ", 1) for f in VIDEO.split(",")]
    v = F.try_parse_json(json_text)
    return F.when(v.isNotNull(), F.struct(*[F.try_variant_get(v, f"$.{n}", t).alias(n) for n, t in fields]))


def offers(info: DataFrame, key: str) -> DataFrame:
    """key, field, values of what upload rows say of the song: long form."""
    one = lambda c: F.when(F.trim(c) != "", F.array(c))
    channel = F.regexp_replace("channel", r" - Topic$", "")
    pairs = {
        "title": F.coalesce(one(F.col("track")), one(F.col("title"))), "artist": F.coalesce(F.when(F.size("artists") > 0, F.col("artists")), one(F.col("artist")), one(F.col("creator")), one(channel)),
        "album": one(F.col("album")), "genre": one(F.col("genre")), "date": F.coalesce(one(F.regexp_replace("release_date", r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")), one(F.col("release_year").cast("string"))),
    }
    m = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return info.select(key, F.explode(m).alias("field", "vals")).filter("vals IS NOT NULL")


def record_offers(records: DataFrame, key: str = "record_no") -> DataFrame:
    one = lambda c: F.when(F.trim(c) != "", F.array(c))
    r = "on_release."
    pairs = {"title": one(F.col("title")), "artist": F.when(F.size("artists") > 0, F.col("artists")), "isrc": F.when(F.size("isrcs") > 0, F.col("isrcs")), "album": one(F.col(r + "title")), "date": one(F.col(r + "release_date")), "label": one(F.col(r + "label")), "barcode": one(F.col(r + "barcode")), "releasecountry": one(F.col(r + "country")), "media": one(F.col(r + "media")), "catalognumber": one(F.col(r + "catalog_number"))}
    m = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return records.select(key, F.explode(m).alias("field", "vals")).filter("vals IS NOT NULL")


def merged_tags(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Each field from whichever of two readers found it, the first preferred."""
    b = second.select(*key, F.col("vals").alias("_v"))
    return first.join(b, key, "full").select(*key, F.coalesce("vals", "_v").alias("vals"))
