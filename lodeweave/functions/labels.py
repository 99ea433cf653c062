"""Tests and readings of names, files, lyrics lines and languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UNSEEN, folded, letters_key, width_map, words

# Spellings of tag names and the one they stand for.
FIELD_NAMES = {
    "album artist": "albumartist", "album_artist": "albumartist", "year": "date", "tracknumber": "track", "track number": "track", "discnumber": "disc", "disc number": "disc", "tracktotal": "tracktotal", "totaltracks": "tracktotal",
    "organization": "label", "publisher": "label", "description": "comment", "releasedate": "date", "catalog number": "catalognumber", "upc": "barcode", "ean": "barcode", "bpm": "bpm", "tempo": "bpm", "tkey": "initialkey",
}
PLACEHOLDERS = ("unknown", "unknown artist", "unknown album", "unknown title", "untitled", "no artist", "no album", "no title", "no label", "[no label]", "[unknown]", "n/a", "none", "various", "track 1", "new folder")
_SECTION = r"verse|chorus|bridge|intro|outro|refrain|hook|pre-?chorus|interlude|solo|instrumental"


def whole_word(text: Column, entry: str) -> Column:
    """The entry's words stand in the text in a row as whole words."""
    text = F.translate(F.regexp_replace(text, UNSEEN, ""), *width_map())
    return F.contains(F.concat(F.lit(" "), F.array_join(words(folded(text)), " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(words(folded(F.lit(entry))), " "), F.lit(" ")))


def emoji(c: Column) -> Column:
    return c.rlike(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]")


def field_name(c: Column) -> Column:
    """Any spelling of a tag's name as its key."""
    k = F.lower(F.trim(c))
    table = F.create_map(*[x for a, b in FIELD_NAMES.items() for x in (F.lit(a), F.lit(b))])
    return F.coalesce(table[k], F.regexp_replace(k, r"[\s_]+", ""))


def placeholder(c: Column) -> Column:
    """A value that stands for none."""
    return F.lower(F.trim(c)).isin(*PLACEHOLDERS)


def soundtrack_credit(c: Column) -> Column:
    return c.rlike(r"(?i)\b(?:ost|o\.s\.t\.|original soundtrack)(?:\s+(?:vol\.?|part|pt\.?)\s*\d+)?\s*$")


def shows(c: Column) -> Column:
    """The text has a character one sees."""
    return c.rlike(r"[\p{L}\p{N}\p{P}\p{S}]")


def suffixed(stem: Column, more: Column) -> Column:
    return F.concat(stem, F.lit(" ["), more.cast("string"), F.lit("]"))


def portable_path(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"/+", "/")


def id_in_name(c: Column) -> Column:
    """The ID in brackets at the end of a file's stem, or a stem that is one; else null."""
    a = F.regexp_extract(c, r"\[([A-Za-z0-9_-]{6,})\](?:\.\w+)?$", 1)
    b = F.regexp_extract(c, r"^([A-Za-z0-9_-]{11})(?:\.\w+)?$", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def lyrics_cue(c: Column) -> Column:
    """A bracket's text names a section or a sound."""
    return F.lower(F.trim(c)).rlike(rf"^(?:{_SECTION})\b|^(?:music|applause|laughter|silence|humming)$")


def lyrics_credit(c: Column) -> Column:
    return c.rlike(r"(?i)^\s*(?:lyrics|music|words|written|composed|produced|lyricist|composer)(?: and (?:music|lyrics))?\s*(?:by\b|:)")


def sung(c: Column) -> Column:
    """The words sung: without stamps, cues, credits and blank lines."""
    lines = F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\[[^\]]*\]", "")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~lyrics_credit(x) & ~lyrics_cue(x)), "\n")


def language_fit(wanted: str, tag: Column) -> Column:
    """0 where the tag is the wanted one, 1 where it is of its language, else null: it isn't wanted."""
    w, t = wanted.lower(), F.lower(F.replace(tag, F.lit("_"), F.lit("-")))
    return F.when(t == w, 0).when(F.split(t, "-")[0] == w.split("-")[0], 1)


def language_role(tag: Column, sung_in: Column, latin: Column) -> Column:
    """original, romanization or translation of a song sung in a language."""
    same = F.split(F.lower(tag), "-")[0] == F.split(F.lower(sung_in), "-")[0]
    return F.when(same & (F.lower(tag).endswith("-latn") | latin) & ~F.split(F.lower(sung_in), "-")[0].isin("en", "de", "fr", "es", "it", "pt", "sv", "nl"), "romanization").when(same, "original").otherwise("translation")


def album_parts(c: Column) -> Column:
    """Name and disc of an album's text."""
    from .text import album_without_disc, disc_of_album

    return F.struct(F.trim(album_without_disc(c)).alias("name"), disc_of_album(c).alias("disc"))


def name_tags(c: Column) -> Column:
    """Bracketed tags of a release's name and what follows its last dash."""
    tags = F.transform(F.regexp_extract_all(c, F.lit(r"[(\[{]([^)\]}]+)[)\]}]"), 1), lambda x: F.trim(x))
    tail = F.regexp_extract(c, r"-([A-Za-z0-9]+)$", 1)
    return F.array_distinct(F.concat(tags, F.when(tail != "", F.array(tail)).otherwise(F.array().cast("array<string>"))))


def override_fields(title: Column, pattern: str) -> Column:
    """Fields of a title read by a pattern such as '%artist% - %title%'; null where it doesn't fit."""
    import re

    names = re.findall(r"%(\w+)%", pattern)
    parts = re.split(r"%\w+%", pattern)
    regex = "^" + "".join(re.escape(p) + ("(.+?)" if i < len(names) - 1 else "(.+)" if i < len(names) else "") for i, p in enumerate(parts)) + "$"
    return F.when(title.rlike(regex), F.struct(*[F.trim(F.regexp_extract(title, regex, i + 1)).alias(n) for i, n in enumerate(names)]))


def same_letters(a: Column, b: Column) -> Column:
    return letters_key(a) == letters_key(b)
