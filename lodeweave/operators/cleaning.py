"""Cleaning pipelines: ordered, switchable rules over tags and over timed lines, naming those that changed a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# The names of rules.
Rule = tuple[str, Callable[[Column, dict[str, Column]], Column]]
_TAIL = r"(?i)\s*[(\[]\s*(?:{})\s*[)\]]\s*$"


def _strip(words: str):
    return lambda c, _: F.regexp_replace(c, _TAIL.format(words), "")


def _restated(c: Column, ctx: dict[str, Column]) -> Column:
    # 'Title (Title)' and 'Title - Title' say the name twice.
    return F.regexp_replace(c, r"(?i)^(.+?)\s*(?:[(\[]\1[)\]]|-\s*\1)\s*$", "$1")


def _title_artist(c: Column, ctx: dict[str, Column]) -> Column:
    head = F.regexp_extract(c, r"^(.+?)\s+[-–—:|]\s+(.+)$", 1)
    rest = F.regexp_extract(c, r"^(.+?)\s+[-–—:|]\s+(.+)$", 2)
    artist = ctx.get("artist", F.lit(None).cast("string"))
    return F.when((rest != "") & (T.letters_key(head) == T.letters_key(artist)), rest).otherwise(c)


# What a channel's name adds to its owner's.
CHANNEL_SUFFIXES = ("official youtube channel", "official channel", "official", "vevo", "オフィシャルチャンネル", "公式チャンネル", "オフィシャル", "公式")
_SPACED = [x for x in CHANNEL_SUFFIXES if x.isascii() and x != "vevo"]
_CHANNEL = r"(?i)(?:[\s-]+(?:" + "|".join(_SPACED) + r")|[\s-]*(?:" + "|".join(x for x in CHANNEL_SUFFIXES if x not in _SPACED) + r"))$"
_ALIAS = r"^\s*(\S.*?)(?: / |/ | /|／)\s*(\S.*?)\s*$"
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def _album_as_artist(c: Column, ctx: dict[str, Column]) -> Column:
    """An artist that is the name of an album of the album's artist (own_album) is the album's artist."""
    own = ctx.get("album_artist", F.lit(None).cast("string"))
    is_album = F.coalesce(ctx.get("own_album", F.lit(False)), F.lit(False))
    return F.when(is_album & own.isNotNull() & (T.letters_key(c) != T.letters_key(own)), own).otherwise(c)


def _channel_alias(c: Column, ctx: dict[str, Column]) -> Column:
    """'Name / Alias' of a channel is its first name; in a structured field only where the two read as one person's."""
    a, b = F.trim(F.regexp_extract(c, _ALIAS, 1)), F.trim(F.regexp_extract(c, _ALIAS, 2))
    x, y = T.letters_key(a), T.letters_key(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    first = lambda t: T.letters_key(F.array_join(F.transform(F.split(t, r"\s+"), lambda w: F.substring(w, 1, 1)), ""))
    one = (a.rlike(_CJK) & T.latin_only(b)) | (T.latin_only(a) & b.rlike(_CJK)) | ((F.length(short) >= 4) & long.startswith(short)) | ((F.size(F.split(a, r"\s+")) > 1) & (first(a) == y)) | ((F.size(F.split(b, r"\s+")) > 1) & (first(b) == x))
    return F.when((a != "") & (b != "") & (~F.coalesce(ctx.get("structured", F.lit(True)), F.lit(True)) | one), a).otherwise(c)


TITLE_RULES: list[Rule] = [
    ("tidy.spacing", lambda c, _: F.trim(F.regexp_replace(F.regexp_replace(c, T.UNSEEN, ""), r"[\s  - 　]+", " "))),
    ("tidy.brackets", lambda c, _: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\(\s+", "("), r"\s+\)", ")"), r"\s*[(\[]\s*[)\]]", "")),
    ("tidy.contractions", lambda c, _: F.regexp_replace(c, r"(?i)\b(\w+n) t\b", "$1't")),
    ("packaging.album_version", _strip("album version|lp version|original version")),
    ("packaging.explicit", _strip("explicit|clean|explicit version|clean version")),
    ("packaging.remaster", _strip(r"(?:\d{4} )?(?:digital )?remaster(?:ed)?(?: \d{4})?")),
    ("packaging.restated", _restated),
    ("packaging.video_frame", lambda c, _: F.regexp_replace(c, r"(?i)^\s*[\[(](?:mv|m/v|official|hd|hq|4k)[\])]\s*|\s*\|\s*full (?:track|song)\s*$", "")),
    ("packaging.video_tags", _strip(r"(?:official )?(?:music |lyrics? )?(?:video|audio|visuali[sz]er|clip)|lyrics?|hd|hq|4k|with lyrics")),
    ("packaging.emoji", lambda c, _: F.trim(F.regexp_replace(c, r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]", ""))),
    ("packaging.pipe_tail", lambda c, _: F.regexp_replace(c, r"\s+[|｜]\s+[^|｜]*$", "")),
    ("guesswork.title_artist", _title_artist),
    ("guesswork.credits", lambda c, _: T.without_credits(c)),
    ("packaging.quotes", lambda c, _: F.regexp_replace(c, '^["“”](.*)["“”]$', "$1")),
    ("tidy.typography", lambda c, _: F.replace(F.regexp_replace(c, "'", "’"), F.lit("..."), F.lit("…"))),
]
ARTIST_RULES: list[Rule] = [
    TITLE_RULES[0],
    ("structure.channel_alias", _channel_alias),
    ("packaging.channel_suffix", lambda c, _: F.regexp_replace(F.trim(c), _CHANNEL, "")),
    ("structure.joined_artists", lambda c, _: F.array_join(F.filter(F.transform(F.split(c, r"[;；]"), lambda x: F.trim(x)), lambda x: x != ""), "; ")),
    ("structure.album_as_artist", _album_as_artist),
    TITLE_RULES[-1],
]
ALBUM_RULES: list[Rule] = [*TITLE_RULES[:3], TITLE_RULES[4], TITLE_RULES[6], ("structure.disc_in_album", lambda c, _: T.album_without_disc(c)), TITLE_RULES[-1]]
GENRE_RULES: list[Rule] = [TITLE_RULES[0], ("structure.joined_genres", lambda c, _: F.array_join(F.transform(F.filter(F.split(c, r"\s*[;|/\t]\s*"), lambda x: x != ""), T.genre_spelling), "; "))]
RULES = {"title": TITLE_RULES, "artist": ARTIST_RULES, "album": ALBUM_RULES, "genre": GENRE_RULES}


def cleaned(df: DataFrame, column: str, rules: list[Rule], off: set[str] = frozenset(), context: dict[str, Column] | None = None) -> DataFrame:
    """df with the column cleaned and <column>_rules, the rules that changed it, in the order run.

    A rule whose result is blank doesn't apply. Null stays null and names no rule. Each rule reads what the last one wrote.
    """
    steps = [F.col(column)]
    names = []
    for name, edit in rules:
        if name in off:
            continue
        made = edit(F.col(f"_s{len(steps) - 1}"), context or {})
        df = df.withColumn(f"_s{len(steps) - 1}", steps[-1])
        steps.append(F.when(T.blank(made), F.col(f"_s{len(steps) - 1}")).otherwise(made))
        names.append(name)
    df = df.withColumn(f"_s{len(steps) - 1}", steps[-1])
    changed = [F.when(F.col(f"_s{i + 1}") != F.col(f"_s{i}"), F.lit(n)) for i, n in enumerate(names)]
    out = df.withColumn(f"{column}_rules", F.array_compact(F.array(*changed)) if changed else F.array().cast("array<string>")).withColumn(column, F.col(f"_s{len(steps) - 1}"))
    return out.drop(*[f"_s{i}" for i in range(len(steps))])


# Words of section headings and of credit lines.
SECTIONS = r"(?:verse|chorus|bridge|intro|outro|refrain|hook|pre-?chorus|interlude|instrumental|solo|strophe|estribillo|couplet)"
LINE_RULES: list[tuple[str, Callable[[Column], Column]]] = [
    ("lyrics.tidy.markup", lambda c: F.regexp_replace(F.regexp_replace(c, r"</?[a-zA-Z][^>]*>", ""), r"&amp;", "&")),
    ("lyrics.tidy.spacing", lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, T.UNSEEN, ""), r"[ \t  - ]+", " "))),
    ("lyrics.tidy.homoglyphs", lambda c: F.when(c.rlike(r"\p{IsLatin}") & (F.regexp_count(c, F.lit(r"\p{IsLatin}")) > 2 * F.regexp_count(c, F.lit(r"\p{IsCyrillic}"))), F.translate(c, "аеорсухіАВЕКМНОРСТХ", "aeopcyxiABEKMHOPCTX")).otherwise(c)),
]
LINE_DROPS: list[tuple[str, Callable[[Column], Column]]] = [
    ("lyrics.packaging.cues", lambda c: c.rlike(rf"(?i)^\s*[\[(]\s*{SECTIONS}\b[^\])]*[\])]\s*$")),
    ("lyrics.packaging.sound", lambda c: c.rlike(r"(?i)^\s*[\[(*♪]+\s*(?:music|applause|laughter|cheering|silence|instrumental|humming)\s*[\])*♪]*\s*$|^\s*♪+\s*$")),
]
# Phrases of an uploader's notes, and ID tags of lyrics, those of makers among them.
COMMENTARY = ("captions", "caption", "subtitles", "subtitle", "translated by", "translation by", "translations by", "timed by", "storyboard", "character design", "music video", "thanks for watching", "on youtube", "on tiktok", "http")
ID_TAG, MAKERS = r"^\s*\[\s*(ti|ar|al|au|by|length|offset|re|ve|id|la|#)\s*:.*\]\s*$", ("by", "re", "ve", "id", "#")
_NOTE = r"(?i)http|(?<![\p{L}\p{N}])(?:" + "|".join(x.replace(" ", r"[^\p{L}\p{N}]+") for x in COMMENTARY if x != "http") + r")(?![\p{L}\p{N}])"
_MADE = r"(?:lyrics?|music|words|written|composed|produced|producer|vocals?|lyricist|composer|arranged|arrangement|subtitles?|mixed|mastered)"
_CREDIT = rf"(?i)^\s*{_MADE}(?:(?: and | & |, ?){_MADE})*\s*(?:by\b|[:：])"
_SURE_CREDIT = rf"(?i)^\s*[(\[]?\s*{_MADE}(?:(?: and | & |, ?){_MADE})*(?: by)?\s*[:：]\s*[^.!?]*$|^\s*(?:https?://|www\.)\S+\s*$"
_HEADING = r" / |／| - | – | — | \| |｜| by "


def line_kinds(words: Column, title: Column, artist: Column) -> Column:
    """What a line of words is among the rest: cue, heading (title, artist or both), credit or sung."""
    parts = F.transform(F.split(words, _HEADING), T.letters_key)
    named = F.array(T.letters_key(title), T.letters_key(artist))
    heading = F.coalesce((F.size(F.array_except(parts, named)) == 0) & F.array_contains(parts, T.letters_key(title)), F.lit(False)) | F.coalesce(T.letters_key(words) == T.letters_key(artist), F.lit(False))
    cue = LINE_DROPS[0][1](words) | LINE_DROPS[1][1](words)
    return F.when(cue, "cue").when(heading & (T.letters_key(words) != ""), "heading").when(words.rlike(_CREDIT) | words.rlike(_SURE_CREDIT), "credit").otherwise("sung")


def edge_drops(lines: DataFrame, key: str, words: str, off: set[str], title: Column, artist: Column, subtitle: Column) -> DataFrame:
    """Lines without headings and credits before the first sung line or after the last, credits that run two lines or that nothing sung is shaped as, and a subtitle's notes that open or close it."""
    held, by = (F.col(words) != "") & ~F.col(words).rlike("(?i)" + ID_TAG), Window.partitionBy(key).orderBy("line", "ms")
    whole = Window.partitionBy(key)
    lines = lines.withColumn("_kind", F.when(held, line_kinds(F.col(words), title, artist))).withColumn("_note", F.when(held, F.col(words).rlike(_NOTE)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    talk = F.when(held & ~F.col("_note"), F.col("line"))
    lines = lines.withColumns({"_from": F.min(talk).over(whole), "_to": F.max(talk).over(whole)})
    noted = yes(subtitle) & yes(F.col("_note")) & (F.col("_from").isNull() | (F.col("line") < F.col("_from")) | (F.col("line") > F.col("_to")))
    if "lyrics.packaging.commentary" in off:
        noted = F.lit(False)
    lines = lines.withColumn("_noted", noted)
    sung = F.when((F.col("_kind") == "sung") & ~F.col("_noted"), F.col("line"))
    lines = lines.withColumns({
        "_first": F.min(sung).over(whole), "_last": F.max(sung).over(whole),
        "_b": F.last("_kind", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)) == "credit",
        "_a": F.first("_kind", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)) == "credit",
    })
    edge = F.col("_first").isNull() | (F.col("line") < F.col("_first")) | (F.col("line") > F.col("_last"))
    drops = {
        "lyrics.packaging.title": yes(F.col("_kind") == "heading") & edge,
        "lyrics.packaging.credits": yes(F.col("_kind") == "credit") & (edge | yes(F.col("_a")) | yes(F.col("_b")) | F.col(words).rlike(_SURE_CREDIT)),
    }
    gone = F.col("_noted")
    for name, test in drops.items():
        gone = gone if name in off else gone | test
    return lines.filter(~gone).drop("_kind", "_note", "_noted", "_first", "_last", "_from", "_to", "_a", "_b")


def without_headers(lines: DataFrame, key: str, words: str) -> DataFrame:
    """No ID tag in untimed lyrics; in timed ones none of makers, and of each other the first alone."""
    tag = F.lower(F.regexp_extract(words, "(?i)" + ID_TAG, 1))
    timed = F.max(F.col("ms").isNotNull()).over(Window.partitionBy(key))
    nth = F.row_number().over(Window.partitionBy(key, "_tag").orderBy("line"))
    lines = lines.withColumn("_tag", tag).withColumn("_timed", timed).withColumn("_nth", nth)
    stays = (F.col("_tag") == "") | F.col("ms").isNotNull() | (F.col("_timed") & ~F.col("_tag").isin(*MAKERS) & (F.col("_nth") == 1))
    return lines.filter(stays).drop("_tag", "_timed", "_nth")


def cleaned_lines(lines: DataFrame, words: str = "words", off: set[str] = frozenset(), title: Column | None = None, artist: Column | None = None, subtitle: Column | None = None, key: str = "doc_id") -> DataFrame:
    """Lines with their words tidied and rule lines dropped; rules holds what changed a kept line.

    title, artist and subtitle (whether the lyrics are a subtitle) are columns of lines; where one isn't given, the rules
    that need it find nothing.
    """
    lines = lines.withColumn("rules", F.array().cast("array<string>"))
    for name, edit in LINE_RULES:
        if name not in off:
            lines = lines.withColumn("_new", edit(F.col(words)))
            lines = lines.withColumn("rules", F.concat("rules", F.array_compact(F.array(F.when(F.col("_new") != F.col(words), F.lit(name)))))).withColumn(words, F.col("_new")).drop("_new")
    if "lyrics.packaging.headers" not in off:
        lines = without_headers(lines, key, words)
    none = F.lit(None).cast("string")
    lines = edge_drops(lines, key, words, off, none if title is None else title, none if artist is None else artist, F.lit(False) if subtitle is None else subtitle)
    for name, test in LINE_DROPS:
        if name not in off:
            lines = lines.filter(~F.coalesce(test(F.col(words)), F.lit(False)))
    return lines


def repeated_blank(lines: DataFrame, key: str) -> DataFrame:
    """Of several blank lines in a row the first stays."""
    w = Window.partitionBy(key).orderBy("line")
    return lines.withColumn("_p", F.lag("words").over(w)).filter(~((F.col("words") == "") & F.coalesce(F.col("_p") == "", F.lit(False)))).drop("_p")
