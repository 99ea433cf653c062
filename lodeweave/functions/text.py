"""Text expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compare import ROMAN, SERIES

NOT_ALNUM = r"[^\p{L}\p{N}]+"
MARKS = r"\p{M}+"
UNSEEN = r"[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]"
SPACES = r"[   -   　]"


@lru_cache(None)
def accent_map() -> tuple[str, str]:
    """Composed letters of Latin, Greek and Cyrillic and their letters without a mark, found from the Unicode data."""
    a, b = [], []
    for code in [*range(0xC0, 0x250), *range(0x386, 0x3CF), *range(0x400, 0x460), *range(0x1E00, 0x2000)]:
        base = unicodedata.normalize("NFD", ch := chr(code))
        if len(base) > 1 and not unicodedata.category(base[0]).startswith("M"):
            a.append(ch)
            b.append(base[0])
    return "".join(a), "".join(b)


@lru_cache(None)
def width_map() -> tuple[str, str]:
    """Full-width forms and the plain characters they stand for."""
    wide = [chr(c) for c in range(0xFF01, 0xFF5F)]
    return "".join(wide), "".join(chr(ord(c) - 0xFEE0) for c in wide)


def unaccented(c: Column) -> Column:
    """Without accents, composed or apart. Null stays null."""
    return F.translate(F.regexp_replace(c, MARKS, ""), *accent_map())


def folded(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(unaccented(c))


def alnum(c: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(c), NOT_ALNUM, "")


def letters_key(c: Column) -> Column:
    """Letters and digits alone, lower case, no accents, no width forms, nothing unseen."""
    return F.regexp_replace(folded(F.translate(c, *width_map())), NOT_ALNUM, "")


def words(c: Column) -> Column:
    """Lower-case words; an empty text has none. Null stays null."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), NOT_ALNUM, " "), " "), lambda w: w != "")


def one_line(c: Column) -> Column:
    """Line breaks and tabs become one space."""
    return F.regexp_replace(c, r"[\r\n\t]+", " ")


def blank(c: Column) -> Column:
    """True where the text is null, empty or blank."""
    return c.isNull() | (F.trim(F.regexp_replace(c, r"\s+", " ")) == "")


# Typographic marks and the plain ones that stand for them.
TYPOGRAPHY = ("‘’‚‛“”„‟–—‐‑−´`", "''''\"\"\"\"-----''")
_JOINER = r"(?i)\s*(?:;|/|\s&\s|\s\+\s|,|\s(?:and|x|vs\.?|feat\.?|ft\.?|featuring|with)\s)\s*"
VERSION_WORDS = ("live", "demo", "remix", "acoustic", "instrumental", "karaoke", "edit", "extended", "remaster", "remastered", "cover", "orchestral", "mono", "stereo")


def plain_punctuation(c: Column) -> Column:
    return F.replace(F.translate(c, *TYPOGRAPHY), F.lit("…"), F.lit("..."))


def query_fold(c: Column) -> Column:
    """The form query terms are compared in: lower case, no accents, plain punctuation, one line."""
    return one_line(plain_punctuation(folded(c)))


def similarity_fold(c: Column, article: bool = False) -> Column:
    """The form names are compared in: folded words with single spaces, a leading article dropped unless kept.

    Text of scripts without spaces keeps its letters together.
    """
    words_ = F.trim(F.regexp_replace(folded(plain_punctuation(F.translate(c, *width_map()))), r"[^\p{L}\p{N}]+", " "))
    return words_ if article else F.regexp_replace(words_, r"^(?:the|a|an) (?=.)", "")


def agreement_key(values: Column) -> Column:
    """Letters and digits of all values of a field, in order."""
    return alnum(F.array_join(values, ""))


def escaped(c: Column) -> Column:
    """Line breaks and tabs shown as text."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def latin_only(c: Column) -> Column:
    return ~c.rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def main_script(c: Column) -> Column:
    """The script most letters are of, Han and kana being one; the first seen of equals; null where there is no letter."""
    kinds = {"Latin": r"\p{IsLatin}", "Cyrillic": r"\p{IsCyrillic}", "Greek": r"\p{IsGreek}", "Han": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"} | {k: rf"\p{{Is{k}}}" for k in ("Armenian", "Georgian", "Hangul", "Arabic", "Hebrew", "Thai", "Devanagari")}
    seen = lambda p: -F.length(F.regexp_extract(c, rf"(?s)^(.*?){p}", 1))
    counts = F.array(*[F.struct(F.regexp_count(c, F.lit(p)).alias("n"), seen(p).alias("i"), F.lit(k).alias("k")) for k, p in kinds.items()])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["k"])


def utf16_units(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def digest128(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def url_domain(c: Column) -> Column:
    """Host in lower case without user, port and www.; null where it holds no dot."""
    host = F.regexp_replace(F.lower(F.regexp_extract(c, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    return F.when(F.contains(host, F.lit(".")), host)


def hide_query(c: Column) -> Column:
    return F.regexp_replace(c, r"[?#].*$", "")


def percent_encoded(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def is_mbid(c: Column) -> Column:
    return F.lower(c).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def safe_path(c: Column) -> Column:
    """Characters file systems refuse replaced, no space or dot at the end; never empty."""
    out = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[ .]+$", "")
    return F.when(out == "", "_").otherwise(out)


def folded_path(c: Column) -> Column:
    return F.upper(c)


def numbers_in(c: Column) -> Column:
    """Digit runs of a name as numbers, then Roman numerals to XX; I and V only after a word of a series."""
    ws = words(c)
    value = F.create_map(*[x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    series = F.array(*map(F.lit, sorted(SERIES)))
    one = lambda w, i: F.when(~w.isin("i", "v") | ((i > 0) & F.array_contains(series, F.get(ws, i - 1))), F.element_at(value, w))
    digits = F.transform(F.regexp_extract_all(c, F.lit(r"(\d{1,15})"), 1), lambda x: x.cast("bigint"))
    return F.concat(digits, F.filter(F.transform(ws, one), lambda x: x.isNotNull()))


def version_kinds(c: Column) -> Column:
    return F.array_sort(F.array_intersect(words(c), F.array(*map(F.lit, VERSION_WORDS))))


def credit_parts(c: Column) -> Column:
    """Names of one credit."""
    return F.filter(F.transform(F.split(c, _JOINER), lambda x: F.trim(x)), lambda x: x != "")


def credit_keys(c: Column) -> Column:
    """The folded whole and its parts, without apostrophes and spaces."""
    key = lambda x: F.regexp_replace(folded(x), r"[\s'’]", "")
    return F.array_distinct(F.concat(F.array(key(c)), F.transform(credit_parts(c), key)))


def without_credits(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?i)\s*[(\[]?\b(?:feat\.?|ft\.?|featuring|w/)\s[^)\]]*[)\]]?", ""))


def disc_of_album(c: Column) -> Column:
    """Number of the disc an album's name ends in, else null."""
    n = F.regexp_extract(c, r"(?i)[\s,(\[-]+(?:disc|disk|cd)\s*(\d{1,3})\s*[)\]]?\s*$", 1)
    return F.when(n != "", n.cast("int"))


def album_without_disc(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)[\s,(\[-]+(?:disc|disk|cd)\s*\d{1,3}\s*[)\]]?\s*$", "")


def title_parts(c: Column) -> Column:
    """Core of a title and its bracketed decorations."""
    return F.struct(F.trim(F.regexp_replace(c, r"\s*[(\[][^)\]]*[)\]]", "")).alias("core"), F.transform(F.regexp_extract_all(c, F.lit(r"[(\[]([^)\]]*)[)\]]"), 1), lambda x: F.trim(x)).alias("decorations"))


def decoration_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[(\[][^)\]]*[)\]]")) + F.regexp_count(c, F.lit(r"(?U)\s[|–—-]\s"))


def packaging(c: Column) -> Column:
    """Whether a bracket's text is packaging and no part of the name."""
    return F.lower(F.trim(c)).rlike(r"^(?:official\b.*|(?:music |lyric )?video|audio|lyrics?|visuali[sz]er|hd|hq|4k|full (?:song|track|album)|album version|explicit|clean|remaster(?:ed)?(?: \d{4})?|\d{4} remaster(?:ed)?)$")


def file_name_guess(stem: Column) -> Column:
    """Track, artist and title of a file's stem, by the readings '03 - Artist - Title', '03 Title' and 'Artist - Title'."""
    full = r"^\s*(?:(\d{1,3})\s*[-._ ]\s*)?(?:(.+?)\s+-\s+)?(.+?)\s*$"
    part = lambda i: F.when(F.regexp_extract(stem, full, i) != "", F.regexp_extract(stem, full, i))
    return F.struct(part(1).cast("int").alias("track"), part(2).alias("artist"), part(3).alias("title"))


def exactness(a: Column, b: Column) -> Column:
    """0 where two names are equal by letters and digits, 1 where one holds the other, else 2."""
    x, y = letters_key(a), letters_key(b)
    return F.when(x == y, 0).when((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), 1).otherwise(2)


def edit_share(a: Column, b: Column) -> Column:
    """Edits over the longer length, in code points, rounded to thousandths; two empty texts are equal."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 0.0).otherwise(F.round(F.levenshtein(a, b) / n, 3))


def agreement(distance: Column) -> Column:
    """Three-valued: alike up to 0.2, apart past 0.5, else it says nothing."""
    return F.when(distance <= 0.2, True).when(distance > 0.5, False)


def house_style(c: Column) -> Column:
    """A featured artist as '(feat. X)', a version after a dash in brackets."""
    c = F.regexp_replace(c, r"(?i)\s*[(\[]?\b(?:feat\.?|ft\.?|featuring|w/)\s+([^()\[\]|]+?)\s*[)\]]?\s*$", " (feat. $1)")
    return F.regexp_replace(c, r"(?i)\s+[-–]\s+((?:live|demo|remix|acoustic|radio edit|extended)[^()\[\]-]*)$", " ($1)")


def genre_spelling(c: Column) -> Column:
    """Words and parts of hyphened words with a capital, small words without, letter pairs as R&B in capitals."""
    w = F.initcap(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "))
    w = F.array_join(F.transform(F.split(w, "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), "-")
    for small in ("And", "Of", "The", "N"):
        w = F.regexp_replace(w, rf" {small} ", f" {small.lower()} ")
    return F.when(w.rlike(r"^.&.$"), F.upper(w)).otherwise(w)


def redacted(c: Column) -> Column:
    """Secrets of settings and URLs replaced: keys, tokens, passwords, users of a URL."""
    c = F.regexp_replace(c, r"(?i)\b((?:api[_-]?key|token|secret|password|passwd)\s*[=:]\s*)\S+", "$1***")
    return F.regexp_replace(c, r"(://)[^/\s:@]+:[^/\s@]+@", "$1***@")


def field_value_kind(c: Column) -> Column:
    """What a text is as a tag value."""
    return (
        F.when(blank(c), "none").when(is_mbid(c), "mbid").when(c.rlike(r"^[A-Z]{2}-?[A-Z0-9]{3}-?\d{2}-?\d{5}$"), "isrc").when(c.rlike(r"^\d{12,14}$"), "barcode")
        .when(c.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), "date").when(c.rlike(r"^[+-]?\d+(\.\d+)? dB$"), "gain").when(c.rlike(r"^\d+/\d+$"), "place").when(c.rlike(r"^\d+$"), "count").otherwise("text")
    )
