"""Texts that look alike but are made of other characters."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES, UNSEEN

# Cyrillic and Greek letters that look like a Latin one.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухѕіј", "ABESIJKMHOPCTYXaeopcyxsij", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι", "ABEZHIKMNOPTYXovi", strict=True))
LATIN = CYRILLIC | GREEK
BACK = {"Cyrillic": {v: k for k, v in CYRILLIC.items()}, "Greek": {v: k for k, v in GREEK.items()}}
_WORD = re.compile(r"[^\W\d_]+")


def _compat_map() -> dict[int, str]:
    """Width forms, ligatures and styled letters and digits with their plain form, found from the Unicode data."""
    out = {}
    for code in [*range(0xFF01, 0xFF5F), *range(0xFB00, 0xFB07), *range(0x1D400, 0x1D800), *range(0x2460, 0x24EA), 0x017F]:
        plain = unicodedata.normalize("NFKC", chr(code))
        if plain != chr(code) and plain.isascii():
            out[code] = plain
    return out


COMPAT = _compat_map()


def script(ch: str) -> str:
    return "Cyrillic" if "Ѐ" <= ch < "԰" else "Greek" if "Ͱ" <= ch < "Ѐ" or "ἀ" <= ch < " " else "Latin"


def _one_script(word: str, foreign: bool) -> str:
    """The word in the script of those letters that have no likeness, in Latin where all have one.

    foreign: the text has true letters of another script, so a word of that script alone is no disguise.
    """
    scripts = {script(x) for x in word}
    if len(scripts) == 1:
        return word if foreign or scripts == {"Latin"} or any(x not in LATIN for x in word) else "".join(LATIN[x] for x in word)
    true = [script(x) for x in word if (x not in LATIN if script(x) != "Latin" else x not in BACK["Cyrillic"] and x not in BACK["Greek"])]
    home = max(sorted(set(true)), key=true.count) if true else "Latin"
    if home == "Latin":
        return "".join(LATIN.get(x, x) for x in word)
    return "".join(x if script(x) == home else BACK[home].get(LATIN.get(x, x), x) for x in word)


def mapped(text: str) -> str:
    """The look-alike-mapped value: composed, plain forms, nothing unseen, each word in one script."""
    plain = re.sub(SPACES, " ", re.sub(UNSEEN, "", text.translate(COMPAT)))
    plain = unicodedata.normalize("NFC", plain)
    foreign = any(script(x) != "Latin" and x not in LATIN for x in plain if x.isalpha())
    return _WORD.sub(lambda m: _one_script(m[0], foreign), plain)


def _mapped_series(values: pd.Series) -> pd.Series:
    return values.map(mapped, na_action="ignore")


def classes(spark, values: DataFrame) -> DataFrame:
    """mapped, canonical: each class of values that one collation can't tell apart once look-alikes are mapped.

    values: text, mapped, n. Grouping is by Unicode collation that keeps accents and case, in SQL. The canonical member is
    the commonest ordinary spelling (ties by code point); a class without one takes its mapped value.
    """
    return spark.sql(
        """
        SELECT min(mapped) AS mapped, coalesce(max(CASE WHEN text = mapped THEN struct(n, text) END).text, min(mapped)) AS canonical, sum(n) AS n
        FROM {values} GROUP BY collate(mapped, 'UNICODE')
        """,
        values=values,
    )


def consistent(rows: DataFrame) -> DataFrame:
    """tab, row_no, field, text, canonical: every text in its one form; rows: tab, row_no, field, text.

    ASCII texts are mapped values already, so only others pass through Python, each distinct text once. Null texts are
    left out, they look like nothing. Empty texts are a class of their own; repeated rows and ties don't matter, as the
    canonical member depends on counts and code points alone. Empty input gives no rows.
    """
    rows = rows.filter(F.col("text").isNotNull())
    counted = rows.groupBy("text").agg(F.count("*").alias("n"))
    ascii_only = ~F.col("text").rlike(r"[^\x00-\x7F]")
    plain = counted.filter(ascii_only).withColumn("mapped", F.col("text"))
    other = counted.filter(~ascii_only).withColumn("mapped", F.pandas_udf(_mapped_series, "string")("text"))
    changed = other.filter("text != mapped")
    # Only classes with a changed member need a canonical one: the rest keep their spelling.
    asked = changed.select(F.collate("mapped", "UNICODE").alias("_k")).dropDuplicates()
    both = plain.unionByName(other)
    members = both.join(asked, F.collate("mapped", "UNICODE") == F.col("_k"), "left_semi")
    groups = classes(rows.sparkSession, members).select(F.collate("mapped", "UNICODE").alias("_g"), "canonical")
    form = changed.join(groups, F.collate("mapped", "UNICODE") == F.col("_g")).select(F.col("text").alias("_t"), "canonical")
    met = rows.join(form, F.col("text") == F.col("_t"), "left")
    return met.select("tab", "row_no", "field", "text", F.coalesce("canonical", "text").alias("canonical"))


def texts(videos: DataFrame, records: DataFrame) -> DataFrame:
    v = videos.select(F.lit("video_infos").alias("tab"), F.col("info_no").alias("row_no"), F.expr("stack(2, 'title', title, 'album', album) AS (field, text)"))
    r = records.select(F.lit("records").alias("tab"), F.col("record_no").alias("row_no"), F.lit("title").alias("field"), F.col("title").alias("text"))
    return v.unionByName(r)


def found(videos: DataFrame, records: DataFrame) -> DataFrame:
    """Texts whose one form is another than they are."""
    return consistent(texts(videos, records)).filter(F.col("canonical") != F.col("text")).select("tab", "row_no", "field")
