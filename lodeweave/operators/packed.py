"""Several values packed in one field: a parsing expression grammar with ordered alternatives.

    value     <- space* item (sep+ item)* sep* end
    item      <- quoted / whole / bracketed / bare
    quoted    <- quote chars quote &(space* (sep / end))       on failure: back to the next alternative, flagged
    whole     <- a name known to stand alone although it holds separators of any kind, up to sep or end; the longest
    bracketed <- bracket chars bracket &(space* (sep / end))    on failure (never closed, or more follows): back to bare
    bare      <- (bracket chars bracket / char)* up to sep      a bracket that is never closed is a char as any other
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators. Soft ones also occur inside names.
STRONG = r"[;|\t\r\n\\、，；·•]|//|\s>\s|\s/\s"
JOINERS = r"\s(?:feat\.?|ft\.?|featuring|with|w/|vs\.?|versus|x|×|presents)\s"
SOFT = r",|/|\s?[&+]\s?|\s(?:and|und|et|y)\s"
SEP = re.compile(rf"(?P<strong>{STRONG})|(?P<join>{JOINERS})|(?P<soft>{SOFT})", re.I)
#: A value without any of these holds one value alone and never leaves the JVM.
ANY_SEP = rf"(?i){STRONG}|{JOINERS}|{SOFT}"
PAIRS = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“"}
RESULT = "array<struct<pos:int,item:string,flag:string>>"
BRACKETS = {"(": ")", "[": "]"}
FLAGS = {"open": "open quote", "inner": "inner quote", "bracket": "open bracket"}


def key(c: Column) -> Column:
    """The form names are looked up by: lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _key(text: str) -> str:
    return re.sub(r"\s+", " ", text.lower()).strip(" ")


def pieces(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the separator before each stretch between separators."""
    out, at, kind = [], 0, "start"
    for m in SEP.finditer(text):
        out.append((at, m.start(), kind))
        at, kind = m.end(), m.lastgroup or "strong"
    return [*out, (at, len(text), kind)]


def spans(text: str | None, longest: int) -> list[str]:
    """The pieces and the runs of up to longest pieces that may be one name, as lookup keys."""
    if text is None:
        return []
    cut, out = pieces(text), []
    for i in range(len(cut)):
        for j in range(i, min(i + longest, len(cut))):
            if k := _key(text[cut[i][0] : cut[j][1]].strip(" \"'“”‘’«»")):
                out.append(k)
    return list(dict.fromkeys(out))


def _shaped(text: str, cut: list, i: int, j: int, known: dict[str, str]) -> bool:
    """Whether pieces i to j are one name by their shape alone, for spellings that no list holds."""
    part = [text[a:b].strip() for a, b, _ in cut[i : j + 1]]
    between = [text[cut[n - 1][1] : cut[n][0]] for n in range(i + 1, j + 1)]
    if any(not p for p in part):
        return False
    full = {_key(p) for p in part if known.get(_key(p)) in ("name", "both")}
    words = [len(p.split()) for p in part]
    if len(part) == 3:  # three single words, comma and then a joiner, not all of them known alone
        return words == [1, 1, 1] and between[0].strip() == "," and between[1].strip().lower() in ("&", "and", "+") and len(full) < 3 and _key(part[0]) not in full
    if between[0].strip().lower() in ("&", "and", "+"):
        return part[1].lower() in ("sons", "son") or bool(re.fullmatch(r"the \w+", part[1])) and words[0] == 1 and between[0].strip().lower() == "and"
    if between[0] == "/":
        return len(part[0]) <= 2 and words == [1, 1]
    if between[0] == "," and words == [1, 1] and text[cut[j][0] : cut[j][0] + 1] == " ":
        if re.fullmatch(r"\w\.?", part[1]):
            return True
        return known.get(_key(part[1])) in ("given", "both") and _key(part[0]) not in full
    if between[0] == "," and words[0] == 1 and re.fullmatch(r"\w[\w-]+ \w\.", part[1]):
        return known.get(_key(part[1].split()[0])) in ("given", "both") and _key(part[0]) not in full
    return False


def _balanced(text: str, a: int, b: int) -> bool:
    """Whether every bracket that opens in text[a:b] closes there; one that closes unopened doesn't matter."""
    depth: list[str] = []
    for c in text[a:b]:
        if c in BRACKETS:
            depth.append(BRACKETS[c])
        elif depth and c == depth[-1]:
            depth.pop()
    return not depth


class _Grammar:
    """Each alternative tells the last piece of an item that begins with piece i, or none where it fails."""

    def __init__(self, text: str, known: dict[str, str], longest: int) -> None:
        self.text, self.known, self.longest, self.cut = text, known, longest, pieces(text)

    def start(self, i: int) -> int:
        a = self.cut[i][0]
        return a + len(self.text[a:]) - len(self.text[a:].lstrip())

    def quoted(self, i: int) -> int | None:
        a = self.start(i)
        close = PAIRS.get(self.text[a : a + 1])
        if close is None:
            return None
        for j in range(i, len(self.cut)):
            body = self.text[a : self.cut[j][1]].rstrip()
            inner = body[1:-1]
            same = close == body[0] and j > i and inner.count(close) % 2 == 0
            if len(body) > 1 and body.endswith(close) and (inner.count(close) == 0 or same):
                return j
        return None

    def whole(self, i: int) -> int | None:
        for j in range(min(i + self.longest, len(self.cut)) - 1, i, -1):
            if self.known.get(_key(self.text[self.cut[i][0] : self.cut[j][1]])) == "whole":
                return j
        for j in range(min(i + 3, len(self.cut)) - 1, i, -1):
            if all(self.cut[n][2] == "soft" for n in range(i + 1, j + 1)) and _shaped(self.text, self.cut, i, j, self.known):
                return j
        return None

    def bracketed(self, i: int) -> int | None:
        a = self.start(i)
        close = BRACKETS.get(self.text[a : a + 1])
        if close is None:
            return None
        for j in range(i, len(self.cut)):
            body = self.text[a : self.cut[j][1]].rstrip()
            if _balanced(body, 0, len(body)):
                return j if len(body) > 1 and body.endswith(close) and not _balanced(body, 0, len(body) - 1) else None
        return None

    def bare(self, i: int) -> int:
        a = self.cut[i][0]
        if not _balanced(self.text, a, self.cut[i][1]):
            for j in range(i + 1, len(self.cut)):
                if self.cut[j][2] == "join":  # a guest in brackets is a value of its own
                    break
                if _balanced(self.text, a, self.cut[j][1]):
                    return j
        return i

    def flag(self, i: int, j: int) -> str | None:
        a = self.start(i)
        if self.text[a : a + 1] in PAIRS:
            return FLAGS["inner" if PAIRS[self.text[a]] in self.text[a + 1 : self.cut[j][1]] else "open"]
        return None if _balanced(self.text, a, self.cut[j][1]) else FLAGS["bracket"]

    def item(self, i: int) -> tuple[int, str | None]:
        if (j := self.quoted(i)) is not None:
            return j, None
        for alternative in (self.whole, self.bracketed, self.bare):
            if (j := alternative(i)) is not None:
                return j, self.flag(i, j)
        raise AssertionError("bare takes anything")


def _prose(text: str, kinds: set[str], items: list[str]) -> bool:
    """Whether a text without any known name is a sentence or a template and no list: it holds marks of code, or, split by soft separators alone, an item that is a clause of small words."""
    if re.search(r"[{}<>$%]", text):
        return True

    def clause(x: str) -> bool:
        w = x.split()
        return len(w) > (2 if x.islower() else 5) and sum(y[:1].islower() for y in w) * 2 > len(w)

    return not kinds & {"strong", "join"} and any(map(clause, items))


def parse(text: str, known: dict[str, str], longest: int = 3) -> list[tuple[int, str, str | None]]:
    """Position (from 1), item and error flag of each value.

    known: lookup key to what it is: whole (one name although it holds a separator), name (a name without one),
    given (a given name), both (name and given). longest: pieces that a whole name may have.
    """
    g, out, i = _Grammar(text, known, longest), [], 0
    while i < len(g.cut):
        j, flag = g.item(i)
        item = text[g.start(i) : g.cut[j][1]].strip()
        for _ in range(2):
            if len(item) > 1 and item[0] in PAIRS and item[-1] == PAIRS[item[0]] and item[1:-1].count(item[0]) == 0:
                item = item[1:-1].strip()
        item = re.sub(r"(?i)^(?:feat\.?|ft\.?|featuring|and)\s+", "", item).strip()
        if item:
            out.append((len(out) + 1, item, flag))
        i = j + 1
    if len(out) > 1 and not any(known.get(_key(x)) in ("whole", "name", "both") for _, x, _ in out) and _prose(text, {k for _, _, k in g.cut[1:]}, [x for _, x, _ in out]):
        return [(1, text.strip(), "prose")]
    return out


def _parse_series(values: pd.Series, known: pd.Series, longest: pd.Series) -> pd.Series:
    def one(text, hits, longest):
        seen: dict[str, str] = {}
        for h in hits if hits is not None else []:
            k, kind = h["k"], h["kind"]
            seen[k] = kind if k not in seen or kind == "whole" else seen[k] if seen[k] in (kind, "whole") else "both"
        return [{"pos": p, "item": x, "flag": f} for p, x, f in parse(text, seen, longest)]

    return pd.Series([one(*r) for r in zip(values, known, longest, strict=True)])


def _asked(texts: DataFrame, longest: int) -> DataFrame:
    """text and k: each run of pieces that may be a name."""

    def series(values: pd.Series) -> pd.Series:
        return values.map(lambda x: spans(x, longest))

    return texts.select("text", F.explode(F.pandas_udf(series, "array<string>")("text")).alias("k"))


def split_values(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """texts (distinct, one column text) to text, items (an array of pos, item, flag).

    lexicon: k (a lookup key) and kind (whole, name or given), of any size: it is joined, never broadcast by us.
    Texts without a separator are one value; they and null texts aren't in the result. Empty values between
    separators are skipped and don't count. A quote or bracket that isn't closed is part of the item, which is flagged.
    Names of any number of pieces are kept whole: runs are looked up as long as the lexicon's longest name.
    """
    held = texts.filter(F.col("text").rlike(ANY_SEP)).select("text")
    pieces_of = F.size(F.split("k", f"(?i){STRONG}|{JOINERS}|{SOFT}"))
    longest = max(3, lexicon.filter("kind = 'whole'").agg(F.max(pieces_of)).first()[0] or 0)  # one number: what the longest name has
    asked = _asked(held, longest)
    hits = asked.join(lexicon.select("k", "kind").dropDuplicates(), "k").groupBy("text").agg(F.collect_list(F.struct("k", "kind")).alias("hits"))
    met = held.join(hits, "text", "left")
    return met.select("text", F.pandas_udf(_parse_series, RESULT)("text", "hits", F.lit(longest)).alias("items"))


def name_lexicon(names: DataFrame) -> DataFrame:
    """k, kind of names (one column name) that each stand for one artist.

    A name that holds a separator is whole, and so is any two-word name turned round with a comma. First words of two-word
    names that begin two names or more are given names.
    """
    n = names.filter(F.col("name").isNotNull()).select(key(F.col("name")).alias("k")).filter("k != ''").dropDuplicates()
    has = F.col("k").rlike(ANY_SEP)
    two = n.filter(~has).select("k", F.split("k", " ").alias("w")).filter("size(w) IN (2, 3)")
    turned = two.select(F.concat_ws(", ", F.element_at("w", -1), F.array_join(F.slice("w", 1, F.size("w") - 1), " ")).alias("k")).select("k", F.lit("whole").alias("kind"))
    given = two.groupBy(F.col("w")[0].alias("k")).agg(F.count_distinct(F.element_at("w", -1)).alias("n")).filter("n > 1").select("k", F.lit("given").alias("kind"))
    return n.select("k", F.when(has, "whole").otherwise("name").alias("kind")).unionByName(turned).unionByName(given)


def label_lexicon(labels: DataFrame) -> DataFrame:
    """k, kind of labels (one column name) of a field that may itself be packed.

    A label with a soft separator is whole where it stands alone, one of its parts never does (one of more than three
    parts: none of them), and no shorter such label lies within it.
    """
    n = labels.filter(F.col("name").isNotNull()).select(key(F.col("name")).alias("k")).filter("k != ''").groupBy("k").agg(F.count("*").alias("n"))
    plain = n.filter(~F.col("k").rlike(ANY_SEP)).select("k")
    soft = n.filter(F.col("k").rlike(f"(?i){SOFT}") & ~F.col("k").rlike(rf"(?i){STRONG}|{JOINERS}|[\"']"))
    parts = soft.select("k", F.posexplode(F.split("k", f"(?i){SOFT}")).alias("at", "p")).withColumn("p", F.trim("p"))
    few = parts.groupBy("k").agg(F.count("*").alias("parts"), F.min(F.col("p") != "").alias("full")).filter("full")
    alone = plain.select(F.col("k").alias("p"), F.lit(True).alias("alone"))
    lacks = parts.join(few, "k").join(alone, "p", "left").groupBy("k", "parts").agg(F.count_if(F.col("alone").isNull()).alias("lacks")).filter("lacks > 0 AND (parts <= 3 OR lacks = parts)")
    small = lacks.filter("parts = 2").select(F.col("k").alias("small"))
    big = _asked(lacks.filter("parts > 2").select(F.col("k").alias("text")), 2).select(F.col("text").alias("k"), F.col("k").alias("small")).filter("k != small")
    wholes = lacks.select("k").join(big.join(small, "small").select("k"), "k", "left_anti")
    return plain.select("k", F.lit("name").alias("kind")).unionByName(wholes.select("k", F.lit("whole").alias("kind")))


def artist_names(records: DataFrame, aliases: DataFrame) -> DataFrame:
    parts = aliases.select("name").unionByName(records.select(F.explode("artists").alias("name")))
    return parts.unionByName(records.filter("size(artists) = 1").select(F.col("credit").alias("name"))).filter(F.length("name") > 0)


def packed_fields(videos: DataFrame, records: DataFrame, aliases: DataFrame, genres: DataFrame) -> DataFrame:
    """tab, row_no, field, pos, item, flag of each field that holds two values or more."""
    v = videos.select(F.lit("video_infos").alias("tab"), F.col("info_no").alias("row_no"), F.expr("stack(2, 'artist', artist, 'creator', creator) AS (field, text)")).filter(F.col("text").rlike(ANY_SEP))
    g = genres.select(F.lit("genres").alias("tab"), F.col("genre_no").alias("row_no"), F.lit("name").alias("field"), F.col("name").alias("text")).filter(F.col("text").rlike(ANY_SEP))
    split_v = split_values(v.select("text").dropDuplicates(), name_lexicon(artist_names(records, aliases)))
    split_g = split_values(g.select("text").dropDuplicates(), label_lexicon(genres.select("name")))
    both = v.join(split_v, "text").unionByName(g.join(split_g, "text"))
    return both.filter("size(items) > 1").select("tab", "row_no", "field", F.inline("items"))


def found(videos: DataFrame, records: DataFrame, aliases: DataFrame, genres: DataFrame) -> DataFrame:
    return packed_fields(videos, records, aliases, genres).select("tab", "row_no", "field", "pos", "item")
