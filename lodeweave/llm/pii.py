"""Personal information in free text: anchors found by Aho-Corasick, expanded and checked by local parsers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

PASSAGES = "array<struct<kind:string,passage:string>>"
#: A first word of so many different two-word artists' names is taken for a given name.
GIVEN_AT_LEAST = 3
#: Words that begin names of groups and places, not of people.
NOT_GIVEN = ("dj", "mc", "the", "saint", "st.", "mount", "orchestra", "new", "los", "las")
#: What the automaton looks for, in lower case, by the parser that expands it.
ANCHORS = {
    "mail": ("@",),
    "written": ("[at", "(at", "{at", "[ at", "( at", "{ at"),
    "spoken": (" at ",),
    "scheme": ("http://", "https://", "ftp://", "www."),
    "digit": tuple("0123456789"),
    "way": tuple(f" {w}{e}" for w in ("street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "close", "court", "ct", "terrace", "drive", "dr", "way", "place", "square", "gardens") for e in (",", ".,")),
    "rue": tuple(f" {w} " for w in ("rue", "avenue", "boulevard", "place", "allée", "calle", "plaza")),
    "gasse": ("straße ", "strasse ", "str. ", "platz ", "weg ", "gasse ", "allee "),
    "label": (
        *("ssn", "social security", "national insurance", "passport", "identity card", "id", "account", "refund to", "number", "no.", "iban", "tax id"),
        *("ausweis", "ausweisnummer", "personalausweis", "reisepass", "konto", "identité", "passeport", "compte", "dni", "nie", "pasaporte", "cuenta"),
    ),
    "goods": ("catalogue", "catalog", "cat.", "order", "isrc", "barcode", "ean", "upc", "recording", "matrix", "bestellnummer", "katalog", "commande", "pedido", "referencia"),
}
#: So many letters before an identity number its label may stand.
LABEL_WITHIN = 28
_CAP = r"[A-ZÀ-ÖØ-Þ][\w’'-]*"
_POST = r"(?:\d{5}|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2})"
_DOMAIN = r"[A-Za-z0-9][\w-]*"
_MAIL = re.compile(rf"@({_DOMAIN}(?:\.[A-Za-z][\w-]*)+)")
_WRITTEN = re.compile(rf"[\[({{] ?at ?[\])}}] ?({_DOMAIN}(?: ?[\[({{] ?dot ?[\])}}] ?[A-Za-z][\w-]*|\.[A-Za-z][\w-]*)+)", re.I)
_SPOKEN = re.compile(rf" at ({_DOMAIN}(?: dot [A-Za-z][\w-]*)+)", re.I)
_URL = re.compile(r"\S+")
_CAP_WORD = re.compile(_CAP)
_HOUSE = re.compile(r"(?<![\w.])\d{1,4}[a-z]?$")
_FLAT = re.compile(r"(?<!\w)(?:Apt|Flat|Unit|Suite)\.? \w{1,4}, $")
_WAY = re.compile(rf" [A-Z]\w+\.?, (?:{_CAP}(?: {_CAP}){{0,3}},? {_POST}|{_CAP})")
_BEFORE_RUE = re.compile(r"(?<![\w.])\d{1,4}[a-z]?,?(?: bis| ter)?$")
_RUE = re.compile(rf" (?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Aa]llée|[Cc]alle|[Pp]laza) (?:de la |de l[’']|des |du |de |d[’'])?{_CAP}(?: {_CAP})*, \d{{5}} {_CAP}")
_GASSE = re.compile(rf"(?:straße|strasse|str\.|platz|weg|gasse|allee) \d{{1,4}} ?[a-z]?, \d{{5}} {_CAP}", re.I)
_END = r"(?![\w-]*\d)"
IDS = {
    "ssn": re.compile(rf"(?<![\w.+-])(\d{{3}})([- ])(\d{{2}})\2(\d{{4}}){_END}"),
    "nie": re.compile(r"(?<![\w-])([XYZ])-?(\d{7})([A-Z])(?![\w-])"),
    "pass": re.compile(r"(?<![\w-])[XYZ]-?\d{7,8}(?![\w-])"),
    "dni": re.compile(r"(?<![\w-])(\d{8})-?([A-Z])(?![\w-])"),
    "nino": re.compile(r"(?<![\w-])([A-Z]{2}) ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])"),
    "iban": re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?\d{4}){3,7}(?: ?\d{1,3})?(?![\w-])"),
}
PHONES = (
    re.compile(rf"(?<![\w+])(?:\+\d{{1,3}}|00\d{{2}})(?:[ .-]?\(\d{{1,4}}\)[ .-]?\d{{1,5}}|[ .-]?\d{{1,5}})(?:[ .-]?\d{{2,11}}){{1,5}}{_END}"),
    re.compile(rf"(?<![\w+./-])(?:\(\d{{3}}\) ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}{_END}"),
    re.compile(rf"(?<![\w+./-])0[1-9](?:[ .-]\d{{2}}){{4}}{_END}"),
    re.compile(rf"(?<![\w+./-])0\d{{2,5}}[ /-]\d{{5,8}}{_END}"),
    re.compile(rf"(?<![\w+./-])0\d{{2,4}} \d{{3,4}} \d{{3,4}}{_END}"),
    re.compile(rf"(?<![\w+./-] )(?<![\w+./-])555[ .-]\d{{4}}{_END}|(?<=[a-zé:.,|] )555[ .-]\d{{4}}{_END}"),
)
_RUN = re.compile(rf"(?<![\w’'-]){_CAP}(?: (?:[A-ZÀ-ÖØ-Þ]\. )?{_CAP})+")
_NEXT = re.compile(rf"({_CAP})( [A-ZÀ-ÖØ-Þ]\.)? (?=({_CAP}))")
_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # control letters of Spanish identity numbers, by the number modulo 23


def genuine(kind: str, m: re.Match) -> bool | None:
    """Whether an identity number passes the check of its kind; none where it's blank (all zeros), or has no check and fails no rule."""
    digits = re.sub(r"\D", "", m[0])
    if not digits.strip("0"):
        return None
    if kind == "ssn":
        if "0" * 3 == m[1] or m[3] == "00" or m[4] == "0000":
            return None
        return m[1] != "666" and m[1] < "900"
    if kind == "nie":
        return _LETTERS[int("XYZ".index(m[1]) * 10**7 + int(m[2])) % 23] == m[3]
    if kind == "dni":
        return _LETTERS[int(m[1]) % 23] == m[2]
    if kind == "nino":
        return not re.search(r"[DFIQUV]|BG|GB|NK|KN|TN|NT|ZZ|.O", m[1])
    if kind == "iban":
        t = m[0].replace(" ", "")
        return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1
    return False


class Finder:
    """An automaton of all anchors, and the parser that each starts."""

    def __init__(self) -> None:
        import ahocorasick

        kinds: dict[str, list] = {}
        for kind, many in ANCHORS.items():
            for w in many:
                kinds.setdefault(w, []).append(kind)
        self.automaton = ahocorasick.Automaton()
        for w, ks in kinds.items():
            self.automaton.add_word(w, (len(w), tuple(ks)))
        self.automaton.make_automaton()

    def anchors(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """Start and end of every anchor by kind. Of digits those that begin a run; labels as whole words."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        out: dict[str, list[tuple[int, int]]] = {}
        last = -2
        for end, (n, kinds) in self.automaton.iter(low):
            start = end + 1 - n
            for kind in kinds:
                if kind == "digit":
                    if end > last + 1:
                        out.setdefault(kind, []).append((start, end + 1))
                    last = end
                elif kind not in ("label", "goods") or not (low[start - 1 : start].isalnum() or low[end + 1 : end + 2].isalnum()):
                    out.setdefault(kind, []).append((start, end + 1))
        return out

    def passages(self, text: str) -> list[tuple[str, str]]:
        """Kind and exact text of each passage; an earlier kind keeps its place.

        Addresses and mails grow left and right from their anchor, numbers from the first digit of a run, each as far as
        its own rule lets it; nothing else of the text is parsed, but for runs of capital words, which may be persons.
        """
        at = self.anchors(text)
        taken: list[tuple[int, int]] = []
        out: list[tuple[str, str]] = []

        def put(kind: str, a: int, b: int) -> None:
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((kind, text[a:b]))

        for kind, expand in (("way", way), ("rue", rue), ("gasse", gasse)):
            for a, _ in at.get(kind, ()):
                if span := expand(text, a):
                    put("address", *span)
        for kind, right in (("mail", _MAIL), ("written", _WRITTEN), ("spoken", _SPOKEN)):
            for a, _ in at.get(kind, ()):
                if span := mail(text, a, right):
                    put("email", *span)
        runs = at.get("digit", ())
        if runs and "scheme" in at:
            urls = [_URL.match(text, a).span() for a, _ in at["scheme"]]
            runs = [r for r in runs if all(r[0] < a or r[0] >= b for a, b in urls)]
        labels = list(at.get("label", ()))
        no_phone = [m.span() for a, _ in runs if a > 1 and (m := IDS["iban"].match(text, a - 2))]
        for a, _ in runs:
            if span := identity(text, a, labels, at.get("goods", ())):
                put("id_number", *span)
                labels.append(span)  # one label may stand before a list
        for a, _ in runs:
            if (span := phone(text, a)) and all(span[1] <= x or span[0] >= y for x, y in no_phone):
                put("phone", *span)
        for run in _RUN.finditer(text):
            for m in _NEXT.finditer(run[0]):
                a, b = run.start() + m.start(), run.start() + m.end(3)
                if all(b <= x or a >= y for x, y in taken):
                    out.append(("person", text[a:b]))
        return list(dict.fromkeys(out))


def way(text: str, a: int) -> tuple[int, int] | None:
    """House number, capital words, a word for a street at a, town, postcode; a flat may come first."""
    m = _WAY.match(text, a)
    if m is None:
        return None
    at = a
    while True:
        start = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at), text.rfind("\t", 0, at)) + 1
        word = text[start:at]
        if at < a and (house := _HOUSE.search(text, start, at)):
            start = house.start()
            flat = _FLAT.search(text, max(0, start - 16), start)
            return (flat.start() if flat else start), m.end()
        if not _CAP_WORD.fullmatch(word) or start == 0 or text[start - 1] != " ":
            return None
        at = start - 1


def rue(text: str, a: int) -> tuple[int, int] | None:
    """House number, the word for a street at a, its name, postcode and town."""
    m = _RUE.match(text, a)
    house = m and _BEFORE_RUE.search(text, max(0, a - 12), a)
    if not house:
        return None
    flat = _FLAT.search(text, max(0, house.start() - 16), house.start())
    return (flat.start() if flat else house.start()), m.end()


def gasse(text: str, a: int) -> tuple[int, int] | None:
    """A capital word that ends in a word for a street at a, house number, postcode and town."""
    m = _GASSE.match(text, a)
    if m is None:
        return None
    start = a
    while start and (text[start - 1].isalnum() or text[start - 1] in "_’'-"):
        start -= 1
    while start < a and not _CAP_WORD.match(text, start):
        start += 1
    return (start, m.end()) if start < a and not text[start - 1 : start].isalnum() else None


def mail(text: str, a: int, right: re.Pattern) -> tuple[int, int] | None:
    """The local part before an at-sign (or what stands for it) at a, and the domain after it; 64 and 253 letters at most."""
    m = right.match(text, a)
    if m is None:
        return None
    end = a - 1 if right is _WRITTEN and text[a - 1 : a] == " " else a
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
        start -= 1
    while start < end and not (text[start].isascii() and text[start].isalnum()):
        start += 1
    last = re.split(r"\W", m[1])[-1]
    return (start, m.end()) if 0 < end - start <= 64 and len(m[1]) <= 253 and len(last) > 1 else None


def identity(text: str, a: int, labels: list, goods: list) -> tuple[int, int] | None:
    """An identity number whose digits begin at a: one that passes its check, or stands shortly after a label for such numbers.

    One of zeros alone is a blank, and one after a word for goods is no identity number, whatever its form.
    """
    for start in (a, a - 1, a - 2, a - 3):
        if start < 0 or (start < a and not text[start].isupper()):
            continue
        for kind, p in IDS.items():
            m = p.match(text, start)
            if m is None:
                continue
            good = genuine(kind, m)
            label = max((e for _, e in labels if start - LABEL_WITHIN <= e <= start), default=-1)
            other = max((e for _, e in goods if start - LABEL_WITHIN <= e <= start), default=-1)
            if good is not None and (label > other or good and other < 0):
                return m.span()
    return None


def phone(text: str, a: int) -> tuple[int, int] | None:
    """A phone number whose digits begin at a: 7 to 15 digits, from the plus or bracket before them."""
    for start in (a - 2, a - 1, a):
        if start < 0 or (start < a and text[start] not in "+("):
            continue
        for p in PHONES:
            if (m := p.match(text, start)) and 7 <= len(digits := re.sub(r"\D", "", m[0])) <= 15 and digits.strip("0"):
                return m.span()
    return None


def _finder():
    held: dict = {}

    def series(texts: pd.Series) -> pd.Series:
        if "f" not in held:
            held["f"] = Finder()
        find = held["f"].passages
        return texts.map(lambda x: [{"kind": k, "passage": p} for k, p in find(x)] if x else [])

    return F.pandas_udf(series, PASSAGES)


def _key(c):
    return F.regexp_replace(F.lower(c), r"\s+", " ")


def given_names(aliases: DataFrame) -> DataFrame:
    """First words (lower case) that begin several different two-word names of artists."""
    two = aliases.select(F.split(F.trim(_key(F.col("name"))), " ").alias("w")).filter("size(w) = 2")
    n = two.groupBy(F.col("w")[0].alias("given")).agg(F.count_distinct(F.col("w")[1]).alias("n"))
    return n.filter((F.col("n") >= GIVEN_AT_LEAST) & ~F.col("given").isin(*NOT_GIVEN) & ~F.col("given").rlike(r"[.,/&\"]")).select("given")


def find(documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id, kind, passage: each passage once for a document.

    Two capital words (an initial may stand between) are a person where the first is a given name and the whole, with or
    without the initial, is no artist's name; both lists are joined, not sent to the workers. Null and empty texts hold
    nothing; a document stored twice is reported under each of its numbers. Empty aliases leave no given names, so no person.
    """
    hits = cut(documents.filter("length(text) > 0").select("doc_id", F.explode(_finder()("text")).alias("h")).select("doc_id", "h.kind", "h.passage"))
    sure = hits.filter("kind != 'person'")
    pairs = hits.filter("kind = 'person'")
    names = aliases.select(F.trim(_key(F.col("name"))).alias("k")).dropDuplicates()
    distinct = pairs.select("passage").dropDuplicates().withColumn("k", _key(F.col("passage"))).withColumn("given", F.split("k", " ")[0])
    held = distinct.join(given_names(aliases), "given", "left_semi").withColumn("plain", F.regexp_replace("k", r" \w\. ", " "))
    private = held.join(names, "k", "left_anti").join(names.withColumnRenamed("k", "plain"), "plain", "left_anti").select("passage")
    return sure.unionByName(pairs.join(private, "passage", "left_semi").select("doc_id", "kind", "passage")).dropDuplicates()


def redact(documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text with each passage replaced by [KIND], n_replaced; other documents stay as they are. Longest passages first."""

    def series(texts: pd.Series, hits: pd.Series) -> pd.Series:
        def one(text, many):
            if text is None or many is None:
                return text
            kinds = {h["passage"]: h["kind"] for h in many}
            by_length = sorted(kinds, key=lambda p: (-len(p), p))
            return re.sub("|".join(map(re.escape, by_length)), lambda m: f"[{kinds[m[0]].upper()}]", text)

        return pd.Series([one(t, h) for t, h in zip(texts, hits, strict=True)], dtype=object)

    per = found.groupBy("doc_id").agg(F.collect_set(F.struct("kind", "passage")).alias("hits"))
    met = documents.select("doc_id", "text").join(per, "doc_id", "left")
    return met.select("doc_id", F.pandas_udf(series, "string")("text", "hits").alias("text"), F.coalesce(F.size("hits"), F.lit(0)).alias("n_replaced"))
