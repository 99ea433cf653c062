"""The query language: terms of text compiled to a predicate over views of records.

A view has keys array<string>, tags map<string,array<string>>, path string, and the booleans cover, soft_cover, lyrics,
timed, with sources (from) and given names of tags (has).
"""

from __future__ import annotations

import re
import shlex
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import TYPOGRAPHY, query_fold

CLOSED = {"lyrics": ("yes", "none", "timed", "untimed"), "cover": ("yes", "none", "sharp", "small")}
MEMBERS = {"from": "from", "has": "given"}
BARE = ("title", "artist", "album", "albumartist")


class Refused(ValueError):
    """A query that can't be read."""


@dataclass(frozen=True)
class Term:
    kind: str  # word, key, contains, equals, regex, closed, member
    field: str
    text: str
    negated: bool


def plain_fold(text: str) -> str:
    """query_fold of a constant."""
    text = unicodedata.normalize("NFD", text.translate(str.maketrans(*TYPOGRAPHY)).replace("…", "..."))
    return re.sub(r"[\r\n\t]+", " ", "".join(c for c in text if not unicodedata.combining(c)).lower())


def parse(terms: list[str], schemes: set[str]) -> list[Term]:
    """Terms of a command line; ^ negates; scheme:id is a key; field:text, field:=text and field::regex test a field."""
    out = []
    for raw in terms:
        negated, text = raw.startswith("^"), raw.removeprefix("^")
        if not text:
            raise Refused("an empty term")
        m = re.match(r"([A-Za-z_]\w*):(:|=)?(.*)$", text, re.S)
        if not m:
            out.append(Term("word", "", plain_fold(text), negated))
            continue
        field, how, value = m[1].lower(), m[2] or "", m[3]
        if field in CLOSED:
            if how or value not in CLOSED[field]:
                raise Refused(f"{field} is one of {', '.join(CLOSED[field])}")
            out.append(Term("closed", field, value, negated))
        elif field in MEMBERS:
            if how == ":":
                raise Refused(f"{field} takes a whole value")
            out.append(Term("member", field, plain_fold(value), negated))
        elif field in schemes and not how:
            out.append(Term("key", field, text, negated))
        elif how == ":":
            try:
                re.compile(value)
            except re.error as e:
                raise Refused(f"no pattern: {value}") from e
            folded = "".join(c for c in unicodedata.normalize("NFD", value) if not unicodedata.combining(c))
            out.append(Term("regex", field, folded, negated))
        else:
            out.append(Term("equals" if how else "contains", field, plain_fold(value), negated))
    return out


def parse_text(text: str, schemes: set[str]) -> list[Term]:
    """One text split as a shell does; quotes keep words together. An empty text is refused here."""
    try:
        terms = shlex.split(text)
    except ValueError as e:
        raise Refused(str(e)) from e
    if not terms:
        raise Refused("an empty query")
    return parse(terms, schemes)


def check_fields(terms: list[Term], known: set[str], present: set[str]) -> None:
    for t in terms:
        if t.kind in ("contains", "equals", "regex") and t.field not in known | present | {"year"}:
            raise Refused(f"no field {t.field}")


def values(field: str) -> Column:
    if field == "year":
        return F.transform(F.coalesce(F.col("tags")["date"], F.array()), lambda v: F.substring(v, 1, 4))
    return F.coalesce(F.col("tags")[field], F.array().cast("array<string>"))


def _any(field: str, test) -> Column:
    return F.exists(values(field), lambda v: F.coalesce(test(query_fold(v)), F.lit(False)))


def _test(t: Term) -> Column:
    if t.kind == "key":
        return F.array_contains("keys", t.text)
    if t.kind == "closed":
        has, better = ("lyrics", "timed") if t.field == "lyrics" else ("cover", "soft_cover")
        yes, extra = F.coalesce(F.col(has), F.lit(False)), F.coalesce(F.col(better), F.lit(False))
        return {"yes": yes, "none": ~yes, "timed": yes & extra, "untimed": yes & ~extra, "small": yes & extra, "sharp": yes & ~extra}[t.text]
    if t.kind == "member":
        return F.exists(F.coalesce(F.col(MEMBERS[t.field]), F.array().cast("array<string>")), lambda v: query_fold(v) == t.text)
    if t.kind == "contains":
        return _any(t.field, lambda v: F.contains(v, F.lit(t.text)))
    if t.kind == "equals":
        return _any(t.field, lambda v: v == t.text)
    if t.kind == "regex":
        return _any(t.field, lambda v: v.rlike("(?i)" + t.text))
    each = [reduce(lambda a, b: a | b, [_any(f, lambda v, w=w: F.contains(v, F.lit(w))) for f in BARE]) for w in t.text.split()]
    key = F.exists("keys", lambda k: query_fold(F.regexp_replace(k, "^[^:]*:", "")) == t.text)
    file = query_fold(F.regexp_replace(F.coalesce("path", F.lit("")), r"^.*/", ""))
    name = (file == t.text) | (F.regexp_replace(file, r"\.[^.]*$", "") == t.text)
    return reduce(lambda a, b: a & b, each) | key | name


def predicate(terms: list[Term]) -> Column:
    """All terms hold, but of several positive keys one is enough. No terms: every row.

    A missing field has no values: positive terms are false, negated ones true.
    """
    keys = [_test(t) for t in terms if t.kind == "key" and not t.negated]
    rest = [~F.coalesce(_test(t), F.lit(False)) if t.negated else F.coalesce(_test(t), F.lit(False)) for t in terms if t.kind != "key" or t.negated]
    all_ = rest + ([reduce(lambda a, b: a | b, keys)] if keys else [])
    return reduce(lambda a, b: a & b, all_) if all_ else F.lit(True)


def output(template: str) -> Column:
    """A line of a '{field}' template: values joined by '; ', line breaks and tabs shown; {key} is the first key."""
    from ..functions.text import escaped

    parts = []
    for literal, field in re.findall(r"([^{]+)|\{(\w+)\}", template):
        if literal:
            parts.append(F.lit(literal))
        elif field == "key":
            parts.append(F.coalesce(F.get("keys", F.lit(0)), F.lit("")))
        elif field == "path":
            parts.append(F.coalesce("path", F.lit("")))
        else:
            parts.append(escaped(F.array_join(values(field.lower()), "; ")))
    return F.concat(*parts) if parts else F.lit("")


def assignments(args: list[str]) -> tuple[dict[str, list[str]], list[str]]:
    """NAME=VALUE and NAME! (clear) taken from the arguments of `set`; the rest are query terms."""
    sets: dict[str, list[str]] = {}
    rest = []
    for a in args:
        if m := re.fullmatch(r"([A-Za-z]\w*)=(.*)", a, re.S):
            sets.setdefault(m[1].lower(), []).append(m[2])
        elif m := re.fullmatch(r"([A-Za-z]\w*)!", a):
            sets[m[1].lower()] = []
        else:
            rest.append(a)
    return sets, rest


def assigned(sets: dict[str, list[str]], where: Column) -> Column:
    """The tags with the assignments made on the rows where the predicate holds."""
    tags = F.coalesce(F.col("tags"), F.create_map().cast("map<string,array<string>>"))
    kept = F.map_filter(tags, lambda k, _: ~k.isin(*sets)) if sets else tags
    new = F.create_map(*[x for k, v in sets.items() if v for x in (F.lit(k), F.array(*map(F.lit, v)))]) if any(sets.values()) else None
    return F.when(where, F.map_concat(kept, new) if new is not None else kept).otherwise(F.col("tags"))
