"""Path templates and the switches of lookups."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_path
from .terms import Refused, parse, predicate, values


def path_stem(template: str, default: str = "Unknown") -> Column:
    """A path of a '{field}/{field|field}' template; each value is made safe for file systems, alternatives in order."""
    parts = []
    for literal, fields in re.findall(r"([^{}]+)|\{([\w|]+)\}", template):
        if literal:
            parts.append(F.lit(literal))
        else:
            first = [F.nullif(F.array_join(values(f), ", "), F.lit("")) for f in fields.split("|")]
            parts.append(safe_path(F.coalesce(*first, F.lit(default))))
    if not parts:
        raise Refused("an empty template")
    return F.concat(*parts)


def lookup_verdict(skips: list[list[str]], untils: list[list[str]], schemes: set[str], off: Column, asked: Column, due: Column) -> Column:
    """Why a row is or isn't asked of a provider, by the first that holds: off, skip, done, wait, else ask."""
    skip = reduce(lambda a, b: a | b, [predicate(parse(q, schemes)) for q in skips], F.lit(False))
    done = reduce(lambda a, b: a & b, [predicate(parse(q, schemes)) for q in untils], F.lit(True)) if untils else F.lit(False)
    return F.when(off, "off").when(skip, "skip").when(done, "done").when(asked & ~due, "wait").otherwise("ask")


def rounds(state: DataFrame, ask, most: int = 3) -> DataFrame:
    """ask(state) again and again until it changes nothing, at most so many rounds; a row is its own key."""
    from ..session import cut

    for _ in range(most):
        new = cut(ask(state))
        if new.exceptAll(state).limit(1).count() == 0:
            return new
        state = new
    return state


def overridden(df: DataFrame, overrides: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Fields dropped for the groups an override names (group, drops array<string>)."""
    met = df.join(overrides, group, "left")
    return met.withColumns({f: F.when(F.array_contains(F.coalesce("drops", F.array().cast("array<string>")), f), None).otherwise(F.col(f)) for f in fields}).drop("drops")
