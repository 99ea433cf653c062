"""The queries of the core operators."""

from __future__ import annotations

from ..operators import packed
from ..session import table as t
from .library import QUERIES, SQL


def queries() -> dict:
    found = {"p4_found": lambda s, d: packed.found(t(s, d, "video_infos"), t(s, d, "records"), t(s, d, "aliases"), t(s, d, "genres"))}
    return found | QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
