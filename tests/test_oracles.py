"""Every query with SQL gives what DuckDB gives on the smallest tables; every other one runs and has its columns."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else float(v) if type(v).__name__ == "Decimal" else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


CORE = [m for m in entry._modules() if "llm" not in m.__name__]
NAMES = sorted(n for m in CORE for n in m.queries())
SQL = {k: v for m in CORE for k, v in m.oracle_sql().items()}


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    got = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        r = duck.sql(SQL[name])
        want = r.fetchall()
        assert sorted(df.columns) == sorted(r.columns)
        assert rows(df.columns, got) == rows(list(r.columns), want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
