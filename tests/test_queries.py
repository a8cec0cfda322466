"""Every registered query with SQL against DuckDB on the small tables."""

import duckdb
import pytest

from foliant.queries import MODULES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for m in MODULES for n in m.ORACLE]


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_names_are_unique():
    names = [n for m in MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))
    assert set(NAMES) <= set(names)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    module = next(m for m in MODULES if name in m.QUERIES)
    df = module.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    there = duck.sql(module.ORACLE[name])
    assert sorted(there.columns) == columns
    at = [there.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in there.fetchall()]
    got = [tuple(plain(x) for x in r) for r in df.select(*columns).collect()]
    assert ordered(got) == ordered(want)
