"""Written-out cases of the operators against what is expected of them, and the store's queries on a small written-out store."""

import duckdb
import pytest

from foliant.queries import documents, fixtures
from tests import literal_cases
from tests.test_queries import ordered, plain

STORED = [n for n, sql in documents.ORACLE.items() if fixtures.STORE_SQL in sql]


def compared(df, sql):
    columns = sorted(df.columns)
    there = duckdb.sql(sql)
    assert sorted(there.columns) == columns
    at = [there.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in there.fetchall()]
    got = [tuple(plain(x) for x in r) for r in df.select(*columns).collect()]
    assert ordered(got) == ordered(want) and want


@pytest.mark.parametrize("name", list(literal_cases.ORACLE))
def test_written_cases(spark, name):
    compared(literal_cases.QUERIES[name](spark, None), literal_cases.ORACLE[name])


@pytest.mark.parametrize("name", STORED)
def test_queries_on_a_small_store(spark, monkeypatch, name):
    monkeypatch.setattr(documents, "store", literal_cases.store)
    monkeypatch.setattr(documents, "page_text", literal_cases.page_text)
    sql = documents.ORACLE[name].replace(fixtures.STORE_SQL, literal_cases.STORE_SQL).replace(fixtures.PAGES_SQL, literal_cases.PAGES_SQL)
    compared(documents.QUERIES[name](spark, None), sql)


def test_the_store_has_all_queries():
    assert len(STORED) >= 13
