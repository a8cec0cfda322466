"""The retention matrix against SQL on the given tables and against loops over rows with nulls, copies and odd columns."""

import math
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import pytest

from foliant.llm import queries, retention

COLUMNS = ["state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents"]
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, client string, salt int, whole int"
CLIENTS = "client_id long, segment string, client int, start0 string"


def crc(n):
    return zlib.crc32(str(n).encode())


def by_loops(clicks, clients):
    segments = {}
    for client, segment, *_ in clients:
        if client is not None and segment is not None:
            segments[client] = min(segments.get(client, segment), segment)
    rows = [r for r in dict.fromkeys(clicks) if r[1] is not None and r[3] is not None]
    cutoff, day, zero = datetime(2024, 2, 15), timedelta(days=1), datetime(1970, 1, 1)
    starts, views = [{}, {}], [[], []]
    for r in rows:
        late = r[0] is not None and crc(r[0]) % 3 == 0
        arrives = r[2] and r[2] + timedelta(days=crc(r[0]) % 100 if late else 0)
        for state in [0, 1] if arrives is not None and arrives < cutoff else [1]:
            views[state].append(r)
            if r[4] == "signup":
                starts[state][r[3]] = min(starts[state].get(r[3], r[1]), r[1])
    found = defaultdict(lambda: [set(), 0])
    for state in (0, 1):
        for r in views[state]:
            start = starts[state].get(r[3])
            if start is not None and r[1] >= start:
                cell = found[state, segments.get(r[3], ""), (start - zero) // day, (r[1] - start) // day]
                cell[0].add(r[3])
                cell[1] += math.floor(r[5] * 100 + 0.5) if r[5] is not None and abs(r[5]) < 1e13 else 0
    moved = {c for c in starts[1] if c in starts[0] and (starts[0][c] - zero) // day != (starts[1][c] - zero) // day}
    return sorted((*k, len(users), sum(map(crc, users)), len(users & moved), cents) for k, (users, cents) in found.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def clicks():
    draw = random.Random(13)
    out = []
    for i in range(1500):
        at = datetime(2024, 1, 1) + timedelta(microseconds=draw.choice([86_400_000_000 * draw.randrange(110), draw.randrange(110 * 86_400_000_000)]))
        client = draw.choice([None, -5, *[7] * 20, *[8] * 20, *range(60)])
        kind = draw.choice(["signup", "view", "click", None, "view"]) if client != 8 else "view"
        value = draw.choice([None, 0.005, -2.675, 1e300, math.inf, -0.0, 12.34, draw.random() * 1000])
        out.append((draw.choice([None, i, i]), draw.choice([None, at, at, at, at, at]), draw.choice([None, at, at, at, at]), client, kind, value, draw.choice(["", None, "{}"]), "x", 1, 2))
    return [*out, *out[:200], *[out[3]] * 30]


CLIENT_ROWS = [(7, "b", 1, "x"), (7, "a", 1, "x"), (-5, None, 1, "x"), (None, "q", 1, "x"), *[(i, ["p", "q", None, ""][i % 4], 1, "x") for i in range(9, 40)], (10, "p", 1, "x")]


@pytest.mark.parametrize("hot", [1000, 8])
def test_retention_equals_loops(spark, clicks, hot):
    """Client 7 has a third of the clicks; client 8 as many, but no start."""
    got = retention.cells(spark.createDataFrame(clicks, CLICKS).repartition(5), spark.createDataFrame(CLIENT_ROWS, CLIENTS), hot=hot)
    want = by_loops(clicks, CLIENT_ROWS)
    assert rows_of(got) == want
    assert sum(r[6] for r in want) > 0 and {r[0] for r in want} == {0, 1}


def test_retention_takes_times_with_a_zone(spark, clicks):
    zoned = spark.createDataFrame(clicks, CLICKS).selectExpr("click_id", "cast(ts as timestamp) ts", "cast(arrived_at as timestamp) arrived_at", "client_id", "kind", "value", "props")
    want = by_loops([r[:7] for r in clicks], CLIENT_ROWS)
    assert rows_of(retention.cells(zoned, spark.createDataFrame(CLIENT_ROWS, CLIENTS))) == want


def test_retention_of_empty_tables(spark, clicks):
    none, clients = spark.createDataFrame([], CLICKS), spark.createDataFrame([], CLIENTS)
    assert retention.cells(none, clients).collect() == []
    assert rows_of(retention.cells(spark.createDataFrame(clicks, CLICKS), clients)) == by_loops(clicks, [])


def test_retention_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("clicks", "clients"):
        con.sql(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    want = con.sql(queries.ORACLE["op13_retention"]).project(", ".join(COLUMNS)).fetchall()
    assert rows_of(queries.op13_retention(spark, sf_dir)) == sorted(want)
