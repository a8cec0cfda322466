"""Whitening against numpy and whole-number arithmetic in Python, on vectors with copies, nulls and odd entries."""

import math

import numpy as np
import pytest

from foliant.llm import queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, n int, parts string, Deviation int"


def by_numpy(rows, keep=4):
    """vec_id -> deviation, and what the fit list gives."""
    usable = [(r[0], [math.floor(float(np.float32(v)) * 256) for v in r[1]]) for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    far = lambda x: sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    rank = np.linalg.matrix_rank(centred)
    values, vectors = values[::-1][: min(keep, rank)], vectors[:, ::-1][:, : min(keep, rank)]
    trace = sum(map(far, fit)) / n**3
    return usable, n, far, sums, values, vectors, trace


def check(rows, got):
    usable, n, far, sums, values, vectors, trace = by_numpy(rows)
    assert len(got) == len(usable) * len(values)
    found = {}
    for r in got:
        found.setdefault(r["vec_id"], {})[r["component"]] = r
        assert r["n"] == n and math.isclose(r["explained"], values[r["component"] - 1] / trace, rel_tol=1e-9) and r["identity_error"] < 1e-9
    signs = np.zeros(len(values))
    for vec_id, x in usable:
        want = (np.array([n * v - s for v, s in zip(x, sums, strict=True)]) / n) @ vectors / np.sqrt(values)
        mine = np.array([found[vec_id][i + 1]["whitened"] for i in range(len(values))])
        assert all(found[vec_id][i + 1]["deviation"] == far(x) for i in range(len(values)))
        np.testing.assert_allclose(np.abs(mine), np.abs(want), atol=1e-7)
        signs = np.where(np.abs(want) > 1e-3, np.sign(want * mine), signs)
        assert all(s in (0, v) for s, v in zip(np.where(np.abs(want) > 1e-3, np.sign(want * mine), 0), signs, strict=True))


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)
    base = draw.normal(size=(300, 9)) * np.array([3, 2.5, 2, 1.5, 1, 0.8, 0.6, 0.4, 0.2]) + 5
    out = [(i, [float(v) for v in x], i % 3, "x", 1, "p", 2) for i, x in enumerate(base)]
    bad = [None, [], [1.0, None] + [0.0] * 7, [math.nan] + [0.0] * 8, [math.inf] + [0.0] * 8, [1e30] + [0.0] * 8, [1.0, 2.0]]
    out += [(1000 + i, v, 0, "x", 1, "p", 2) for i, v in enumerate(bad)]
    return out + [(2000 + i, out[i % 2][1], 0, "x", 1, "p", 2) for i in range(200)] + [(3000, [-0.0] * 9, 0, "x", 1, "p", 2)]


def test_whitening_equals_numpy(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    usable = [r for r in rows if not r[1] or len(r[1]) == 9 and r[1][0] != 1e30]
    check(usable, whitening.by_component(df).collect())
    assert whitening.whiten(df).columns == [*df.columns, "n_", "deviation_", "parts_"]


def test_whitening_of_low_rank(spark):
    line = [(i, [float(i), float(i), 1.0], 0, "", 1, "", 1) for i in range(6)]
    check(line, whitening.by_component(spark.createDataFrame(line, VECTORS)).collect())
    same = [(i, [1.0, 2.0, 3.0], 0, "", 1, "", 1) for i in range(3)]
    for few in (same, same[:1], []):
        assert whitening.by_component(spark.createDataFrame(few, VECTORS)).collect() == []


def test_whitening_query_equals_numpy(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check([tuple(r) for r in table], queries.op11_whitening(spark, "/root/testdata/sf0.001").collect())
