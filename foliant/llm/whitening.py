"""Whitening of embeddings: principal components of integer-scaled vectors by MLlib, with exact deviations beside them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import fresh, quoted
from foliant.session import stored

SCALE = 256
KEEP = 4
#: Entries whose scaled value fits no 32-bit integer cannot be summed exactly; such a row goes as one with an infinite entry does.
MOST = 1 << 31
#: Components whose eigenvalue is below this part of the trace are rounding noise of a matrix of lower rank.
NOISE = 1e-13


@dataclass
class Whitening:
    """What is learned from the fit list: its size, sums by dimension, unit eigenvectors in rows, eigenvalues, trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None


def scaled(df: DataFrame, vector: str = "embedding", name: str = "x") -> DataFrame:
    """Rows whose vector is whole, with floor(256 * entry) as an array of longs in column `name`.

    A vector that is null, empty, or holds null, non-finite or unbounded entries goes, as does one whose length is not
    the most frequent among the others (of equally frequent ones the longest).
    """
    entries = F.col(vector)
    bad = F.exists(entries, lambda c: F.coalesce(~(F.abs(c.cast("double")) < MOST / SCALE), F.lit(True)))
    usable = df.where(entries.isNotNull() & (F.size(entries) > 0) & ~F.coalesce(bad, F.lit(True)))
    length = usable.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    usable = usable.where(F.size(vector) == F.lit(length["n"] if length else 0))
    return usable.withColumn(name, F.transform(entries, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def fit(vectors: DataFrame, keep: int = KEEP, name: str = "x") -> Whitening | None:
    """Learns from distinct x-vectors; None of an empty table, and no components where all vectors are equal.

    Rows of the distributed matrix are (n * x - S) / n, whose numerators are exact integers. Its right singular vectors
    are the components and its squared singular values over n the eigenvalues of the covariance. All singular values are
    asked for, so that MLlib decomposes the whole Gram matrix, of one row a dimension, to double precision.
    """
    distinct = stored(vectors.select(F.col(name).alias("x")).distinct(), "fit-list")
    first = distinct.first()
    if first is None:
        return None
    dims = len(first["x"])
    entry = [F.sum(F.get("x", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)]
    n, *sums = map(int, distinct.agg(F.count("*"), *entry).first())
    total = int(distinct.agg(F.sum(deviation(F.col("x"), n, sums))).first()[0])
    model = Whitening(n, sums, np.zeros((0, dims)), np.zeros(0), total / n**3)
    if not total:
        return model
    centred = F.transform(_apart(F.col("x"), n, sums), lambda d: d / F.lit(float(n)))
    rows = distinct.select(array_to_vector(centred).alias("row"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row")).computeSVD(dims, computeU=False)
    values = np.asarray(found.s.toArray()) ** 2 / n
    stays = values > NOISE * model.trace
    vectors_ = found.V.toArray().T[: len(values)][stays][:keep]
    largest = vectors_[np.arange(len(vectors_)), np.abs(vectors_).argmax(axis=1)]
    model.components, model.eigenvalues = vectors_ * np.sign(largest)[:, None], values[stays][:keep]
    model.identity_error = _identity_error(distinct, model)
    return model


def deviation(x: Column, n: int, sums: list[int]) -> Column:
    """The sum over dimensions of (n * x - S)^2, exact, as decimal(38, 0); sums of more digits are an error."""
    square = lambda d: (d.cast("decimal(19,0)") * d.cast("decimal(18,0)")).cast("decimal(38,0)")
    return F.aggregate(_apart(x, n, sums), F.lit(0).cast("decimal(38,0)"), lambda total, d: (total + square(d)).cast("decimal(38,0)"))


def whitened(x: Column, model: Whitening) -> list[Column]:
    """Coordinates along each component, of unit variance over the fit list."""
    out = []
    for component, value in zip(model.components, model.eigenvalues, strict=True):
        weights = F.lit([float(v) for v in component / np.sqrt(value) / model.n])
        products = F.zip_with(_apart(x, model.n, model.sums), weights, lambda d, w: d * w)
        out.append(F.aggregate(products, F.lit(0.0), lambda total, p: total + p))
    return out


def whiten(df: DataFrame, vector: str = "embedding", keep: int = KEEP) -> DataFrame:
    """All rows with a whole vector, their columns as they are, with (n, deviation, parts); parts holds, by component,
    (component, whitened, explained, identity_error).

    Rows that repeat stay as often as they come and count once in the fit list. A fit list whose covariance has a lower
    rank than `keep` gives as many components as its rank; one vector alone, none. Empty tables give no rows.
    """
    name, n_, far, parts = fresh(df, "x", "n", "deviation", "parts")
    rows = scaled(df, vector, name)
    model = fit(rows, keep, name)
    if model is None:
        model = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    x = F.col(name)
    trace = model.trace
    columns = [
        F.struct(F.lit(i + 1).alias("component"), w.alias("whitened"), F.lit(float(e / trace)).alias("explained"), F.lit(float(model.identity_error)).alias("identity_error"))
        for i, (w, e) in enumerate(zip(whitened(x, model), model.eigenvalues, strict=True))
    ]
    kind = "array<struct<component:int,whitened:double,explained:double,identity_error:double>>"
    return rows.select(*quoted(df), F.lit(model.n).cast("long").alias(n_), deviation(x, model.n, model.sums).alias(far), F.array(*columns).cast(kind).alias(parts))


def by_component(df: DataFrame) -> DataFrame:
    """One row for each vector of `embeddings` and component. A deviation beyond a long's range is null."""
    df = df.select(F.col("vec_id"), F.col("embedding"))
    rows = whiten(df).select("vec_id", "n", F.expr("try_cast(deviation as long)").alias("deviation"), F.explode("parts").alias("part"))
    return rows.select("vec_id", "part.component", "n", "deviation", "part.whitened", "part.explained", "part.identity_error")


def _apart(x: Column, n: int, sums: list[int]) -> Column:
    """n * x - S by dimension, in whole numbers; |x| < 2^31 keeps it a long up to n = 2^31."""
    return F.zip_with(x, F.array(*[F.lit(s).cast("long") for s in sums]).cast("array<long>"), lambda v, s: v * F.lit(n).cast("long") - s)


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry, in absolute value, of the whitened fit list's covariance minus the identity."""
    names = [f"w{i}" for i in range(len(model.components))]
    rows = distinct.select(*[w.alias(c) for w, c in zip(whitened(F.col("x"), model), names, strict=True)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = rows.agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))
