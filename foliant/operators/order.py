"""Positions and running sums over all rows or large groups, in ranges, so that no task sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import stored

PART, PLACE = "__part", "__place"


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds running sums, each row's own included: `sums` maps columns to the names of their sums, within `by` by `order`.

    Rows are laid out in ranges of (by, order) and written; a range adds up its rows and the sums of the ranges before it.
    """
    saved = stored(rows.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id()), "ranges")
    per = saved.groupBy(PART, *by).agg(*[F.sum(c).alias(n) for c, n in sums.items()])
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(PART, *by, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums.values()])
    so_far = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = saved.select("*", *[F.sum(c).over(so_far).alias(n) for c, n in sums.items()])
    same = [inside[c].eqNullSafe(starts[c]) for c in (PART, *by)]
    joined = inside.join(starts, same)
    return joined.select(*[inside[c] for c in rows.columns], *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums.values()])


def positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's place from 0 by `order`, whose values name a row."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id())
    saved = stored(ranged.withColumn(PART, F.shiftright(PLACE, 33)), "positions")
    per = saved.groupBy(PART).agg(F.min(PLACE).alias("__least"), F.count("*").alias("__n"))
    # one row per range of the table
    before = F.coalesce(F.sum("__n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select(PART, "__least", before.alias("__before"))
    return saved.join(starts, PART).withColumn(name, F.col("__before") + F.col(PLACE) - F.col("__least")).select(*rows.columns, name)
