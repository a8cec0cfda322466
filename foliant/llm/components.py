"""Connected components of a link table by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import written


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Links (a long, b long) to (node, comp): comp is the smallest node that links lead to.

    Nodes without links are absent. The steps end when no link changes; a chain of n nodes takes about log2(n) rounds.
    Self-links and repeated links do no harm; an empty table gives an empty table.
    """
    links = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    mark = _mark(links)
    for _ in range(rounds):
        links = written(_small_star(_large_star(links)), "links")
        last, mark = mark, _mark(links)
        if mark == last:
            break
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    return links.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp").unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    )


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest node among it and its neighbours."""
    both = links.select("a", "b").union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return both.join(least, "a").where("b > a and b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    links = links.distinct()
    moved = links.join(links.groupBy("a").agg(F.min("b").alias("least")), "a")
    pairs = F.explode(F.array(F.struct(F.col("a").alias("a")), F.struct(F.col("b").alias("a"))))
    return moved.select(pairs.alias("x"), F.col("least").alias("b")).select("x.a", "b").where("a <> b").distinct()
