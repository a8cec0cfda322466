"""Mixing sources to target weights by systematic sampling, all in DataFrame operations.

Within a source, documents lie in order of size and id; a running sum of expected copies (the same rate for each)
starts at one random offset, and a document is taken once for each integer that the sum crosses on its way over it.
Taking sizes in order keeps the words taken within about one large document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import ROW, WORD, fresh, numbered, written

#: Weights of the sources in code point order, repeating; most copies of a document; seed of the offsets.
WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def offset(source: Column) -> Column:
    """A number in [0, 1) drawn from the source's name."""
    name = F.concat(F.lit(SEED + ":"), F.coalesce(source, F.lit("")), F.when(source.isNull(), "?").otherwise("!"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds `target` to a row per source (source, source_size): shares of all words by weight, none above `most` sizes.

    Words above a source's limit go to the others by weight until none is above, which is the level at which the
    weighted shares, each cut at its limit, add up to all words; it lies behind the sources whose limits are lowest for
    their weight. Windows without a partition see a row per source. Sources without words have target 0.
    """
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    limits = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cut = limits.withColumn("capped", F.coalesce(F.sum("cap").over(order), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    level = (F.sum("source_size").over(whole) - F.col("capped")) / (F.sum("weight").over(whole) - F.col("weight_before"))
    # the level rises over sources that stay above it when cut, and falls behind the first that does not
    found = F.max("level").over(whole)
    return cut.withColumn("level", level).withColumn("target", F.least("cap", F.col("weight") * found)).select("source", "source_size", "target")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """How often the mix takes each row of `docs` (doc_id, text, source).

    Returns doc_id, size, source_size, target, copies and the names of the row. A null text has size 0, a null source is
    a source of its own behind the others, a null id stands first in its size. Rows alike in source, size and id may
    stand in either order, which leaves the result the same. Other columns are ignored; an empty table gives an empty
    table.
    """
    return _taken(numbered(docs.select("doc_id", "source", "text")), weights, most)


def _taken(docs: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    # words are counted once: what follows, the sample for the ranges too, reads their numbers
    slim = written(docs.select(*ROW, "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    # ranges of (source, size, id): their number follows the data, and one source may fill many of them
    ranged = slim.repartitionByRange("source", "size", "doc_id").sortWithinPartitions("source", "size", "doc_id")
    place = F.monotonically_increasing_id()
    ranged = written(ranged.withColumn("__place", place).withColumn("part", F.shiftright("__place", 33)), "mix")
    per_part = ranged.groupBy("part", "source").agg(F.min("__place").alias("least"), F.count("*").alias("n"), F.sum("size").alias("words"))
    per_part = written(per_part, "parts")
    sizes = per_part.groupBy("source").agg(F.sum("words").alias("source_size"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_part.withColumn("before", before)
    rated = targets(sizes, weights, most).withColumn("offset", offset(F.col("source")))
    starts = starts.join(rated, starts["source"].eqNullSafe(rated["source"])).select("part", starts["source"], "least", "before", "source_size", "target", "offset")
    joined = ranged.join(starts, (ranged["part"] == starts["part"]) & ranged["source"].eqNullSafe(starts["source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("before") + F.col("__place") - F.col("least")
    taken = F.floor(F.least(F.lit(float(most)), rate) * (rank + 1) + F.col("offset")) - F.floor(F.least(F.lit(float(most)), rate) * rank + F.col("offset"))
    return joined.select(*ROW, "doc_id", "size", "source_size", "target", taken.cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken, with the columns of docs whatever their names."""
    names = fresh(docs, *ROW)
    times, copy = fresh(docs, "mix_times", "mix_copy")
    stored = numbered(docs, names)
    taken = _taken(stored.select(*[F.col(a).alias(b) for a, b in zip(names, ROW, strict=True)], "doc_id", "source", "text"), weights, most)
    taken = taken.where("copies > 0").select(*[F.col(a).alias(b) for a, b in zip(ROW, names, strict=True)], F.col("copies").alias(times))
    return stored.join(taken, names).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(*names, times, copy)
