"""Exact duplicates through an extendible-hash index kept on shared files, in DataFrame operations alone.

Every text's key is a 64-bit hash of it with A-Z lower-cased. Copies are first merged into runs (at most RUNS a text), so
that a large group of copies is a few entries. The index deals runs into buckets by the leading bits of their key: the
directory doubles while a bucket holds more than CAPACITY runs, and only overfull buckets split, so that slots which need
fewer bits share one. Buckets and directory are tables in the shared folder. The task that owns a bucket, which is a
range of keys, chains runs whose keys collide, tells them apart by digest and length, and settles which row of a chain's
link stays and how many rows it has. Rows learn it from their own run. Then the bytes of all copies are compared, and
texts that differ although their digests agree are grouped by their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import ROW, fresh, lower_ascii, numbered, written

#: Runs a bucket may hold before it splits, runs that the copies of a text are merged into, and bits of a key.
CAPACITY, RUNS, KEY_BITS = 50_000, 64, 64
TEXT = ["key", "sha", "bytes"]
Hashes = tuple[Callable[[Column], Column], Callable[[Column], Column]]
#: Key and digest of a normalised text.
HASHES: Hashes = (F.xxhash64, lambda text: F.sha2(text, 256))


def leading(key: str, bits: int) -> Column:
    """The leading bits of a 64-bit key as a number; 0 for no bits."""
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


def directory(cells: DataFrame, depth: int, capacity: int) -> DataFrame:
    """Slots of a directory of global depth `depth` with their buckets: (slot, bucket, bits).

    `cells` counts runs `n` by slot. A bucket is named by its first slot; `bits` is its own depth, the least at which
    the runs that share so many leading bits fit into it (or all of them where none do).
    """
    each = cells.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits"))
    each = each.withColumn("prefix", F.expr(f"shiftright(slot, {depth} - bits)"))
    fits = each.groupBy("bits", "prefix").agg(F.sum("n").alias("runs")).where((F.col("runs") <= capacity) | (F.col("bits") == depth))
    own = each.join(fits.select("bits", "prefix"), ["bits", "prefix"]).groupBy("slot").agg(F.min("bits").alias("bits"))
    return own.select("slot", F.expr(f"shiftleft(shiftright(slot, {depth} - bits), {depth} - bits)").alias("bucket"), "bits")


def build_index(runs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Writes the stored runs (key, sha, bytes, run, keep, size) to buckets in the shared folder and reads them back."""
    depth = max(0, (4 * runs.count() // capacity).bit_length() - 1)
    while True:
        cells = runs.groupBy(leading("key", depth).alias("slot")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        cells = written(cells, "cells")
        # a bucket of one key cannot split: its texts are chained
        if depth == KEY_BITS - 1 or cells.where((F.col("n") > capacity) & (F.col("low") < F.col("high"))).isEmpty():
            break
        depth += 1
    slots = written(directory(cells, depth, capacity), "directory")
    buckets = max(1, slots.select("bucket").distinct().count())
    dealt = runs.withColumn("slot", leading("key", depth)).join(slots, "slot").drop("slot", "bits")
    return written(dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", *TEXT), "index")


def settled(index: DataFrame) -> DataFrame:
    """What the owners of the buckets find: each run with its place in the chain of its key, and its text's row and size."""
    key = Window.partitionBy("bucket", "key")
    text = Window.partitionBy("bucket", *TEXT)
    owned = index.repartition("bucket").withColumn("chain", F.dense_rank().over(key.orderBy("sha", "bytes")))
    return owned.select(*TEXT, "run", "chain", F.max("keep").over(text).alias("keep"), F.sum("size").over(text).alias("size"))


def _latest() -> Column:
    return F.max(F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", *ROW)).alias("keep")


def _found(docs: DataFrame, capacity: int, hashes: Hashes) -> DataFrame:
    """Rows of the numbered table `docs` with the row that stays of their group, and its size."""
    norm = lower_ascii(F.coalesce("text", F.lit("")))
    slim = docs.select(*ROW, F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))
    slim = slim.select(*ROW, "doc_id", hashes[0](F.col("norm")).alias("key"), hashes[1](F.col("norm")).alias("sha"), F.octet_length("norm").cast("long").alias("bytes"))
    slim = written(slim.withColumn("run", F.pmod(F.hash(*ROW), F.lit(RUNS))), "keys")
    runs = written(slim.groupBy(*TEXT, "run").agg(_latest(), F.count("*").alias("size")), "runs")
    owned = settled(build_index(runs, capacity))
    found = written(slim.join(owned, [*TEXT, "run"]), "found")

    # bytes of the copies: a text's least and greatest copy agree
    copies = found.where("size > 1").select(*ROW, *TEXT)
    texts = docs.select(*ROW, norm.alias("norm"))
    differing = texts.join(copies, ROW).groupBy(*TEXT).agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high")
    differing = written(differing.select(*TEXT), "differing")
    if differing.isEmpty():
        return found
    again = texts.join(found.join(differing, TEXT, "left_semi").select(*ROW, "doc_id"), ROW)
    parted = again.select("norm", *ROW).join(again.groupBy("norm").agg(_latest(), F.count("*").alias("size")), "norm")
    parted = parted.select(*ROW, F.col("keep").alias("own_keep"), F.col("size").alias("own_size"))
    return found.join(parted, ROW, "left").withColumn("keep", F.coalesce("own_keep", "keep")).withColumn("size", F.coalesce("own_size", "size"))


def _stays() -> Column:
    return (F.col("row_file") == F.col("keep.row_file")) & (F.col("row_at") == F.col("keep.row_at"))


def groups(docs: DataFrame, capacity: int = CAPACITY, hashes: Hashes = HASHES) -> DataFrame:
    """Group of equal texts for each row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of a group the largest doc_id stays, null ids last; of rows with that id one, whichever is stored last. Null texts
    equal the empty text. Texts of any length are whole; other columns are ignored; an empty table gives an empty table.
    """
    found = _found(numbered(docs.select("doc_id", "text")), capacity, hashes)
    return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), _stays().alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with the columns of docs whatever their names; ties and nulls as in `groups`."""
    names = fresh(docs, *ROW)
    stored = numbered(docs, names)
    found = _found(stored.select(*[F.col(a).alias(b) for a, b in zip(names, ROW, strict=True)], "doc_id", "text"), CAPACITY, HASHES)
    gone = written(found.where(~_stays()).select(*[F.col(a).alias(b) for a, b in zip(ROW, names, strict=True)]), "gone")
    return stored.join(gone, names, "left_anti").drop(*names)
