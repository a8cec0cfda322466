"""Shared pieces of the training-data operators: shared storage, names of rows that hold across scans, bounded batches."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import stored as written  # noqa: F401

#: A word is a maximal run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Columns that together name a row of a numbered table.
ROW = ["row_file", "row_at"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, names: list[str] = ROW) -> DataFrame:
    """`df` with two columns that name each row: a hash of its file's path, and its place in that file.

    These come from the stored file and not from how a scan is split, so they hold however often, and with however many
    executors, the table is read. What is no scan of Parquet files, each once, is written to the shared folder first.
    """
    if _is_scan(df):
        try:
            return _named(df, names)
        except AnalysisException:  # stored in another format
            pass
    return _named(written(df, "numbered"), names)


def _is_scan(df: DataFrame) -> bool:
    """Whether the plan takes rows of one stored table as they are, each once: columns are chosen and rows filtered.

    A filter that draws rows, and a file that is listed twice, make it no such plan.
    """
    plan = df._jdf.queryExecution().analyzed()
    steps = [line.lstrip(" :+-") for line in plan.toString().splitlines()]
    if not all(re.match(r"(Project|Filter|Relation|SubqueryAlias)\b", s) for s in steps if s) or not plan.deterministic():
        return False
    leaf = plan.collectLeaves().apply(0)
    try:
        listed = len(leaf.relation().location().inputFiles())
    except Py4JError:  # no table of files
        return False
    return listed == len(df._jdf.inputFiles())


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    taken = {c.lower() for c in df.columns}
    if taken & {n.lower() for n in names}:
        raise ValueError(f"the table has columns named {names}")
    return df.select("*", F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1]))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that `df` does not have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        out.append(stem)
    return out


def quoted(df: DataFrame) -> list[Column]:
    """The columns of `df` by name, whatever signs the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Stands for a null id on the way through pandas, which has no null among its integers.
NULL_ID = -(1 << 63)


def id_in(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID)).alias(name)


def id_out(name: str = "doc_id") -> Column:
    return F.nullif(F.col(name), F.lit(NULL_ID)).alias(name)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def give_back() -> None:
    """Gives this process's free memory back to the system, for workers stay beside the next tasks' JVM and workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def released(run):
    """The batch function `run`, after whose last batch the worker gives its free memory back to the system.

    What `run` holds beyond its own generator is not free then.
    """

    def through(batches):
        yield from run(batches)
        give_back()

    return through


def chunks(batches: Iterable, text: str = "text", most: int = 1 << 20) -> Iterator:
    """Splits pandas batches so that each part has about `most` characters, or one row that alone has more."""
    for batch in batches:
        if not len(batch):
            continue
        sizes = np.cumsum([len(t) if t else 0 for t in batch[text]])
        start = 0
        while start < len(batch):
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(sizes.searchsorted(base + most, side="right")))
            yield batch.iloc[start:stop]
            start = stop
