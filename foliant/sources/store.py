"""The store on files: schemas, rebuilds and upserts of its tables, indexes with their vectors, reports, sealed keys."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.cells import latest

#: Tables of the store, each with its key; cells have none.
SCHEMAS = {
    "documents": "doc_id string, filename string, title string, source_url string, num_pages int",
    "cells": "doc_id string, page int, table_id string, row int, col int, value string, unit string, header string",
    "chunks": "doc_id string, chunk_id string, page int, text string",
    "suspect_cells": "doc_id string, page int, table_id string, row int, col int, reason string, detail string",
    "breakages": "doc_id string, page int, table_id string, reason string",
    "previews": "doc_id string, table_id string, page int, preview string",
    "index": "id string, doc_id string, page int, text string, embedding array<float>",
}
KEYS = {"documents": ["doc_id"], "chunks": ["chunk_id"]}
COLUMNS = {t: [c.split()[0] for c in s.split(", ")] for t, s in SCHEMAS.items()}
#: Names the folders that each table consists of; all that is not named in it does not count.
MANIFEST = "manifest.json"


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """The folders of each table of the store under `root`; none before the first commit."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}")
    if not _files(spark, root).exists(path):
        return {}
    return json.loads(spark.read.text(f"{root}/{MANIFEST}", wholetext=True).first()["value"])


def _point(spark: SparkSession, root: str, tables: dict[str, list[str]]) -> None:
    """Puts a new manifest in the old one's place, in one step: readers see either all of a commit or nothing of it."""
    fs, beside = spark._jvm.org.apache.hadoop.fs, f"{root}/.{MANIFEST}-{uuid.uuid4().hex}"
    out = _files(spark, root).create(fs.Path(beside))
    out.write(bytearray(json.dumps(tables, indent=1, sort_keys=True).encode()))
    out.close()
    _swap(spark, root, beside)


def _swap(spark: SparkSession, root: str, beside: str) -> None:
    fs = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").OVERWRITE
    context = fs.FileContext.getFileContext(fs.Path(root).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.Path(beside), fs.Path(f"{root}/{MANIFEST}"), how)


def commit(root: str, new: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> None:
    """Tables anew (`new`) and rows added to tables (`added`), all at once, by one writer at a time.

    Each goes into a folder of its own first; then one rename of the manifest makes them the store's. Whatever fails
    before leaves the store as it was, and folders that `vacuum` removes.
    """
    frames = {**new, **(added or {})}
    if not frames:
        return
    spark = next(iter(frames.values())).sparkSession
    folders = {}
    for name, rows in frames.items():
        folders[name] = f"{name}/{uuid.uuid4().hex}"
        _shaped(rows, name).write.parquet(f"{root}/{folders[name]}")
    held = manifest(spark, root)
    _point(spark, root, held | {n: [folders[n]] for n in new} | {n: [*held.get(n, []), folders[n]] for n in added or {}})


def vacuum(spark: SparkSession, root: str) -> int:
    """Removes folders that no table consists of; not while a reader or writer is at work. Returns how many."""
    files, path = _files(spark, root), spark._jvm.org.apache.hadoop.fs.Path
    held = {f for folders in manifest(spark, root).values() for f in folders}
    gone = 0
    for name in SCHEMAS:
        if not files.exists(path(f"{root}/{name}")):
            continue
        for status in files.listStatus(path(f"{root}/{name}")):
            if f"{name}/{status.getPath().getName()}" not in held:
                files.delete(status.getPath(), True)
                gone += 1
    return gone


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the store under `root`, as of its last commit; an empty one where nothing has been written yet."""
    folders = manifest(spark, root).get(name, [])
    if not folders:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(*[f"{root}/{f}" for f in folders])


def _shaped(rows: DataFrame, name: str) -> DataFrame:
    kinds = dict(c.split() for c in SCHEMAS[name].split(", "))
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS[name]])


def rebuild(rows: DataFrame, root: str, name: str) -> None:
    """The table anew, without what it held."""
    commit(root, {name: rows})


def append(rows: DataFrame, root: str, name: str) -> None:
    commit(root, {}, {name: rows})


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key: the new row where both have one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, key, "__new").drop("__new")


def upsert(rows: DataFrame, root: str, name: str) -> None:
    """Adds rows to a keyed table and replaces those of the same key."""
    commit(root, {name: upserted(open_table(rows.sparkSession, root, name), _shaped(rows, name), KEYS[name])})


def flag_suspects(found: DataFrame, root: str) -> None:
    """The suspects of this run in place of the last run's."""
    rebuild(found.withColumn("detail", F.lit(None).cast("string")) if "detail" not in found.columns else found, root, "suspect_cells")


def table_of(cells: DataFrame, doc_id: str, table_id: str) -> DataFrame:
    """The cells of one table by row and column."""
    return cells.where((F.col("doc_id") == doc_id) & (F.col("table_id") == table_id)).orderBy("row", "col")


def save_index(items: DataFrame, path: str) -> None:
    """Items (id, doc_id, page, text, embedding) as one table: a vector stays with what it stands for."""
    items.select("id", "doc_id", "page", "text", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, doc_id string, page int, text string, embedding array<float>").parquet(path)


def pipe_table(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows as lines of a Markdown table (line): each row's cells between bars, bars in text escaped, nulls empty."""
    columns = columns or rows.columns
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit(r"\|")), F.lit(""))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))


def write_report(sections: dict[str, DataFrame], path: str, title: str, most: int = 1000) -> str:
    """A Markdown report of small tables, such as metrics: a heading and at most `most` rows each, and says so where it cuts."""
    parts = [f"# {title}"]
    for name, rows in sections.items():
        head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}"
        lines = [r["line"] for r in pipe_table(rows).limit(most + 1).collect()]
        note = [f"\nOnly the first {most} rows are shown."] if len(lines) > most else []
        parts.append("\n".join([f"## {name}", "", head, *lines[:most], *note]))
    text = "\n\n".join(parts) + "\n"
    spark = next(iter(sections.values())).sparkSession if sections else SparkSession.getActiveSession()
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def sealed(text: Column, key: Column) -> Column:
    """Text under a key of 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(text, key))


def opened(sealed_text: Column, key: Column) -> Column:
    """Sealed text under its key; null under another, never an invented one."""
    return F.try_aes_decrypt(F.unbase64(sealed_text), key).cast("string")


def with_expected(claims: DataFrame, answer_key: DataFrame) -> DataFrame:
    """Claims (claim_id) beside the key's verdict and whether an error was planted; null where the key has no entry."""
    return claims.join(answer_key.select("claim_id", F.col("verdict").alias("expected"), F.col("planted_error")), "claim_id", "left")
