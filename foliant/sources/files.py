"""Readers and writers with fixed schemas; nothing is inferred, and torn lines never stop a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUESTION = """id string, type string, question string, expected_answer string, expected_unit string, operation string,
expected_citation string, answer_contains array<string>, verification_quote string, note string"""
CITATION = "array<struct<doc: string, page: int, table_id: string, section: string, row_label: string, column: string>>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation sets ({"questions": [...]}): the answer as number and text, citations always as an array."""
    whole = spark.read.schema(f"questions array<struct<{_struct(QUESTION)}>>").option("multiLine", True).json(path)
    rows = whole.select(F.explode("questions").alias("q")).select("q.*")
    one = F.concat(F.lit("["), F.col("expected_citation"), F.lit("]"))
    cited = F.when(F.col("expected_citation").startswith("["), F.col("expected_citation")).otherwise(one)
    number = F.col("expected_answer").try_cast("double")
    return rows.withColumn("expected_num", number).withColumn("citations", F.from_json(cited, CITATION)).drop("expected_citation")


def _struct(columns: str) -> str:
    return ", ".join(": ".join(c.split(None, 1)) for c in columns.replace("\n", " ").split(", "))


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None, order: str | None = None) -> DataFrame:
    """JSON lines without torn ones; with `key`, the last row of each key by `order`."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if key is None:
        return rows
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order or key))))
    return ranked.where("__rank = 1").drop("__rank")


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims of a numbered list in Markdown: claim_id, text."""
    line = F.trim("value")
    rows = spark.read.text(path).select(F.regexp_extract(line, r"^(\d+)\.\s+(.*\S)\s*$", 1).alias("n"), F.regexp_extract(line, r"^(\d+)\.\s+(.*\S)\s*$", 2).alias("text"))
    return rows.where("n <> ''").select(F.col("n").cast("int").alias("claim_id"), "text")


def read_incomplete(spark: SparkSession, path: str) -> DataFrame:
    """Tables that a report's pipe table marks INCOMPLETE: doc_id, table_id."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = spark.read.text(path).where(F.trim("value").startswith("|") & F.contains(F.col("value"), F.lit("INCOMPLETE:")))
    return rows.select(cells.alias("c")).where(F.size("c") >= 3).select(F.col("c")[0].alias("doc_id"), F.col("c")[2].alias("table_id")).distinct()


def read_choices(spark: SparkSession, path: str, per_file: int, seed: str = "choices") -> DataFrame:
    """Multiple-choice Parquet (id, question, choices{label, text}, answerKey): a drawn sample of each file."""
    rows = spark.read.parquet(path).withColumn("file", F.input_file_name())
    draw = F.row_number().over(Window.partitionBy("file").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "id")), "id"))
    return rows.withColumn("rank", draw).where(F.col("rank") <= per_file).withColumn("options", F.arrays_zip("choices.label", "choices.text")).drop("rank", "choices")


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files as bytes with the document id that their name gives; decoding is a provider's task."""
    from foliant.functions.text import document_slug

    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return rows.select(document_slug(stem).alias("doc_id"), "path", "length", "content")
