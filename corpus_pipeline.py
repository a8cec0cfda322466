"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

Each stage takes documents (doc_id, text, lang, source, n_chars, and whatever other columns there are) and, but for the
last, returns rows with the same columns, whose names may be anything. Null texts and texts of any length are taken
whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import exact_dedup, langid, mixing, ngram_join, packing
from foliant.llm.common import fresh, quoted, table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language is found: null texts and texts without a letter, and nothing else.

    A document with a letter has the most likely learned language, so that clean documents stay. Repeated rows stay as
    often as they come. Without any learned language all go.
    """
    name = fresh(docs, "language")[0]
    found = langid.language_column(docs, langid.learn(docs))
    return docs.withColumn(name, found).where(F.col(name) != langid.UNKNOWN).select(*quoted(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the one with the largest doc_id stays; of repeated rows one."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of similarity 0.8 join, the one with the smallest doc_id stays; texts without words all stay."""
    return ngram_join.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, a null source being one of its own."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece. Repeated rows are packed as often as they come."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", known_language),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("mix", source_mix),
    ("sequences", sequences),
]
#: The language model, the similarity join and the packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
