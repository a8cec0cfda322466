"""From decoded pages to a store that can be searched: one commit, which may be run again after any failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import cells as oc
from foliant.operators import chunking, layout
from foliant.plans.providers import Embedder, HashEmbedder, embedded
from foliant.sources import store
from foliant.session import stored


def ingest(root: str, documents: DataFrame, pages: DataFrame, lines: DataFrame, fallback: DataFrame, words: DataFrame, rules: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Ingests documents into the store under `root`, in place of what it held of them; returns a summary by document.

    `documents` (doc_id, filename, title, source_url, num_pages) name them; all else is what decoders gave of their pages:
    texts (doc_id, page, text), tables along rules and by text, positioned words, rules. Chunks, cells with repairs and
    fallbacks, breakages, suspect cells, previews of tables that can be searched, and the index of chunks with their vectors are
    committed at once. A run that failed leaves the store as it was and can be repeated; one that is repeated changes
    nothing.
    """
    spark = documents.sparkSession
    ids = stored(documents.select("doc_id").distinct(), "ingested-ids")
    own = lambda rows: rows.join(ids, "doc_id", "left_semi")
    texts = own(pages)
    cells, breakages = layout.ingest(own(lines), own(fallback), own(words), own(rules), texts)
    cells = stored(cells, "ingested-cells")
    chunks = stored(chunking.chunks(texts), "ingested-chunks")
    found = stored(oc.suspects(cells, texts), "ingested-suspects").withColumn("detail", F.lit(None).cast("string"))
    log = stored(breakages.unionByName(chunking.unread_pages(texts)), "ingested-breakages")
    trusted = oc.without_suspects(cells, found)
    shown = oc.preview_texts(trusted.join(oc.retrievable(trusted), oc.TABLE, "left_semi"), documents)
    vectors = chunks.select(F.col("chunk_id").alias("id"), "doc_id", "page", "text").withColumn("embedding", embedded("text", embedder or HashEmbedder()))
    fresh = {"documents": documents, "cells": cells, "chunks": chunks, "suspect_cells": found, "breakages": log, "previews": shown, "index": vectors}
    kept = {name: store.open_table(spark, root, name).join(ids, "doc_id", "left_anti") for name in fresh}
    store.commit(root, {name: kept[name].select(store.COLUMNS[name]).unionByName(rows.select(store.COLUMNS[name])) for name, rows in fresh.items()})
    return oc.ingest_summary(texts, cells, chunks, log)
