"""Page-anchored chunks and page text from HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import collapse, strip

SIZE, OVERLAP = 800, 100
# Entities that pages use, and what they stand for.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Slices of `size` characters that overlap; the last may be shorter; one slice for a short text."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(step))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def packed(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Paragraphs (between two line feeds in succession) packed greedily into chunks of `size`; a longer one becomes windows of its own."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))

    def step(acc: Column, p: Column) -> Column:
        long = F.length(p) > size
        fits = F.length(acc["now"]) + F.length(p) + 2 <= size
        done = F.when(long, F.concat(flushed(acc), windows(p, size, overlap))).when((acc["now"] == "") | fits, acc["done"]).otherwise(flushed(acc))
        now = F.when(long, F.lit("")).when(acc["now"] == "", p).when(fits, F.concat(acc["now"], F.lit("\n\n"), p)).otherwise(p)
        return F.struct(done.alias("done"), now.alias("now"))

    return F.aggregate(parts, empty, step, flushed)


def chunks(pages: DataFrame, paragraphs: bool = True) -> DataFrame:
    """Chunks of pages (doc_id, page, text), packed or as plain windows: none spans a page, so a chunk's page is exact."""
    made = packed(F.col("text")) if paragraphs else windows(F.col("text"))
    rows = pages.where(strip(F.col("text")) != "").select("doc_id", "page", F.posexplode(made).alias("place", "text"))
    return rows.select("doc_id", "page", F.concat("doc_id", F.lit("_p"), "page", F.lit("_c"), "place").alias("chunk_id"), "text")


def html_text(html: Column) -> Column:
    """Readable text of a page: without scripts, styles, comments and tags, entities decoded, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, sign in ENTITIES:
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return collapse(bare)


def unread_pages(pages: DataFrame) -> DataFrame:
    """Breakages of pages without text: doc_id, page, table_id, reason."""
    empty = pages.where(F.col("text").isNull() | (strip(F.col("text")) == ""))
    return empty.select("doc_id", "page", F.lit(None).cast("string").alias("table_id"), F.lit("no text: likely a scanned page").alias("reason"))

