"""Claims against labelled cells and evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import CLAIM_STOP, citation, claim_numbers, excerpt_body, matches_needle, number, numbers_agree, overlap, terms, without_years
from foliant.operators import qa
from foliant.session import stored

LEAST_TERMS, MARGIN, FLOOR = 3, 1, 0.35
#: Excerpts a reader sees of a claim, and passages that are cited beside a cell, or without one.
READ, BESIDE, CITED = 5, 2, 3


def match_cells(claims: DataFrame, cells: DataFrame, by: list[str] = [], more: list[str] = []) -> DataFrame:  # noqa: B006
    """The cell that each claim (claim_id, text) is about, by labels alone: claim_id, score and the cell, with its columns `more`.

    Cells may be each claim's own evidence, `by` claim_id, and are all compared with it then. Else claims meet cells over
    the four-letter starts of their terms, which any two terms that agree share, so only cells that agree in one are
    compared. The best cell needs three agreeing terms and a lead of one over cells of other rows; ties go by (doc, table, row, col).
    """
    start = lambda c: F.explode(F.array_distinct(F.transform(c, lambda t: F.substring(t, 1, 4))))
    asked = claims.select("claim_id", terms(F.col("text"), CLAIM_STOP).alias("wanted"))
    there = cells.withColumn("there", terms(F.concat_ws(" ", "row_label", "header", "section"), CLAIM_STOP))
    key = ["doc_id", "table_id", "row", "col"]
    if by:
        pairs = asked.join(there, by)
    else:
        pairs = asked.withColumn("start", start(F.col("wanted"))).join(there.withColumn("start", start(F.col("there"))), "start").dropDuplicates(["claim_id", *key])
    scored = pairs.withColumn("score", overlap(F.col("wanted"), F.col("there"))).where("score > 0")
    order = F.struct((-F.col("score")).alias("s"), *key)
    kept = ["score", *key, "value", "unit", "row_label", "section", *more]
    # the best of each row and section; a claim's rival is the best of another one
    rows = scored.groupBy("claim_id", "row_label", "section").agg(F.min_by(F.struct(*kept), order).alias("first"), F.min(order).alias("order"))
    rows = stored(rows, "matched-rows")
    best = rows.groupBy("claim_id").agg(F.min_by("first", "order").alias("best"))
    rival = (
        rows.join(best, "claim_id")
        .where((F.col("row_label") != F.col("best.row_label")) | (F.col("section") != F.col("best.section")))
        .groupBy("claim_id")
        .agg(F.max("first.score").alias("rival"))
    )
    sure = (F.col("best.score") >= LEAST_TERMS) & (F.coalesce(F.col("best.score") - F.col("rival"), F.lit(MARGIN)) >= MARGIN)
    return best.join(rival, "claim_id", "left").where(sure).select("claim_id", "best.*")


def claimed(text: Column) -> Column:
    return without_years(claim_numbers(text))


def agrees(numbers: Column, cell: Column) -> Column:
    return F.exists(numbers, lambda n: numbers_agree(n, cell))


def verdicts(claims: DataFrame) -> DataFrame:
    """Verdicts of claims (claim_id, text, n_evidence, score, cell double, judged: supported, contradicted or null).

    Without evidence, or with the best score below the floor: unverifiable, as sure as that score is high. With a matched cell: by its number, at 0.9
    or 0.85. Else as a reader judged the evidence, at a confidence that its score bounds.
    """
    weak = (F.col("n_evidence") == 0) | (F.col("score") < FLOOR)
    ok = agrees(claimed(F.col("text")), F.col("cell"))
    recomputed = F.col("cell").isNotNull() & (F.size(claimed(F.col("text"))) > 0)
    verdict = F.when(weak, "unverifiable").when(recomputed, F.when(ok, "supported").otherwise("contradicted")).otherwise(F.coalesce("judged", F.lit("unverifiable")))
    sure = (
        F.when(weak, F.round(F.coalesce("score", F.lit(0.0)), 3))
        .when(recomputed, F.when(ok, 0.9).otherwise(0.85))
        .when(F.col("judged") == "supported", F.least(F.lit(0.85), F.col("score") + 0.25))
        .when(F.col("judged") == "contradicted", F.least(F.lit(0.8), F.col("score") + 0.2))
        .otherwise(F.col("score"))
    )
    return claims.select("claim_id", verdict.alias("verdict"), F.round(sure, 6).alias("confidence"), (~weak & recomputed).alias("recomputed"))


def recheck(claims: DataFrame, cells: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Verdicts of claims (claim_id, text, n_evidence, best_score) against their evidence's cells (claim_id and the cell).

    A claim that one cell is clearly about is recomputed; the rest go by what a reader judged (claim_id, judged), if any.
    Returns claim_id, verdict, confidence, recomputed and the place of the cell.
    """
    matched = match_cells(claims.select("claim_id", "text"), cells, ["claim_id"])
    found = matched.select("claim_id", number(F.col("value")).alias("cell"), "doc_id", "table_id", "row", "col")
    readers = claims.select("claim_id").withColumn("judged", F.lit(None).cast("string")) if judged is None else judged
    rows = claims.join(found, "claim_id", "left").join(readers, "claim_id", "left").withColumn("score", F.col("best_score"))
    places = rows.select("claim_id", "row", "col")
    return verdicts(rows).join(places, "claim_id")


def number_reader(prompts: DataFrame) -> DataFrame:
    """What stands in for a reader of claims (claim_id, text, excerpts): an excerpt that shares LEAST_TERMS of its terms and
    states one of its numbers supports it; else nothing is said."""
    asked, stated = terms(F.col("text"), CLAIM_STOP), F.regexp_extract_all(F.col("text"), F.lit(r"[0-9][0-9,]*\.?[0-9]*[0-9]|[0-9]"), 0)
    says = lambda e: (overlap(asked, terms(e, CLAIM_STOP)) >= LEAST_TERMS) & F.exists(stated, lambda n: matches_needle(e, n))
    first = F.try_element_at(F.filter(F.transform("excerpts", excerpt_body), says), F.lit(1))
    return prompts.select("claim_id", F.when(first.isNotNull(), "supported").alias("judged"), F.substring(first, 1, 300).alias("quote"))


def verify_claims(claims: DataFrame, hits: DataFrame, chunks: DataFrame, tables: DataFrame, labelled: DataFrame, reader: Callable[[DataFrame], DataFrame] = number_reader) -> DataFrame:
    """Claims (claim_id, text) against evidence that searches found: verdict, confidence, recomputed and claimed value,
    citations, quote, reason.

    `hits` (claim_id, id, rank, score) are passages among `chunks`, `tables` (claim_id, doc_id, table_id, rank, score) those
    whose cells (`labelled`) may hold the number. Without a passage, or with none that scores FLOOR, a claim cannot be
    verified. One that a single cell is clearly about by its labels is recomputed: any of its numbers may agree. All
    others go to the reader, which sees their excerpts and no other claims, and says supported, contradicted or nothing.
    """
    asked = claims.select(F.col("claim_id").alias("question_id"), F.col("text").alias("question"))
    named = lambda rows: rows.withColumnRenamed("claim_id", "question_id")
    gathered = hits.join(chunks.select(F.col("chunk_id").alias("id"), "doc_id", "page", F.col("text").alias("content")), "id").withColumnRenamed("id", "place")
    line = F.concat(F.lit("["), "doc_id", F.lit(" p"), F.col("page").cast("string"), F.lit("] "), "content")
    place = F.concat("doc_id", F.lit(" p"), F.col("page").cast("string"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("place").alias("id"), line.alias("line"), place.alias("place"))))
    passages = gathered.groupBy("claim_id").agg(F.slice(ranked, 1, READ).alias("read"), F.max("score").alias("best"))
    shown = qa.shown_cells(asked, named(tables), labelled).withColumnRenamed("question_id", "claim_id").drop("question", "score", "rank", "relevance")
    matched = match_cells(claims, shown, ["claim_id"], ["page"])
    cell = matched.select("claim_id", number(F.col("value")).alias("cell"), citation(F.col("doc_id"), F.col("page"), F.col("table_id"), F.col("row"), F.col("col"), F.col("unit")).alias("cite"))
    rows = claims.select("claim_id", "text").join(passages, "claim_id", "left").join(cell.where("cell is not null"), "claim_id", "left")
    rows = rows.withColumn("numbers", claimed(F.col("text"))).withColumn("weak", F.coalesce(F.col("best") < FLOOR, F.lit(True)))
    rows = stored(rows.withColumn("recompute", ~F.col("weak") & F.col("cell").isNotNull() & (F.size("numbers") > 0)), "claims")
    left = rows.where("not weak and not recompute").select("claim_id", "text", F.transform("read", lambda r: r["line"]).alias("excerpts"))
    said = reader(left).groupBy("claim_id").agg(F.min(F.struct("judged", "quote")).alias("said"))
    rows = rows.join(said, "claim_id", "left").withColumn("judged", F.when(F.col("said.judged").isin("supported", "contradicted"), F.col("said.judged")))
    agreeing = F.try_element_at(F.filter("numbers", lambda n: numbers_agree(n, F.col("cell"))), F.lit(1))
    ok = agreeing.isNotNull()
    recompute, judged, best = F.col("recompute"), F.col("judged"), F.coalesce("best", F.lit(0.0))
    verdict = F.when(F.col("weak"), "unverifiable").when(recompute, F.when(ok, "supported").otherwise("contradicted")).otherwise(F.coalesce(judged, F.lit("unverifiable")))
    sure = (
        F.when(F.col("weak"), best).when(recompute, F.when(ok, 0.9).otherwise(0.85)).when(judged == "supported", F.least(F.lit(0.85), best + 0.25))
        .when(judged == "contradicted", F.least(F.lit(0.8), best + 0.2)).otherwise(best)
    )
    reason = (
        F.when(F.col("read").isNull(), "no evidence").when(F.col("weak"), "the evidence is too weak").when(recompute, F.when(ok, "the cell agrees").otherwise("the cell does not agree"))
        .when(judged.isNotNull(), "as a reader judged the excerpts").otherwise("the excerpts do not address the claim")
    )
    places = F.coalesce(F.transform("read", lambda r: r["place"]), F.array().cast("array<string>"))
    cites = F.when(recompute, F.concat(F.array("cite"), F.slice(places, 1, BESIDE))).otherwise(F.slice(places, 1, CITED))
    return rows.select(
        "claim_id", verdict.alias("verdict"), F.round(sure, 3).alias("confidence"), F.when(recompute, F.col("cell")).alias("recomputed"),
        F.when(recompute, F.coalesce(agreeing, F.col("numbers")[0])).alias("claimed"), F.array_join(cites, "; ").alias("citations"), F.when(judged.isNotNull(), F.col("said.quote")).alias("quote"), reason.alias("reason"),
    )
