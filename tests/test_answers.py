"""One operator for answers, whose providers see their own rows alone; claims verified end to end; replies that are odd."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as ft
from foliant.operators import decide, qa, traindata, verify
from foliant.plans.providers import first_json

CELLS = "doc_id string, page int, table_id string, row int, col int, value string, unit string, header string, row_label string, section string"


@pytest.fixture(scope="module")
def store(spark):
    cells = [("d1", 1, "t1", 1, 1, "12.5", "USD", "price", "corn exports", "crops"), ("d1", 1, "t1", 2, 1, "7", None, "price", "wheat exports", "crops"), ("d2", 4, "t2", 1, 1, "10", "USD", "price", "corn exports", "crops")]
    chunks = [("c1", "d1", 1, "Corn exports had a price of 12.5 dollars."), ("c2", "d2", 4, "The board met in May and spoke of zebras."), ("c3", "d2", 5, "The price of corn exports was 10.")]
    return spark.createDataFrame(cells, CELLS), spark.createDataFrame(chunks, "chunk_id string, doc_id string, page int, text string")


def searches(spark, store):
    """Searches that find what the last word of a question names, in the wanted document only where there is one."""
    cells, chunks = store
    in_tables = spark.createDataFrame([("corn", "d1", "t1", 1, 0.8), ("corn", "d2", "t2", 2, 0.6), ("wheat", "d1", "t1", 1, 0.5)], "word string, doc_id string, table_id string, rank int, score double")
    in_chunks = spark.createDataFrame([("corn", "c1", "d1", 1, 0.9), ("corn", "c3", "d2", 2, 0.7), ("zebras", "c2", "d2", 1, 0.9), ("wheat", "c1", "d1", 1, 0.2)], "word string, id string, doc_id string, rank int, fused_score double")
    word = F.regexp_extract("question", r"(\w+)\W*$", 1).alias("word")

    def find(found):
        def run(rows):
            by = ["doc_id"] if "doc_id" in rows.columns else []
            return rows.select("question_id", *by, word).join(found, ["word", *by]).drop("word")

        return run

    tables, passages = find(in_tables), find(in_chunks)
    return tables, lambda rows: passages(rows).drop("doc_id")


QUESTIONS = {
    "number": "What is the total value of exports of corn?",  # two numeric cues, a number
    "none": "What is the total value of the zebras?",  # two numeric cues, no table: prose
    "unsure": "What was the maximum price of exports of wheat?",  # one cue: prose is asked too, and is less sure
    "prose": "Describe the corn",
    "many": "Compare the price of exports of corn",
    "nowhere": "Compare the unicorns",
    "open": "Tell me of zebras",
    "default": "Tell me of corn",
}


def test_answers_take_their_paths_and_providers_see_their_rows(spark, store):
    cells, chunks = store
    seen = {}

    def watched(name, provider, key):
        def run(rows):
            seen.setdefault(name, []).append(sorted(str(r[key]) for r in rows.select(key).distinct().collect()))
            return provider(rows)

        return run

    route = lambda rows: rows.where("question_id = 'open'").select("question_id", F.lit("prose").alias("path"), F.lit(0.6).alias("confidence"))
    part = lambda rows: rows.withColumn("text", F.when(F.col("doc_id") == "d1", '"The price of exports of corn"\nmore').otherwise("no"))
    asked = spark.createDataFrame(list(QUESTIONS.items()), "question_id string, question string")
    made = qa.answers(
        asked, *searches(spark, store), cells, cells, chunks, router=watched("router", route, "question_id"), planner=watched("planner", qa.stub_replies, "question_id"),
        reader=watched("reader", qa.first_passage, "question_id"), decomposer=watched("decomposer", part, "doc_id"),
    )
    got = {r["question_id"]: r for r in made.collect()}
    assert set(got) == set(QUESTIONS)
    assert (got["number"]["path"], got["number"]["value"], got["number"]["confidence"], got["number"]["method"]) == ("numeric", 12.5, 0.8, "rule")
    assert got["number"]["citations"] == "d1 p1 t1 r1c1 [USD]"
    assert (got["none"]["path"], got["none"]["answer"], got["none"]["value"]) == ("numeric->prose", "The board met in May and spoke of zebras.", None)
    assert (got["unsure"]["path"], got["unsure"]["value"]) == ("numeric", 7.0)
    assert got["prose"]["answer"].startswith("Corn exports") and got["prose"]["confidence"] == 0.765
    assert got["many"]["path"] == "multi-doc(prose)" and got["many"]["answer"] == "d1: Corn exports had a price of 12.5 dollars.  |  d2: The price of corn exports was 10."
    assert (got["nowhere"]["path"], got["nowhere"]["confidence"], got["nowhere"]["note"]) == ("multi-doc(none)", 0.0, "no document answers")
    assert (got["open"]["method"], got["open"]["confidence"]) == ("provider", 0.765)
    assert (got["default"]["method"], got["default"]["confidence"]) == ("default", round(0.765 * 0.9, 3))
    assert seen["router"] == [["default", "open"]]
    assert seen["planner"][0] == ["number", "unsure"] and all("many" in q for q in seen["planner"][1])
    assert seen["reader"][0] == ["default", "none", "open", "prose", "unsure"] and seen["decomposer"] == [["d1", "d2"]]


def test_sub_questions_that_are_no_use_leave_the_question(spark):
    rows = spark.createDataFrame([("q", d, "What are the prices in both?") for d in "abcd"], "question_id string, doc_id string, question string")
    said = spark.createDataFrame([("q", "a", '  "Prices in report a?"  \nand more'), ("q", "b", "short"), ("q", "c", "x" * 200)], "question_id string, doc_id string, text string")
    got = {r["doc_id"]: r["question"] for r in qa.narrowed(rows, lambda _: said).collect()}
    assert got == {"a": "Prices in report a?", **dict.fromkeys("bcd", "What are the prices in both?")}


def test_claims_are_verified_from_what_was_found(spark, store):
    cells, chunks = store
    claims = [("ok", "The price of corn exports among crops was 12.5 in 2020"), ("wrong", "The price of corn exports among crops was 99"), ("weak", "The price of corn exports among crops was 12.5"), ("lost", "Nothing at all"), ("read", "The board met in May with 3 zebras and spoke in May"), ("silent", "The board has 17 members of zebras")]
    hits = [("ok", "c1", 1, 0.8), ("ok", "c3", 2, 0.5), ("wrong", "c1", 1, 0.8), ("weak", "c1", 1, 0.3), ("read", "c2", 1, 0.5), ("silent", "c2", 1, 0.5)]
    tables = [(c, "d1", "t1", 1, 0.8) for c in ("ok", "wrong", "weak")]
    seen = []

    def reader(rows):
        seen.extend(sorted(r["claim_id"] for r in rows.select("claim_id").collect()))
        return rows.where("claim_id = 'read'").select("claim_id", F.lit("contradicted").alias("judged"), F.lit("a quote").alias("quote"))

    made = verify.verify_claims(
        spark.createDataFrame(claims, "claim_id string, text string"), spark.createDataFrame(hits, "claim_id string, id string, rank int, score double"), chunks,
        spark.createDataFrame(tables, "claim_id string, doc_id string, table_id string, rank int, score double"), cells, reader,
    )
    got = {r["claim_id"]: r for r in made.collect()}
    assert (got["ok"]["verdict"], got["ok"]["confidence"], got["ok"]["recomputed"], got["ok"]["claimed"]) == ("supported", 0.9, 12.5, 12.5)
    assert got["ok"]["citations"] == "d1 p1 t1 r1c1 [USD]; d1 p1; d2 p5"
    assert (got["wrong"]["verdict"], got["wrong"]["recomputed"], got["wrong"]["claimed"]) == ("contradicted", 12.5, 99.0)
    assert (got["weak"]["verdict"], got["weak"]["confidence"], got["weak"]["recomputed"]) == ("unverifiable", 0.3, None)
    assert (got["lost"]["verdict"], got["lost"]["confidence"], got["lost"]["citations"], got["lost"]["reason"]) == ("unverifiable", 0.0, "", "no evidence")
    assert (got["read"]["verdict"], got["read"]["confidence"], got["read"]["quote"]) == ("contradicted", 0.7, "a quote")
    assert (got["silent"]["verdict"], got["silent"]["confidence"]) == ("unverifiable", 0.5)
    assert seen == ["read", "silent"]


def test_replies_that_nest_too_deep_are_no_plan(spark):
    deep = ["[" * 100_000, '{"a":' * 100_000, "{" * 50_000 + '"x": 1}', 'text {"operation": "sum"}']
    assert [first_json(t) for t in deep[:2]] == [None, None] and first_json(deep[3]) == '{"operation": "sum"}'
    shown = spark.createDataFrame([(1, 1), (1, 2)], "table_no int, cell_id int")
    plans = ['{"table": 1.0, "operation": "sum", "cells": [1.0, {"id": "2"}]}', '{"table": 1, "operation": "sum", "cells": [1e0]}', '{"table": "x", "operation": "sum", "cells": [1]}', deep[0], deep[2]]
    got = {r["reply_id"]: r for r in decide.validate_plans(spark.createDataFrame(list(enumerate(plans)), "reply_id int, text string"), shown, ["sum"]).collect()}
    assert got[0]["cells"] == "1,2" and got[1]["cells"] == "1" and got[2]["error"] == "no table number" and got[3]["error"] == "not JSON"


def test_figures_keep_their_places(spark):
    text = "In 1,234 of 234 cases 12.5 and 2020, or 1234; 555."
    got = spark.createDataFrame([(text,), ("",), ("777",)], "t string").select(traindata.placed_figures(F.col("t")).alias("f"), traindata.figures(F.col("t")).alias("g")).collect()
    assert [(f["figure"], f["at"]) for f in got[0]["f"]] == [("1,234", 3), ("234", 12), ("12.5", 22), ("1234", 40)]
    assert all([f["figure"] for f in r["f"]] == r["g"] for r in got) and got[2]["f"][0]["at"] == 0
    assert all(text[f["at"] :].startswith(f["figure"]) for f in got[0]["f"])
    assert ft.FURNITURE


def test_cells_are_made_for_wanted_tables_alone(spark):
    """The cells that claims and questions are checked with are those of the tables found, made from one row an order."""
    from foliant.queries import answers
    from foliant.queries.fixtures import line_cells

    sf_dir = "/root/testdata/sf0.001"
    cells = answers._searched(spark, sf_dir)[0]
    wanted = spark.createDataFrame([("t1",), ("t7",), ("t7",), ("none",)], "table_id string")
    every = line_cells(spark, sf_dir, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).where("table_id in ('t1', 't7')")
    got = cells(wanted)
    assert got.columns == every.columns and sorted(map(str, got.collect())) == sorted(map(str, every.collect()))
    assert got.count() > 0


def test_numbers_may_come_from_the_cells_of_candidates(spark, store):
    cells, _ = store
    asked = spark.createDataFrame([("q", "What is the price of exports of corn?")], "question_id string, question string")
    tables = spark.createDataFrame([("q", "d1", "t1", 1, 0.8)], "question_id string, doc_id string, table_id string, rank int, score double")
    seen = []

    def of(wanted):
        seen.append(wanted.columns)
        return cells.join(wanted.select("doc_id", "table_id").distinct(), ["doc_id", "table_id"], "left_semi").select(*cells.columns)

    made = qa.numeric_answers(asked, tables, of, None).collect()
    assert [tuple(r) for r in made] == [tuple(r) for r in qa.numeric_answers(asked, tables, cells, cells).collect()]
    assert len(seen) == 1 and made[0]["value"] is not None
