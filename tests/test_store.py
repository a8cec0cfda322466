"""The store on files, reports, sealed keys, and answers end to end on small tables."""

import re

from pyspark.sql import functions as F

from foliant.functions import text as ft
from foliant.operators import cells as oc
from foliant.operators import order, qa, traindata
from foliant.sources import store


def test_store_rebuilds_appends_and_upserts(spark, tmp_path):
    root = str(tmp_path)
    assert store.open_table(spark, root, "documents").count() == 0
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id string, filename string, title string, source_url string, num_pages int")
    store.upsert(docs(("a", "a.pdf", "A", None, 1), ("b", "b.pdf", "B", None, 2)), root, "documents")
    store.upsert(docs(("b", "b.pdf", "B2", None, 3), ("c", "c.pdf", None, None, 1)), root, "documents")
    assert {(r["doc_id"], r["title"]) for r in store.open_table(spark, root, "documents").collect()} == {("a", "A"), ("b", "B2"), ("c", None)}
    cell = spark.createDataFrame([("a", 1, "t", 2, 0, "x", None, None), ("a", 1, "t", 1, 0, "1", "%", "h")], store.SCHEMAS["cells"])
    store.append(cell, root, "cells")
    store.append(cell, root, "cells")
    cells = store.open_table(spark, root, "cells")
    assert [r["row"] for r in store.table_of(cells, "a", "t").collect()] == [1, 1, 2, 2]
    store.rebuild(cell.limit(1), root, "cells")
    assert store.open_table(spark, root, "cells").count() == 1
    found = spark.createDataFrame([("a", 1, "t", 1, 0, "split-number")], "doc_id string, page int, table_id string, row int, col int, reason string")
    store.flag_suspects(found, root)
    store.flag_suspects(found, root)
    assert store.open_table(spark, root, "suspect_cells").count() == 1


def test_index_keeps_vectors_with_items(spark, tmp_path):
    items = spark.createDataFrame([("c1", "d", 1, "text", [0.5, 0.25])], "id string, doc_id string, page int, text string, embedding array<double>")
    store.save_index(items, str(tmp_path / "i"))
    assert store.load_index(spark, str(tmp_path / "i")).first()["embedding"] == [0.5, 0.25]


def test_reports_and_sealed_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string")
    text = store.write_report({"Rows": rows}, str(tmp_path / "r"), "Report", most=1)
    assert "| n | t |" in text and "Only the first 1 rows" in text and spark.read.text(str(tmp_path / "r")).count() > 3
    assert [r["line"] for r in store.pipe_table(rows).collect()] == [r"| 1 | a\|b |", "| 2 |  |"]
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    shut = spark.range(1).select(store.sealed(F.lit("secret"), key).alias("s"))
    got = shut.select(store.opened(F.col("s"), key).alias("a"), store.opened(F.col("s"), other).alias("b")).first()
    assert got["a"] == "secret" and got["b"] is None


def test_positions_and_running_sums(spark):
    rows = spark.createDataFrame([(i * 7 % 100, "a" if i % 3 else None, i) for i in range(100)], "k int, g string, v int")
    got = order.positions(rows, ["k"], "place").collect()
    assert all(r["place"] == r["k"] for r in got)
    sums = {}
    for r in sorted(order.running(rows, ["g"], ["k"], {"v": "s"}).collect(), key=lambda r: r["k"]):
        sums[r["g"]] = sums.get(r["g"], 0) + r["v"]
        assert r["s"] == sums[r["g"]]


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(ft.amount(F.lit("$1,250.5%"))) == 1250.5 and one(ft.amount(F.lit("n/a"))) is None
    assert one(ft.excerpt_body(F.lit("[d p3]  Some text."))) == "Some text."
    assert one(F.size(ft.excerpts(F.lit("[a p1] x\n\ny\n\n[b p2] z")))) == 2
    assert one(ft.cell_terms(F.lit("The 2024 GDP of UK"))) == ["the", "2024", "gdp"]
    assert [one(ft.rendered(F.lit(v), F.lit(u))) for v, u in ((12419.3, ""), (5.0, "%"), (0.0, "USD"), (1234.0, "USD"), (0.00012, ""), (99999.0, ""))] == ["1.242e+04", "5%", "0 USD", "1,234 USD", "0.00012", "1e+05"]


def test_answers_refuse_by_name(spark):
    cells = spark.createDataFrame([("d", 1, "t", 1, 1, "12.5", "USD", "price", "corn exports", ""), ("d", 1, "t", 2, 1, "7", None, "price", "wheat exports", "")], "doc_id string, page int, table_id string, row int, col int, value string, unit string, header string, row_label string, section string")
    questions = spark.createDataFrame([("a", "What was the price of corn exports?"), ("b", "Who chairs the board of directors?"), ("c", "no table at all"), ("d", "What was the price of corn exports?")], "question_id string, question string")
    found = spark.createDataFrame([(q, "d", "t", 1, 0.8) for q in "abd"], "question_id string, doc_id string, table_id string, rank int, score double")
    got = {r["question_id"]: r for r in qa.numeric_answers(questions, found, cells, cells).collect()}
    assert got["a"]["value"] == 12.5 and got["a"]["answer"] == "12.5 USD" and got["a"]["confidence"] == 0.8 and got["a"]["citations"] == "d p1 t r1c1 [USD]"
    assert got["b"]["error"] == "cells are not about the question" and got["b"]["confidence"] == 0.0 and got["c"]["error"] == "no table"
    replies = spark.createDataFrame([("a", '{"table": 1, "operation": "diff", "cells": [1, 2]}'), ("d", '{"table": 2, "operation": "sum", "cells": [1]}')], "question_id string, text string")
    got = {r["question_id"]: r for r in qa.numeric_answers(questions, found, cells, cells, replies).collect()}
    assert got["a"]["value"] == 5.5 and got["d"]["error"] == "unknown table"


def test_passages_that_do_not_answer_leave_no_confidence(spark):
    chunks = spark.createDataFrame([("c1", "d", 1, "Corn rose."), ("c2", "d", 2, "Prices of wheat fell.")], "chunk_id string, doc_id string, page int, text string")
    questions = spark.createDataFrame([("a", "wheat prices"), ("b", "zebra"), ("c", "nothing found")], "question_id string, question string")
    hits = spark.createDataFrame([("a", "c1", 1, 0.6), ("a", "c2", 2, 0.5), ("b", "c1", 1, 0.9)], "question_id string, id string, rank int, fused_score double")
    got = {r["question_id"]: r for r in qa.prose_answers(questions, hits, chunks).collect()}
    assert got["a"]["answer"] == "Prices of wheat fell." and got["a"]["confidence"] == 0.51 and got["a"]["cited"] == "c1,c2"
    assert got["b"]["note"] == "not in the passages" and got["b"]["confidence"] == 0.0 and got["c"]["note"] == "no passage"
    evidence = qa.evidence(hits.withColumn("score", F.col("fused_score")), chunks, spark.createDataFrame([], "question_id string, doc_id string, table_id string, rank int, score double"), questions, spark.createDataFrame([], "doc_id string, page int, table_id string, row int, col int, value string, unit string, header string, row_label string, section string"))
    assert evidence.count() == 3


def test_answers_across_documents(spark):
    sources = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2), ("r", "d1", 1), ("s", "d1", 1)], "question_id string, doc_id string, place int")
    prose = spark.createDataFrame([("q", "d1", None, 0.0), ("q", "d2", "words", 0.7), ("r", "d1", "only", 0.5)], "question_id string, doc_id string, answer string, confidence double")
    numeric = spark.createDataFrame([("q", "d1", 4.0, "4", 0.6)], "question_id string, doc_id string, value double, answer string, confidence double")
    got = {r["question_id"]: r for r in qa.multi_answers(sources, prose, numeric).collect()}
    assert (got["q"]["n_docs"], got["q"]["path"], got["q"]["confidence"]) == (2, "multi-doc(numeric+prose)", 0.6)
    assert got["r"]["confidence"] == 0.3 and "single-source" in got["r"]["path"] and got["s"]["path"] == "multi-doc(none)"


def test_generated_pairs_pass_their_checks(spark):
    rows = []
    for d in range(5):
        for c in range(9):
            rows.append((f"doc{'abcde'[d]}", c, f"{d}-{c}", f"The quarterly report on household mortgage balances of region {'abcdefghi'[c]} shows clearly that outstanding consumer credit volumes reached {1000 + d * 100 + c}.5 units in the closing period, as the tables of the annex show in detail for all."))
    facts = traindata.facts(spark.createDataFrame(rows, "doc_id string, page int, chunk_id string, text string"))
    assert facts.count() == 45
    made = traindata.pair_examples(facts)
    got = made.collect()
    assert len(got) > 35 and {r["kind"] for r in got} == {"first", "second", "negative"} and len({r["template_id"] for r in got}) > 4
    assert all(r["doc_id"] != r["other_doc"] and (r["kind"] != "negative" or r["context_doc"] not in (r["doc_id"], r["other_doc"])) for r in got)
    assert all((r["support_position"] is None) == (r["kind"] == "negative") for r in got)
    checked = traindata.check_pairs(made.withColumn("id", F.col("chunk_id")).withColumn("eval_figures", F.array().cast("array<string>")))
    bad = [r for r in checked.collect() if r["codes"] not in ("", "target_truncated_to_zero", "target_partly_truncated")]
    assert not bad
    known = {(r["doc_id"], r["figure"]) for r in facts.collect()}
    by_id, forms = {r["chunk_id"]: r for r in got}, set()
    for r in traindata.chat_examples(made).collect():
        m, of = r["meta"], by_id[r["chunk_id"]]
        assert [x["role"] for x in r["messages"]] == ["system", "user", "assistant"]
        assert r["messages"][1]["content"] == f"Excerpts:\n\n{of['context']}\n\nQuestion: {of['question']}" and r["messages"][2]["content"] == of["answer"]
        assert m["pair"] == [of["doc_id"], of["other_doc"]] and set(zip(m["pair"], m["asked_figures"], strict=True)) <= known
        assert m["figure"] == (None if m["kind"] == "negative" else of["figure"])
        if m["kind"] != "negative":
            other = of["other_doc"] if m["kind"] == "first" else of["doc_id"]
            assert f" in {other}" in of["answer"] and m["figure"] in of["answer"]
            forms.add(re.split(r"\W", of["answer"])[0])
    assert len({r["template_id"] for r in got}) >= 9 and len(forms) >= 4
    assert traindata.chat_examples(made.limit(0)).count() == 0


def test_cells_repaired_only_where_better(spark):
    kinds = "doc_id string, page int, table_id string, row int, col int, value string, unit string, header string"
    table = lambda t, labels: [("d", 1, t, r, c, v, None, None) for r in range(2, 5) for c, v in enumerate([labels, "1", "2", "3"])]
    old = spark.createDataFrame(table("x", "") + table("y", "label") + table("z", ""), kinds)
    new = spark.createDataFrame(table("x", "label") + table("y", "other") + table("z", ""), kinds)
    got = {(r["table_id"], r["value"]) for r in oc.repaired(old, new).where("col = 0").collect()}
    assert got == {("x", "label"), ("y", "label"), ("z", "")}
    assert {(r["table_id"], r["reason"].split(":")[0]) for r in oc.repair_log(old, new).collect()} == {("x", "REPAIRED"), ("z", "INCOMPLETE")}
