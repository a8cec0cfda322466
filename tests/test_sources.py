import json

from foliant.sources import files
from foliant.streaming import runs


def test_questions_join_both_shapes(spark, tmp_path):
    rows = [
        {"id": "a", "type": "numeric", "question": "q", "expected_answer": 1.5, "expected_citation": {"doc": "d", "page": 3}},
        {"id": "b", "type": "prose", "question": "q", "expected_answer": "words", "expected_citation": [{"doc": "d", "page": 1}, {"doc": "e", "page": 2}], "answer_contains": ["x"]},
    ]
    path = tmp_path / "set.json"
    path.write_text(json.dumps({"note": 1, "questions": rows}))
    got = {r["id"]: r for r in files.read_questions(spark, str(path)).collect()}
    assert got["a"]["expected_num"] == 1.5 and [c["doc"] for c in got["a"]["citations"]] == ["d"]
    assert got["b"]["expected_num"] is None and [c["page"] for c in got["b"]["citations"]] == [1, 2]


def test_torn_lines_go_and_the_last_row_wins(spark, tmp_path):
    path = tmp_path / "run.jsonl"
    path.write_text('{"id": "a", "n": 1}\n{"id": "a", "n": 2}\n{"id": "b", "n": 1}\n{"id": "c", "n"')
    rows = files.read_jsonl(spark, str(path), "id string, n int", key="id", order="n").collect()
    assert {(r["id"], r["n"]) for r in rows} == {("a", 2), ("b", 1)}


def test_claims_and_pipe_tables(spark, tmp_path):
    path = tmp_path / "claims.md"
    path.write_text("# Title\n1. First claim.\n  12. Second claim  \nnot one\n| d1 | 3 | t1 | INCOMPLETE: rows |\n| d2 | 3 | t2 | fine |\n")
    assert {tuple(r) for r in files.read_claims(spark, str(path)).collect()} == {(1, "First claim."), (12, "Second claim")}
    assert [tuple(r) for r in files.read_incomplete(spark, str(path)).collect()] == [("d1", "t1")]


def test_binary_files_have_slugs(spark, tmp_path):
    (tmp_path / "GDP 2024-Q1.pdf").write_bytes(b"%PDF")
    (tmp_path / "other.txt").write_bytes(b"no")
    assert [r["doc_id"] for r in files.read_binary(spark, str(tmp_path)).collect()] == ["gdp_2024_q1"]


def test_stream_takes_each_run_once(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for name in ("one", "two"):
        events.write.mode("append").parquet(str(tmp_path / "in"))
    stream = runs.once(runs.read_runs(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " ")), "event_id", "ts", "90 days")
    query = stream.writeStream.format("memory").queryName("runs_once").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("runs_once").count() == events.count()
