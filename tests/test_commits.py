"""Commits of the store and checkpointed runs: stopped at any step, they lose and double nothing."""

import pytest
from pyspark.sql import functions as F

from foliant.queries import pages
from foliant.sources import ingest, store
from foliant.streaming import runs

SF = "/root/testdata/sf0.001"
DOCS = "doc_id string, filename string, title string, source_url string, num_pages int"


def contents(spark, root):
    return {name: sorted(map(str, store.open_table(spark, root, name).collect())) for name in store.SCHEMAS if name != "index"}


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """Words, rules, tables and texts of a few documents, written once."""
    out = []
    for i, rows in enumerate(pages._inputs(spark, SF)):
        path = str(tmp_path_factory.mktemp("pages") / str(i))
        rows.where("substring(doc_id, 2, 9) < 12 and page < 3").write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def documents(spark, *ids):
    return spark.createDataFrame([(d, f"{d}.pdf", f"Report {d}", None, 2) for d in ids], DOCS)


def run(spark, root, inputs, *ids):
    words, rules, lines, fallback, texts = inputs
    return ingest.ingest(root, documents(spark, *ids), texts, lines, fallback, words, rules)


def test_ingest_again_changes_nothing_and_replaces_by_document(spark, inputs, tmp_path):
    root = str(tmp_path)
    summary = run(spark, root, inputs, "d1", "d2").collect()
    once = contents(spark, root)
    assert all(once[name] for name in ("documents", "cells", "chunks", "breakages", "previews")) and summary[-1]
    run(spark, root, inputs, "d1", "d2")
    assert contents(spark, root) == once
    run(spark, root, inputs, "d3")
    more = contents(spark, root)
    assert set(once["cells"]) < set(more["cells"]) and len(more["documents"]) == 3
    assert store.vacuum(spark, root) == 2 * len(store.SCHEMAS) and contents(spark, root) == more
    vectors = store.open_table(spark, root, "index")
    assert vectors.count() == store.open_table(spark, root, "chunks").count() and vectors.first()["embedding"]


@pytest.mark.parametrize("step", range(4))
def test_a_commit_that_fails_loses_nothing(spark, tmp_path, monkeypatch, step):
    """Killed while writing the first or second table, before the manifest is written, and before it is put in place."""
    root = str(tmp_path)
    docs, chunk = documents(spark, "d1", "d2"), spark.createDataFrame([("d1", "c1", 1, "text")], store.SCHEMAS["chunks"])
    store.commit(root, {"documents": docs, "chunks": chunk})
    before = contents(spark, root)
    calls = []
    shaped = store._shaped

    def failing(real, at):
        def call(*args):
            calls.append(at)
            if calls.count(at) > (1 if (at, step) == ("shaped", 1) else 0):
                raise RuntimeError("killed")
            return real(*args)

        return call

    with monkeypatch.context() as m:
        if step < 2:
            m.setattr(store, "_shaped", failing(shaped, "shaped"))
        elif step == 2:
            m.setattr(store, "_point", failing(store._point, "point"))
        else:
            m.setattr(store, "_swap", failing(store._swap, "swap"))
        with pytest.raises(RuntimeError):
            store.commit(root, {"documents": documents(spark, "d9"), "chunks": chunk.withColumn("text", F.lit("new"))})
    assert contents(spark, root) == before
    store.commit(root, {"documents": documents(spark, "d9"), "chunks": chunk.withColumn("text", F.lit("new"))})
    after = contents(spark, root)
    assert "d9" in after["documents"][0] and "new" in after["chunks"][0] and len(after["documents"]) == 1
    store.vacuum(spark, root)
    assert contents(spark, root) == after


def test_a_run_that_is_stopped_resumes(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "value")
    for part in range(3):  # each file is a batch; the last repeats rows of the others
        events.where(f"event_id % 3 = {part} or ({part} = 2 and event_id % 10 = 0)").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    seen = []

    def graded(batch):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("stopped")
        return batch.select("event_id", (F.col("value") > 50).alias("correct"))

    with pytest.raises(Exception, match="stopped"):
        runs.run_checkpointed(stream(), graded, out, mark, "event_id")
    assert 0 < spark.read.parquet(out).count() < events.count()
    runs.run_checkpointed(stream(), graded, out, mark, "event_id")
    got = spark.read.parquet(out)
    assert got.count() == got.select("event_id").distinct().count() == events.count()
    assert runs.resumed(events, out, "event_id").count() == 0 and runs.resumed(events, str(tmp_path / "none"), "event_id").count() == events.count()
    runs.append_lines(got.limit(2), str(tmp_path / "lines"))
    runs.append_lines(got.limit(3), str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 5


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    want = runs.sessions(events, "ts", "user_id", "2 hours")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    made = runs.sessions(stream, "ts", "user_id", "2 hours").writeStream.format("memory").queryName("sessions").outputMode("complete")
    made.option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (str(r["user_id"]), str(r["start"]), r["n"])
    assert sorted(map(key, spark.table("sessions").collect())) == sorted(map(key, want.collect()))
