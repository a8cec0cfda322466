import random

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import ngram_join
from foliant.llm.common import ROW, id_in, numbered, written


def _documents(n: int, seed: int, passage: list[str]) -> list[tuple]:
    """Unrelated documents of 15 to 127 shingles, every other with a passage in it, and every hundredth with a near copy."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.getrandbits(60)}" for _ in range(rng.randint(19, 131))]
        if i % 2 and len(words) > 60:
            words[10 : 10 + len(passage)] = passage
        rows.append((2 * i, " ".join(words)))
        if i % 100 == 0:
            rows.append((2 * i + 1, " ".join([*words, "more"])))
    return rows


def _pairs(spark, rows, side: int) -> tuple[int, int, int]:
    """Pairs that blocks compare before and after large clusters are split, and nodes dealt to clusters."""
    docs = numbered(written(spark.createDataFrame(rows, "doc_id long, text string"), "docs")).select(*ROW, id_in(), "text")
    _, nodes, twins = ngram_join._nodes(docs, 64)
    before = ngram_join._clusters(docs, nodes, 64, twins)
    after = ngram_join._split(docs, nodes, before, side)
    count = [c.groupBy("cluster").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0] for c in (before, after)]
    return *count, after.count()


def test_unrelated_documents_meet_linearly(spark):
    passage = [f"p{i}" for i in range(30)]
    found = [_pairs(spark, _documents(n, 5, passage), 8) for n in (600, 1200, 2400)]
    for before, after, dealt in found:
        assert after < before
    for (_, pairs, dealt), (_, twice, dealt_twice) in zip(found[:-1], found[1:], strict=True):
        assert twice <= 2.5 * pairs + 50 and dealt_twice <= 2.5 * dealt + 50
    assert found[-1][1] < found[-1][0] / 20


def test_split_clusters_keep_every_link(spark):
    rows = _documents(300, 9, [f"p{i}" for i in range(30)])
    rng = random.Random(3)
    for i in range(60):  # a group of near copies larger than a block
        words = rows[1][1].split()
        words[rng.randrange(len(words))] = f"edit{i % 9}"
        rows.append((10_000 + i, " ".join(words)))
    sets = {}
    for k, text in rows:
        w = text.split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    links = {k: sum(j != k and 100 * len(a & b) >= 80 * len(a | b) for j, b in sets.items()) for k, a in sets.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["links"] for r in ngram_join.similarity_components(docs, side=5).collect()}
    assert got == links


def test_linked_sets_share_one_of_their_rarest():
    rng = np.random.default_rng(7)
    for _ in range(2000):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = int(rng.integers(0, len(a) // 5 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, 9))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        counts = rng.integers(0, 4, ngram_join.COUNTERS)
        assert len(np.intersect1d(ngram_join.rarest(a, counts), ngram_join.rarest(b, counts)))


def test_sets_of_plain_bands_have_enough_segments():
    rng = np.random.default_rng(8)
    for n in (128, 140, 200, 255, 256, 300, 511, 512, 1000):
        for _ in range(200):
            values = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            assert ngram_join._own_segments(values) >= ngram_join.needed(n)


def test_rows_of_a_file_listed_twice_keep_their_names(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(20).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(path)
    twice = numbered(spark.read.parquet(path, path))
    assert twice.count() == 40 and twice.select(*ROW).distinct().count() == 40
    once = spark.read.parquet(path)
    assert "numbered" not in numbered(once).inputFiles()[0] and "numbered" in numbered(once.where(F.rand(3) < 2)).inputFiles()[0]


def test_texts_that_no_cluster_wants_stay_behind(spark, monkeypatch):
    docs = numbered(written(spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id) AS text"), "docs"))
    wanted = written(docs.where("doc_id % 100 = 0").select(*ROW, F.col("doc_id").alias("node")), "wanted")
    want = [(k, f"text {k}") for k in range(0, 5000, 100)]
    assert ngram_join._likely(docs, wanted).count() <= 55
    assert sorted(map(tuple, ngram_join._texts(docs, wanted).select("node", "text").collect())) == want
    monkeypatch.setattr(ngram_join, "BITS", 128)  # rows that share a bit with a wanted one come along and go in the join
    assert 55 < ngram_join._likely(docs, wanted).count() < 5000
    assert sorted(map(tuple, ngram_join._texts(docs, wanted).select("node", "text").collect())) == want
    assert ngram_join._texts(docs, written(wanted.where("false"), "none")).count() == 0
