"""Near-duplicate embeddings against all pairs: groups of near copies, chains, exact copies, odd vectors, both kernels."""

import math

import numpy as np
import pytest

from foliant.llm import embedding_dedup, hnsw, queries

VECTORS = "vec_id long, embedding array<float>, label int, id int, links string, Class int, c int"


def by_pairs(rows, link=0.95):
    """(vec_id, n_links, component_id, kept) of each row, by comparing all with all."""
    usable = [r[1] is not None and len(r[1]) > 0 and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    vectors = [np.float32(r[1]).astype(float) if u else None for r, u in zip(rows, usable, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and usable[i] and usable[j] and len(vectors[i]) == len(vectors[j]) and vectors[i] @ vectors[j] / math.sqrt((vectors[i] @ vectors[i]) * (vectors[j] @ vectors[j])) >= link] for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen]
        least = None if None in ids else min(ids)
        out.append((r[0], len(near[i]), least, least is not None and least == r[0]))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in embedding_dedup.found_by_row(df).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(12)
    base = draw.normal(size=(250, 24))
    vectors = [*base, *(base[3] + draw.normal(size=(120, 24)) * 0.1), *(base[9] * 3.0 for _ in range(3))]
    step = base[20].copy()
    for _ in range(30):  # a chain, whose ends are far apart
        step = step + draw.normal(size=24) * 0.22
        vectors.append(step)
    out = [(7 * i + 1, [float(v) for v in x], 0, 1, "", 1, 2) for i, x in enumerate(vectors)]
    out += [(5000 + i, out[40][1], 1, 1, "", 1, 2) for i in range(60)] + [out[40], out[41], out[41]]
    odd = [None, [], [0.0] * 24, [math.nan] * 24, [math.inf] + [1.0] * 23, [None] + [1.0] * 23, [1e-30] * 24, [3e-30] * 24, [3e38] * 24, [1.0, 2.0], [2.0, 4.0], [2.0, -4.0]]
    return out + [(9000 + i, v, 0, 1, "", 1, 2) for i, v in enumerate(odd)] + [(None, out[60][1], 0, 1, "", 1, 2)]


def test_components_equal_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert found(df) == by_pairs(rows)
    whole = embedding_dedup.components(df, shard_bytes=24 * 8 * 30)  # many small shards
    assert whole.columns == [*df.columns, "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in whole.select("vec_id", "n_links", "component_id", "kept").collect()), key=str) == by_pairs(rows)


def test_components_of_few_rows(spark):
    assert found(spark.createDataFrame([], VECTORS)) == []
    for few in ([(1, None, 0, 1, "", 1, 2)], [(1, [1.0, 2.0], 0, 1, "", 1, 2)], [(2, [1.0, 2.0], 0, 1, "", 1, 2), (1, [2.0, 4.0], 0, 1, "", 1, 2)]):
        assert found(spark.createDataFrame(few, VECTORS)) == by_pairs(few)


def test_query_equals_all_pairs(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in queries.op12_embedding_dedup(spark, sf_dir).collect()), key=str)
    assert got == by_pairs([tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()])


def test_graph_reaches_all_nodes_and_finds_the_nearest():
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(3000, 32)).astype(np.float32)
    vectors[2000:] = vectors[7] + 0.01 * draw.normal(size=(1000, 32))  # a group that fills its members' lists
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = hnsw.build(vectors)
    assert [len(layer) for layer in graph.layers] == hnsw.levels(3000, 0) and graph.layers[0].max() < 3000
    for node, row in enumerate(graph.layers[0]):
        links = row[row >= 0]
        assert len(set(links)) == len(links) and node not in links
    queries_ = vectors[:400]
    ids, sims = hnsw.search(graph, queries_, 32)
    assert (np.diff(sims, axis=1) <= 0).all()
    nearest = np.sort(queries_ @ vectors.T, axis=1)[:, -1]
    assert (sims[:, 0] >= nearest - 1e-6).mean() > 0.97


def test_beam_widens_until_the_audit_passes():
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(1500, 16)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = hnsw.build(vectors)
    graph.layers[0][:, 3:] = -1  # a graph of few links needs a wider beam
    graph.loose = hnsw._unreached(graph)
    planted = embedding_dedup._planted(vectors, 0.95, 3)
    beam = embedding_dedup._audited(graph, planted, 0.95, 2)
    assert beam > 2
    rows, nodes = embedding_dedup._walked(graph, planted, 0.95, beam)
    true = {tuple(p) for p in np.argwhere(planted @ vectors.T >= 0.95)}
    assert set(zip(rows, nodes, strict=True)) <= true and len(rows) >= embedding_dedup.RECALL * len(true)
