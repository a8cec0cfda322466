"""Near-duplicate embeddings: a small-world graph for each shard, queried by every row, its finds verified and joined."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import hnsw
from foliant.llm.common import NULL_ID, fresh, id_in, id_out, quoted
from foliant.llm.components import connected_components
from foliant.session import stored

LINK = 0.95
#: A shard's vectors take about so many bytes; a table has so many shards at least.
SHARD_BYTES, LEAST_SHARDS = 32 << 20, 8
#: Part of the true links that a search has to find of an audit's queries before its beam is wide enough.
RECALL = 0.995
AUDITED = 256
#: Single-precision similarities within this of the threshold are verified in double precision.
SLACK = 1e-4
GRAPH = "length int, shard int, shards int, classes binary, ids binary, sizes binary, vectors binary, counts array<int>, layers array<binary>, loose binary, beam int"
FOUND = "class binary, id long, links long, root long"


def components(df: DataFrame, id_name: str = "vec_id", vector: str = "embedding", link: float = LINK, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All rows and columns of `df`, with n_links (rows whose vector has a cosine of `link` or more with the row's),
    component_id (the smallest id that links lead to) and kept (whether that is the row's own).

    Vectors that are null, empty, zero or hold null or non-finite entries link with nothing, nor do vectors of different
    lengths. Rows of equal vectors link, repeated rows and rows of one id too. A null id counts as the smallest: the
    component then has none. Empty tables give no rows. Columns may have any names.

    Rows of equal vectors are one class. Classes are dealt into shards by hash, a graph is built for each, and each pair
    of shards is one task, in which all rows of either walk the graph of the other. A task's beam is doubled until audits
    against all rows of the shard, of real rows and of copies made at a cosine just above `link`, find RECALL of the true
    links. A row whose whole beam has links is compared with the whole shard instead, as are nodes no walk can reach, so
    groups of near copies of any size keep all their links. A pair of rows may be found by either; links are verified in
    double precision, and none is added without. A task returns a row for each linked class, never pairs: its number
    of links in that pair of shards, and the smallest id of its component there; components are united in joins.
    """
    id_, vector_, class_, key, n, least = fresh(df, "id", "vector", "class", "key", "links_and_copies", "least")
    whole = F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, lambda c: _unusable(c)), F.lit(True)) & F.exists(vector, lambda c: c.cast("double") != 0)
    entries = F.when(whole, F.transform(vector, lambda c: c.cast("double") + F.lit(0.0)))
    rows = df.withColumn(vector_, entries).withColumn(id_, id_in(id_name))
    rows = rows.withColumn(class_, F.unhex(F.sha2(F.col(vector_).cast("string"), 256)))
    classes = stored(
        rows.where(F.col(class_).isNotNull()).groupBy(F.col(class_).alias("class")).agg(F.min(id_).alias("id"), F.count("*").alias("size"), F.any_value(vector_).alias("vector")),
        "classes",
    )
    found = stored(_found(classes, link, shard_bytes), "found")
    links = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("class").agg(F.sum("links").alias("linked"))
    known = classes.select("class", "id", "size").join(counts, "class", "left").join(links, F.col("id") == F.col("node"), "left")
    known = known.select(F.col("class").alias(key), (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias(n), F.coalesce("comp", "id").alias(least))
    out = rows.join(known.hint("shuffle_merge"), F.col(class_) == F.col(key), "left")
    own, comp = F.col(id_name).cast("long"), F.coalesce(least, id_)
    return out.select(*quoted(df), F.coalesce(n, F.lit(0)).alias("n_links"), F.nullif(comp, F.lit(NULL_ID)).alias("component_id"), F.coalesce(own == comp, F.lit(False)).alias("kept"))


def _unusable(c):
    return F.coalesce(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), F.lit(True))


def _found(classes: DataFrame, link: float, shard_bytes: int) -> DataFrame:
    shards = F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.count("*") * F.col("length") * 8 / shard_bytes)).cast("int")
    sized = classes.withColumn("length", F.size("vector"))
    lengths = sized.groupBy("length").agg(shards.alias("shards"))
    dealt = sized.join(lengths, "length").withColumn("shard", F.pmod(F.xxhash64("class"), "shards").cast("int"))
    tasks, pairs = map(int, lengths.agg(F.coalesce(F.sum("shards"), F.lit(0)), F.coalesce(F.sum(F.expr("shards * (shards + 1) div 2")), F.lit(0))).first())
    graphs = dealt.repartition(max(1, tasks), "length", "shard").groupBy("length", "shard").applyInPandas(lambda shard: _graph(shard, link), GRAPH)
    graphs = stored(graphs, "graphs")
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    met = graphs.withColumn("other", other).withColumn("low", F.least("shard", "other")).withColumn("high", F.greatest("shard", "other"))
    return met.repartition(max(1, pairs), "length", "low", "high").groupBy("length", "low", "high").applyInPandas(lambda both: _pair(both, link), FOUND)


def _graph(shard: pd.DataFrame, link: float) -> pd.DataFrame:
    """One shard's graph as a row, its nodes in an order of the classes' own, with a beam that passes the audit."""
    shard = shard.sort_values("class", ignore_index=True)
    vectors = np.array(shard["vector"].tolist(), np.float64)
    graph = hnsw.build(_unit(vectors), int(shard["shard"][0]))
    graph.beam = _audited(graph, _planted(graph.vectors, link, 1), link, hnsw.FIRST_BEAM)
    whole = {k: [int(shard[k][0])] for k in ("length", "shard", "shards")}
    packed = {"classes": b"".join(shard["class"]), "ids": shard["id"].to_numpy(np.int64).tobytes(), "sizes": shard["size"].to_numpy(np.int64).tobytes(), "vectors": vectors.tobytes()}
    layers = {"counts": [[len(layer) for layer in graph.layers]], "layers": [[layer.tobytes() for layer in graph.layers]], "loose": [graph.loose.tobytes()], "beam": [graph.beam]}
    return pd.DataFrame(whole | {k: [v] for k, v in packed.items()} | layers)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, after scaling by the largest entry, which keeps squares of any entries within range."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _planted(unit: np.ndarray, link: float, seed: int) -> np.ndarray:
    """Some nodes, each turned in a drawn direction until its cosine with what it was is just above `link`."""
    draw = np.random.default_rng(seed)
    at = draw.choice(len(unit), min(AUDITED, len(unit)), replace=False)
    aside = draw.normal(size=(len(at), unit.shape[1]))
    aside -= (aside * unit[at]).sum(1, keepdims=True) * unit[at]
    length = np.sqrt((aside * aside).sum(1, keepdims=True))
    aside = np.divide(aside, length, out=np.zeros_like(aside), where=length > 1e-9)
    cosine = min(1.0, link + 2 * SLACK)
    return (cosine * unit[at] + np.sqrt(1 - cosine**2) * aside).astype(np.float32)


def _audited(graph: hnsw.Graph, queries: np.ndarray, link: float, beam: int) -> int:
    """The first beam, doubling from `beam`, that finds RECALL of the links of `queries`; beyond half a shard, all of it."""
    true = (queries @ graph.vectors.T >= link).sum()
    while beam < len(graph.vectors):
        rows, _ = _walked(graph, queries, link, beam)
        if len(rows) >= RECALL * true:
            return beam
        beam *= 2
        if beam * 2 > len(graph.vectors):
            break
    return len(graph.vectors)


def _walked(graph: hnsw.Graph, queries: np.ndarray, link: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of similarity `link` or more that walks find; a full beam of them is no end, so its query is
    compared with the whole shard, as all are with a beam as wide as that."""
    pairs = []
    for start in range(0, len(queries), hnsw.BATCH):
        part = queries[start : start + hnsw.BATCH]
        everywhere = np.arange(len(part))
        if beam < len(graph.vectors):
            ids, sims = hnsw.search(graph, part, beam)
            close = (sims >= link) & (ids >= 0)
            full = close.all(1)
            rows, places = np.nonzero(close & ~full[:, None])
            pairs.append((rows + start, ids[rows, places]))
            everywhere = np.flatnonzero(full)
        if len(everywhere):
            rows, nodes = np.nonzero(part[everywhere] @ graph.vectors.T >= link)
            pairs.append((everywhere[rows] + start, nodes))
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2


def _pair(both: pd.DataFrame, link: float) -> pd.DataFrame:
    """Linked classes of two shards, or within one: links in these shards, weighed by copies, and the smallest id of the
    component among them. A shard whose partner is empty has nothing to return."""
    low, high = int(both["low"][0]), int(both["high"][0])
    shards = {int(r["shard"]): _opened(r) for r in both.to_dict("records")}
    if low not in shards or high not in shards:
        return pd.DataFrame({"class": [], "id": [], "links": [], "root": []})
    a, b = shards[low], shards[high]
    rows, nodes = _links(a, b, link)
    if low != high:
        nodes2, rows2 = _links(b, a, link)
        rows, nodes = np.concatenate([rows, rows2]), np.concatenate([nodes, nodes2])
        rows, nodes = np.divmod(np.unique(rows * len(b["ids"]) + nodes), len(b["ids"]))
    else:
        rows, nodes = np.minimum(rows, nodes), np.maximum(rows, nodes)
        rows, nodes = np.divmod(np.unique((rows * len(b["ids"]) + nodes)[rows != nodes]), len(b["ids"]))
    sure = _verified(a["vectors"], b["vectors"], rows, nodes, link)
    rows, nodes = rows[sure], nodes[sure]
    ids, sizes, classes = a["ids"], a["sizes"], a["classes"]
    if low != high:
        nodes = nodes + len(ids)
        ids, sizes, classes = (np.concatenate([a[k], b[k]]) for k in ("ids", "sizes", "classes"))
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, rows, sizes[nodes])
    np.add.at(links, nodes, sizes[rows])
    root = _smallest(ids, rows, nodes)
    linked = np.flatnonzero(links)
    return pd.DataFrame({"class": [classes[i].tobytes() for i in linked], "id": ids[linked], "links": links[linked], "root": root[linked]})


def _opened(row: dict) -> dict:
    ids = np.frombuffer(row["ids"], np.int64)
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
    unit = np.ascontiguousarray(_unit(vectors), np.float32)
    layers = [np.frombuffer(layer, np.int32).reshape(count, -1) for layer, count in zip(row["layers"], row["counts"], strict=True)]
    graph = hnsw.Graph(unit, layers, np.frombuffer(row["loose"], np.int64), int(row["beam"]))
    return {"ids": ids, "sizes": np.frombuffer(row["sizes"], np.int64), "classes": np.frombuffer(row["classes"], np.uint8).reshape(len(ids), -1), "vectors": vectors, "graph": graph}


def _links(a: dict, b: dict, link: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (row of a, node of b): rows of a walk b's graph, with a beam that an audit of theirs accepts."""
    queries = a["graph"].vectors
    sample = queries[np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int)]
    beam = _audited(b["graph"], np.concatenate([sample, _planted(b["graph"].vectors, link, 2)]), link - SLACK, b["graph"].beam)
    return _walked(b["graph"], queries, link - SLACK, beam)


def _verified(a: np.ndarray, b: np.ndarray, rows: np.ndarray, nodes: np.ndarray, link: float) -> np.ndarray:
    a, b = _unit(a), _unit(b)
    sure = [np.einsum("pd,pd->p", a[rows[s : s + 65536]], b[nodes[s : s + 65536]]) >= link for s in range(0, len(rows), 65536)]
    return np.concatenate(sure) if sure else np.zeros(0, bool)


def _smallest(ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest id that links among these classes lead to, for each class."""
    root = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    order = np.argsort(ids, kind="stable")
    while len(rows):
        before = root.copy()
        least = np.minimum(root[rows], root[nodes])
        np.minimum.at(root, rows, least)
        np.minimum.at(root, nodes, least)
        root = np.minimum(root, root[order[root]])
        if (root == before).all():
            break
    return ids[order[root]]


def found_by_row(df: DataFrame) -> DataFrame:
    """One row for each row of `embeddings`, whatever its label."""
    return components(df).select("vec_id", "n_links", "component_id", "kept")
