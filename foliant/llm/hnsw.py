"""A hierarchical navigable small-world graph over one shard of unit vectors; many queries walk it in step, in numpy.

Nodes are numbered so that those of higher layers come first: layer l holds nodes 0 to its length. Layers are built from
the top, each by inserting batches of nodes that the layers above lead to their places.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Links of a node, twice as many in the lowest layer; beam while building; nodes inserted, and queries walking, at a time.
LINKS, BUILD_BEAM, BATCH = 16, 48, 256
#: Nodes of a query's beam that are expanded in one step.
AT_ONCE = 4
FIRST_BEAM = 16


@dataclass
class Graph:
    vectors: np.ndarray  # float32, of length 1
    layers: list[np.ndarray]  # neighbours of each node, -1 where there are fewer; the lowest layer first
    loose: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # nodes that no walk can reach: always compared
    beam: int = FIRST_BEAM


def levels(n: int, seed: int) -> list[int]:
    """How many nodes each layer holds, the lowest first: each holds about one in LINKS of the one below."""
    drawn = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
    return [int((drawn >= level).sum()) for level in range(max(drawn, default=0) + 1)]


def build(vectors: np.ndarray, seed: int = 0) -> Graph:
    graph = Graph(np.ascontiguousarray(vectors, np.float32), [])
    for count in reversed(levels(len(vectors), seed)):
        lowest = count == len(vectors)
        layer = np.full((count, LINKS * (2 if lowest else 1)), -1, np.int32)
        upper = len(graph.layers[0]) if graph.layers else 0
        start = 0
        while start < count:
            stop = min(count, start + BATCH)
            fresh = np.arange(start, stop)
            among = graph.vectors[fresh] @ graph.vectors[fresh].T
            ids, near = np.broadcast_to(fresh, among.shape), among.copy()
            np.fill_diagonal(near, -np.inf)
            if start:
                entries = _descend(graph, graph.vectors[fresh]) if start >= upper > 0 else np.zeros(len(fresh), np.int64)
                found, sims = walk(graph.vectors, layer, graph.vectors[fresh], entries, BUILD_BEAM)
                ids, near = np.concatenate([found, ids], 1), np.concatenate([sims, near], 1)
            ids, near = _best(ids, near, BUILD_BEAM)
            chosen = _chosen(graph.vectors, ids, near, LINKS)
            layer[fresh, :LINKS] = chosen
            _link_back(graph.vectors, layer, fresh, chosen)
            start = stop
        graph.layers.insert(0, layer)
    graph.loose = _unreached(graph)
    return graph


def search(graph: Graph, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Node ids and similarities of the best `beam` of each query, best first; -1 where there are fewer."""
    ids, sims = walk(graph.vectors, graph.layers[0], queries, _descend(graph, queries), beam)
    if len(graph.loose):
        ids = np.concatenate([ids, np.broadcast_to(graph.loose, (len(queries), len(graph.loose)))], 1)
        sims = np.concatenate([sims, queries @ graph.vectors[graph.loose].T], 1)
    return _best(ids, sims, beam)


def walk(vectors: np.ndarray, layer: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first walks of all queries over one layer, until each has expanded all of its beam."""
    n, many = len(queries), layer.shape[1]
    ids, sims, open_ = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32), np.zeros((n, beam), bool)
    ids[:, 0], open_[:, 0] = entries, True
    sims[:, 0] = np.einsum("bd,bd->b", queries, vectors[entries])
    seen = np.full((n, len(layer)), -1, np.int32)  # the step's place that saw the node first
    seen[np.arange(n), entries] = 0
    active, step = np.arange(n), 1
    at_once = min(AT_ONCE, beam)
    places = np.arange(at_once * many, dtype=np.int32)
    while len(active):
        waiting = np.where(open_[active], sims[active], -np.inf)
        pick = np.argpartition(-waiting, at_once - 1, axis=1)[:, :at_once] if at_once < beam else np.broadcast_to(np.arange(beam), waiting.shape)
        ready = np.take_along_axis(waiting, pick, 1) > -np.inf
        going = ready.any(1)
        active, pick, ready = active[going], pick[going], ready[going]
        if not len(active):
            break
        rows = active[:, None]
        open_[rows, pick] = False
        near = np.where(ready[:, :, None], layer[ids[rows, pick]], -1).reshape(len(active), -1)
        new = (near >= 0) & (seen[rows, near] < 0)
        stamp = step * len(places) + places  # of a node that comes twice in one step the last place counts
        r, c = np.nonzero(new)
        seen[active[r], near[r, c]] = stamp[c]
        new[r, c] = seen[active[r], near[r, c]] == stamp[c]
        r, c = np.nonzero(new)
        fresh = np.full(near.shape, -np.inf, np.float32)
        fresh[r, c] = np.einsum("pd,pd->p", queries[active[r]], vectors[near[r, c]])
        all_sims = np.concatenate([sims[active], fresh], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), top, 1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], new], 1), top, 1)
        sims[active] = np.take_along_axis(all_sims, top, 1)
        step += 1
    ids[sims == -np.inf] = -1
    return ids, sims


def _descend(graph: Graph, queries: np.ndarray) -> np.ndarray:
    at = np.zeros(len(queries), np.int64)
    for layer in reversed(graph.layers[1:] if len(graph.layers) and len(graph.layers[0]) == len(graph.vectors) else graph.layers):
        ids, sims = walk(graph.vectors, layer, queries, at, 2)
        at = ids[np.arange(len(ids)), sims.argmax(1)]
    return at


def _best(ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(sims == -np.inf, -1, ids), sims


def _chosen(vectors: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, up to `most` that are closer to the row than to any chosen before; places
    that stay free go to the best of the others."""
    out = np.full((len(ids), most), -1, np.int64)
    for start in range(0, len(ids), 512):
        mine, sims = ids[start : start + 512], near[start : start + 512]
        there = vectors[mine]
        among = there @ there.transpose(0, 2, 1)
        taken = np.zeros(mine.shape, bool)
        for j in range(mine.shape[1]):
            hidden = (taken[:, :j] & (among[:, j, :j] >= sims[:, j, None])).any(1)
            taken[:, j] = (mine[:, j] >= 0) & ~hidden & (taken.sum(1) < most)
        rank = np.argsort(np.where(mine < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :most]
        out[start : start + 512, : rank.shape[1]] = np.take_along_axis(mine, rank, 1)
    return out


def _link_back(vectors: np.ndarray, layer: np.ndarray, fresh: np.ndarray, chosen: np.ndarray) -> None:
    """Adds each new node to the nodes it chose; a node with too many chooses again."""
    to, source = chosen.ravel(), np.repeat(fresh, chosen.shape[1])
    source, to = source[to >= 0], to[to >= 0]
    sims = np.einsum("pd,pd->p", vectors[source], vectors[to])
    order = np.lexsort((-sims, to))
    to, source = to[order], source[order]
    nodes, first = np.unique(to, return_index=True)
    place = np.arange(len(to)) - np.repeat(first, np.diff([*first, len(to)]))
    come = np.full((len(nodes), LINKS), -1, np.int64)  # the closest LINKS of a batch; the others keep their own link
    kept = place < LINKS
    come[np.searchsorted(nodes, to[kept]), place[kept]] = source[kept]
    old = layer[nodes].astype(np.int64)
    come[(come[:, :, None] == old[:, None, :]).any(2)] = -1
    both = np.concatenate([old, come], 1)
    sims = np.where(both >= 0, np.einsum("nd,nkd->nk", vectors[nodes], vectors[both]), -np.inf)
    layer[nodes] = _chosen(vectors, *_best(both, sims, both.shape[1]), layer.shape[1])


def _unreached(graph: Graph) -> np.ndarray:
    if not graph.layers:
        return np.zeros(0, np.int64)
    layer = graph.layers[0]
    reached = np.zeros(len(layer), bool)
    edge = np.arange(len(graph.layers[1]) if len(graph.layers) > 1 else 1)
    reached[edge] = True
    while len(edge):
        nxt = np.unique(layer[edge])
        edge = nxt[(nxt >= 0) & ~reached[nxt]]
        reached[edge] = True
    return np.flatnonzero(~reached)
