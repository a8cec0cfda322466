"""Exact set-similarity join on word shingles by partition of the universe into segments.

Two sets of sizes a <= b with a similarity of 0.8 or more differ in at most a // 4 elements. A hash deals the universe
of shingles into as many segments as the size band of the smaller set asks for, so that some segment agrees:

* up to TINY shingles the whole set is one segment, found through its neighbourhood of a few deletions;
* below PLAIN shingles a segment may differ by one element: the set and each of its one-deletion neighbours are
  indexed, which doubles what one segment answers for while segments stay long enough to be selective;
* from PLAIN shingles on, segments must agree exactly.

A set is indexed in its own band and, as a possible larger partner, in the band below. Which segments a set looks up is
chosen by cost: any `needed` of its segments suffice, and those whose signatures fewest other sets have are taken.
Segments that nobody shares cost nothing, so a set with `needed` of those has no partner and drops out.
Entries of the index travel packed by ranges of signatures, and a range is sorted as arrays.

Rows that share a signature are not paired with each other. Signatures that the same sets share fall into one cluster,
whose sets are dealt into blocks; every two blocks meet in one group, and a group compares all its whole sets at once by
products of membership matrices. It returns how many links each set has there, and links enough to join what is linked.

Some signatures say little: short segments that lose an element are empty, and a passage of many documents can fill
whole segments. Clusters too large for one block are therefore split first: of two sets that link, each holds the rarest
common shingle among its own n // 5 + 1 rarest, so only sets of a cluster that share one of those stay together.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import ROW, chunks, fresh, id_in, id_out, numbered, released, written
from foliant.llm.components import connected_components
from foliant.llm.kernels import mix, shingle_sets

#: Sets of at most TINY shingles use whole-set deletions; of PLAIN or more, exact segments.
TINY, PLAIN = 14, 128
#: Of a segment's mean size in the largest set of a plain band, and of spare segments over those needed: with MORE of them
#: a set has too few that are not empty only nine standard deviations from the mean.
SEGMENT, SPARE, MORE = 2.8, 1.3, 36
#: Entries of one signature and part that meet those of other parts; further ones need not, and are dealt elsewhere.
OFTEN = 8
#: Shingles of the corpus for each bucket of signatures, tasks that buckets are dealt to, and entries packed at a time.
BUCKET, MOST_PARTS, FLUSH = 1 << 22, 100_000, 1 << 21
#: Sets, and shingles, that a block of a cluster holds in the mean at most, and columns of a membership matrix.
SIDE, LOAD, COLUMNS = 2048, 1 << 21, 2048
#: Pairs from which an element is counted by matrices, and pairs counted one by one at a time.
DENSE, PAIRS = 1 << 13, 1 << 21
#: Counters, by hash, of how often shingles come, which order them; links are the same in any order.
COUNTERS = 1 << 16
#: Rows of sets dealt to groups at a time.
DEALT = 1024
#: Sets that may share 64 bits with another one: at 1e11 sets some hundred are expected.
TWINS = 100_000
#: Bits that tell which rows a join wants: 64 to a broadcast row, so at most a few ten MB whatever the rows.
BITS = 1 << 25
_U = np.uint64


def reach(n: int) -> int:
    """The most elements by which a set of n and one at least as large differ when they link."""
    return n // 4


def needed(n: int) -> int:
    """Segments of which one surely agrees with those of any larger partner."""
    return 1 if n <= TINY else reach(n) // 2 + 1 if n < PLAIN else reach(n) + 1


def _edges() -> list[int]:
    """Lower ends of the size bands above TINY: a factor of about 1.42 below PLAIN, of 2 from there."""
    low, out = TINY + 1, []
    while low < PLAIN:
        out.append(low)
        low = min(PLAIN, -(-low * 17 // 12))
    return out + [PLAIN << k for k in range(40)]


EDGES = np.array(_edges(), dtype=np.int64)


def segments(band: int) -> int:
    high = int(EDGES[band + 1]) - 1
    return needed(high) + 1 if high < PLAIN else int(np.ceil(high / SEGMENT))


def used(n: int, band: int) -> int:
    """Segments, from the first, that a set of n indexes in a band; it never falls as n grows."""
    m = segments(band)
    if EDGES[band] < PLAIN:
        return min(m, n // 8 + 2)
    return min(m, int(np.ceil(SPARE * (n / 4 + 1) / -np.expm1(-n / m))) + MORE)


def signatures(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(signature, segment) arrays of one sorted set: of its own band first, then of the band below where it reaches it."""
    n = len(values)
    out = []
    token = mix(values + _U(0xA5A5))
    if n <= TINY:
        out.append((*_tiny(token),))
        return out
    band = int(np.searchsorted(EDGES, n, side="right")) - 1
    out.append(_banded(values, token, band))
    smallest = -(-n * 4 // 5)
    if band == 0 and smallest <= TINY:
        out.append((*_tiny(token),))
    elif band and smallest < EDGES[band]:
        out.append(_banded(values, token, band - 1))
    return out


def _tiny(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = token.sum(dtype=np.uint64)
    sums = [np.array([total])]
    for k in range(1, len(token) // 5 + 1):
        out = np.array(list(combinations(range(len(token)), k)))
        sums.append(total - token[out].sum(axis=1, dtype=np.uint64))
    sigs = np.unique(mix(np.concatenate(sums) ^ _U(0x71)))
    return sigs, np.zeros(len(sigs), dtype=np.int64)


def _banded(values: np.ndarray, token: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    m, limit = segments(band), used(len(values), band)
    # values are sorted, so the segments by their leading bits are consecutive
    place = ((values >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
    stop = int(np.searchsorted(place, limit))
    place, token = place[:stop], token[:stop]
    salt = _U(band << 40)
    if EDGES[band] >= PLAIN:
        if not stop:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        seg = place[first]
        return mix(np.add.reduceat(token, first) ^ mix(seg.astype(np.uint64) + salt)), seg
    total = np.zeros(limit, dtype=np.uint64)
    np.add.at(total, place, token)
    every = np.arange(limit)
    sig = np.concatenate([total, total[place] - token])
    seg = np.concatenate([every, place])
    sig = mix(sig ^ mix(seg.astype(np.uint64) + salt))
    sig, at = np.unique(sig, return_index=True)
    return sig, seg[at]


def node_of(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two numbers."""
    digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def name_of(values: np.ndarray, bits: int, twins: dict) -> tuple[int, int]:
    """The node of a set, `bits` long, and its other 64 bits; of sets that share a node all but one go by the other."""
    node, other = node_of(values)
    node &= (1 << bits) - 1 if bits < 64 else -1
    return twins.get((node, other), node), other


def _own_segments(values: np.ndarray) -> int:
    """How many segments a set indexes in its own band."""
    n = len(values)
    if n <= TINY:
        return min(n, 1)
    band = int(np.searchsorted(EDGES, n, side="right")) - 1
    limit = used(n, band)
    if EDGES[band] < PLAIN:
        return limit
    place = (values >> _U(32)) * _U(segments(band)) >> _U(32)
    place = place[: int(np.searchsorted(place, limit))]
    return int(np.count_nonzero(place[1:] != place[:-1])) + bool(len(place))


def _keys(bits: int):
    """Rows to the node of their set, its other bits and its size; node is null for texts without words."""

    def run(batches):
        for part in chunks(batches):
            values, bounds = shingle_sets(part["text"].tolist())
            rows = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                rows.append((*name_of(values[a:b], bits, {}), _own_segments(values[a:b])) if b > a else (None, None, 0))
            node, other, segs = zip(*rows, strict=True)
            yield pd.DataFrame(
                {
                    **{c: part[c].to_numpy() for c in (*ROW, "doc_id")},
                    "n": np.diff(bounds),
                    "segs": segs,
                    "node": pd.array(node, dtype="Int64"),
                    "other": pd.array(other, dtype="Int64"),
                }
            )

    return run


def _index(bits: int, twins: dict, buckets: int):
    """Signatures of each set (once a task), packed by bucket: nodes, entries of each, low signature bits, segments.

    A bucket is a range of signatures. Of a signature that comes more than OFTEN times in a part, the further entries
    go anywhere with their whole signatures: that it is shared is certain.
    """

    def packed(entries: list[tuple]):
        sig = np.concatenate([e[0] for e in entries])
        seg = np.concatenate([e[1] for e in entries]).astype(np.int32)
        node = np.repeat(np.array([e[2] for e in entries], dtype=np.int64), [len(e[0]) for e in entries])
        ordered = np.sort(sig)
        hot = np.unique(ordered[OFTEN:][ordered[OFTEN:] == ordered[:-OFTEN]])
        rows = []
        if len(hot):
            at = np.flatnonzero(np.isin(sig, hot))
            at = at[np.argsort(sig[at], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], sig[at[1:]] != sig[at[:-1]]]))
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            sure = at[rank >= OFTEN]
            for i in range(0, len(sure), FLUSH >> 4):
                some = sure[i : i + (FLUSH >> 4)]
                rows.append((int(mix(node[some[:1]].view(np.uint64))[0] % _U(buckets)), node[some].tobytes(), b"", sig[some].tobytes(), seg[some].tobytes()))
            keep = np.ones(len(sig), dtype=bool)
            keep[sure] = False
            sig, seg, node = sig[keep], seg[keep], node[keep]
        bucket = (sig >> _U(32)) * _U(buckets) >> _U(32)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        bucket, sig, seg, node = bucket[order], sig[order].astype(np.uint32), seg[order], node[order]
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(start, np.append(start[1:], len(bucket)), strict=True):
            turn = np.flatnonzero(np.concatenate([[True], node[a + 1 : b] != node[a : b - 1]]))
            count = np.diff(np.append(turn, b - a)).astype(np.uint32)
            kind = np.int8 if (most := seg[a:b].max()) < 1 << 7 else np.int16 if most < 1 << 15 else np.int32
            rows.append((int(bucket[a]), node[a:b][turn].tobytes(), count.tobytes(), sig[a:b].tobytes(), seg[a:b].astype(kind).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "nodes", "counts", "sigs", "segs"])

    def run(batches):
        seen: set[int] = set()
        entries, size = [], 0
        for part in chunks(batches):
            values, bounds = shingle_sets(part["text"].tolist())
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a == b or (node := name_of(values[a:b], bits, twins)[0]) in seen:
                    continue
                seen.add(node)
                for k, (sig, seg) in enumerate(signatures(values[a:b])):
                    entries.append((sig, seg if k == 0 else np.full(len(sig), -1), node))
                    size += len(sig)
                if size >= FLUSH:
                    yield packed(entries)
                    entries, size = [], 0
        if size:
            yield packed(entries)

    return run


def _met(batches):
    """Entries whose signature several nodes have, and how many have it, of the buckets whose rows come in succession.

    Entries that went elsewhere as certain come with 0 uses.
    """

    def shared(bucket: int, rows: list[tuple]) -> pd.DataFrame:
        node, low, seg = [], [], []
        for nodes, counts, sigs, segs in rows:
            count = np.frombuffer(counts, np.uint32)
            node.append(np.repeat(np.frombuffer(nodes, np.int64), count))
            low.append(np.frombuffer(sigs, np.uint32))
            seg.append(np.frombuffer(segs, f"i{len(segs) // len(low[-1])}").astype(np.int32))
        node, low, seg = np.concatenate(node), np.concatenate(low), np.concatenate(seg)
        order = np.argsort(low)
        same = low[order[1:]] == low[order[:-1]]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        node, low, seg = node[order], low[order], seg[order]
        order = np.lexsort((node, low))
        node, low, seg = node[order], low[order], seg[order]
        new = np.ones(len(low), dtype=bool)  # copies of a set in different parts are one entry
        new[1:] = (low[1:] != low[:-1]) | (node[1:] != node[:-1])
        node, low, seg = node[new], low[new], seg[new]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.empty(0, dtype=np.int64)
        uses = np.repeat(size := np.diff(np.append(first, len(low))), size)
        some = uses > 1
        sig = (np.uint64(bucket) << _U(32) | low[some].astype(np.uint64)).view(np.int64)
        return pd.DataFrame({"sig": sig, "node": node[some], "seg": seg[some], "uses": uses[some].astype(np.int32)})

    now, rows = -1, []
    for batch in batches:
        for bucket, nodes, counts, sigs, segs in zip(*(batch[c] for c in ("bucket", "nodes", "counts", "sigs", "segs")), strict=True):
            if not len(counts):
                sig, buckets = np.frombuffer(sigs, np.uint64), _U(batch["buckets"].iloc[0])
                low = sig & _U(0xFFFFFFFF) | ((sig >> _U(32)) * buckets >> _U(32)) << _U(32)
                yield pd.DataFrame({"sig": low.view(np.int64), "node": np.frombuffer(nodes, np.int64), "seg": np.frombuffer(segs, np.int32), "uses": np.int32(0)})
                continue
            if bucket != now:
                if rows:
                    yield shared(now, rows)
                now, rows = bucket, []
            rows.append((nodes, counts, sigs, segs))
    if rows:
        yield shared(now, rows)


def slots(values: np.ndarray) -> np.ndarray:
    return (mix(values + _U(0xC0C0)) >> _U(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def rarest(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 shingles of a set by their counters: sets that link have one of these in common."""
    return values[np.lexsort((values, counts[slots(values)]))[: len(values) // 5 + 1]]


def _counted(batches):
    total = np.zeros(COUNTERS, dtype=np.int64)
    for part in chunks(batches):
        total += np.bincount(slots(shingle_sets(part["text"].tolist())[0]), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"at": at, "c": total[at]})


def _rare(counts: np.ndarray):
    """(cluster, shingle, node) of the rarest shingles of each set, for each of its clusters."""

    def run(batches):
        for part in chunks(batches):
            values, bounds = shingle_sets(part["text"].tolist())
            rows = []
            for a, b, node, clusters in zip(bounds[:-1], bounds[1:], part["node"], part["clusters"], strict=True):
                some = rarest(values[a:b], counts).view(np.int64)
                rows.append((np.repeat(clusters, len(some)), np.tile(some, len(clusters)), np.full(len(some) * len(clusters), node)))
            yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("cluster", "shingle", "node"), zip(*rows, strict=True), strict=True)})

    return run


def _sets(batches):
    """Each set once for every group it is dealt to; `deals` holds cluster, lo, hi and own of each in succession."""
    for part in chunks(batches):
        values, bounds = shingle_sets(part["text"].tolist())
        deals = [np.asarray(d).reshape(-1, 4) for d in part["deals"]]
        at = np.repeat(np.arange(len(part)), [len(d) for d in deals])
        sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in range(0, len(at), DEALT):
            some = at[i : i + DEALT]
            out = part.iloc[some][["node", "copies", "clusters"]].reset_index(drop=True)
            deal = np.concatenate(deals)[i : i + DEALT]
            yield out.assign(**{c: deal[:, k] for k, c in enumerate(("cluster", "lo", "hi", "own"))}, values=[sets[j] for j in some])


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Elements that each set of `a` has in common with each of `b`; the sets are sorted and without repeats.

    Elements that many sets have are counted by products of membership matrices, others pair by pair.
    """
    rows, columns = _entries(a), _entries(b)
    universe = np.intersect1d(rows[1][rows[2]], columns[1][columns[2]], assume_unique=True)
    (x, i, count_x), (y, j, count_y) = _within(rows, universe), _within(columns, universe)
    dense = count_x * count_y >= DENSE
    pair = (x[~dense[i]], i[~dense[i]]), (y[~dense[j]], j[~dense[j]])
    both = np.zeros(len(a) * len(b), dtype=np.int64)
    each, first = count_y[pair[0][1]], (np.cumsum(np.where(dense, 0, count_y)) - np.where(dense, 0, count_y))[pair[0][1]]
    stop = np.cumsum(each)
    low = 0
    while low < len(each):
        high = max(low + 1, int(np.searchsorted(stop, stop[low] + PAIRS)))
        n = each[low:high]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[low:high], n)
        both += np.bincount(np.repeat(pair[0][0][low:high], n) * len(b) + pair[1][0][at], minlength=len(both))
        low = high
    both = both.reshape(len(a), len(b))
    place = np.cumsum(dense) - 1
    x, i, y, j = x[dense[i]], place[i[dense[i]]], y[dense[j]], place[j[dense[j]]]
    for low in range(0, int(dense.sum()), COLUMNS):
        width = min(COLUMNS, int(dense.sum()) - low)
        both += (_matrix(x, i, len(a), low, width) @ _matrix(y, j, len(b), low, width).T).astype(np.int64)
    return both


def _entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets and elements of all entries by element, and where each element's entries begin."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values = values[order]
    return owner[order], values, np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, dtype=np.int64)


def _within(entries: tuple, universe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets and columns of the entries whose elements are in the universe, by column, and entries of each column."""
    owner, values, start = entries
    if not len(universe):
        return owner[:0], owner[:0], np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(start, len(values)))
    column = np.minimum(np.searchsorted(universe, values[start]), len(universe) - 1)
    hit = universe[column] == values[start]
    return owner[np.repeat(hit, size)], np.repeat(np.arange(len(universe)), size[hit]), size[hit]


def _matrix(owner: np.ndarray, column: np.ndarray, n: int, low: int, width: int) -> np.ndarray:
    a, b = np.searchsorted(column, (low, low + width))
    out = np.zeros((n, width), dtype=np.float32)
    out[owner[a:b], column[a:b] - low] = 1
    return out


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of entries of a boolean matrix that join all rows and columns which its true entries join."""
    free_row, free_column = linked.any(axis=1), np.ones(linked.shape[1], dtype=bool)
    rows, columns = [], []
    for start in range(len(linked)):
        if not free_row[start]:
            continue
        free_row[start] = False
        front = np.array([start])
        while len(front):
            some = np.flatnonzero(free_column)
            part = linked[np.ix_(front, some)]
            hit = part.any(axis=0)
            reached = some[hit]
            rows.append(front[part[:, hit].argmax(axis=0)])
            columns.append(reached)
            free_column[reached] = False
            some = np.flatnonzero(free_row)
            part = linked[np.ix_(some, reached)]
            hit = part.any(axis=1)
            front = some[hit]
            rows.append(front)
            columns.append(reached[part[hit].argmax(axis=1)] if len(reached) else front)
            free_row[front] = False
    if not rows:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(rows), np.concatenate(columns)


def _compared(percent: int):
    """Groups of two blocks of a cluster, the rows of a group in succession, to link counts and links that join the linked.

    Rows out: (node, null, links) and (node, node, 0). A pair that meets in several clusters counts in the first.
    """

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        cluster = rows["cluster"].iloc[0]
        left = (rows["own"] == rows["lo"]).to_numpy()
        within = rows["lo"].iloc[0] == rows["hi"].iloc[0]
        sides = [rows[left], rows[left if within else ~left]]
        none = pd.DataFrame({"a": np.empty(0, dtype=np.int64), "b": pd.array([], dtype="Int64"), "links": np.empty(0, dtype=np.int64)})
        if not (len(sides[0]) and len(sides[1])):
            return none
        sets = [[np.frombuffer(v, np.uint64) for v in side["values"]] for side in sides]
        both, sizes = common(*sets), [np.array([len(s) for s in x], dtype=np.int64) for x in sets]
        linked = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
        if within:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return none
        before = [[np.unique(c[c < cluster]) for c in side["clusters"]] for side in sides]
        counted = linked & (common(*before) == 0) if any(map(len, before[0])) and any(map(len, before[1])) else linked
        nodes, copies = [side["node"].to_numpy() for side in sides], [side["copies"].to_numpy() for side in sides]
        counts = [(nodes[0], counted @ copies[1])]
        if not within:
            counts.append((nodes[1], copies[0] @ counted))
        i, j = forest(linked)
        node, links = (np.concatenate(x) for x in zip(*counts, strict=True))
        return pd.concat(
            [
                pd.DataFrame({"a": node, "b": pd.array([None] * len(node), dtype="Int64"), "links": links})[links > 0],
                pd.DataFrame({"a": nodes[0][i], "b": pd.array(nodes[1][j], dtype="Int64"), "links": 0}),
            ]
        )

    def run(batches):
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = rows[["cluster", "lo", "hi"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield group(rows.iloc[a:b])
            rest = rows.iloc[starts[-1] :]
        if rest is not None:
            yield group(rest)

    return run


def _twins(keys: DataFrame) -> dict:
    """New nodes of sets that differ from another set of their node: all but one of a node go by their other bits."""
    shared = written(keys.groupBy("node").agg(F.min("other").alias("one"), F.max("other").alias("two")).where("one <> two").select("node", "one"), "twins")
    if shared.isEmpty():
        return {}
    if shared.count() > TWINS:
        raise ValueError("more sets share a hash than chance allows")
    rows = keys.join(F.broadcast(shared), "node").where("other <> one").select("node", "other").distinct().collect()
    return {(r["node"], r["other"]): r["other"] for r in rows}


def _nodes(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, dict]:
    """Rows with their nodes; nodes with size, segments, copies, smallest id and first row; and nodes given a new name."""
    found = docs.mapInPandas(released(_keys(bits)), "row_file long, row_at long, doc_id long, n long, segs int, node long, other long")
    keys = written(found.withColumn("doc_id", id_out()), "keys")
    twins = _twins(keys)
    if twins:
        new = docs.sparkSession.createDataFrame([(a, b, c) for (a, b), c in twins.items()], "node long, other long, name long")
        keys = written(keys.join(F.broadcast(new), ["node", "other"], "left").withColumn("node", F.coalesce("name", "node")).drop("name"), "keys")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *ROW)).alias("first")
    nodes = keys.where("node is not null").groupBy("node").agg(
        F.max("n").alias("n"), F.max("segs").alias("segs"), F.count("*").alias("copies"), F.min("doc_id").alias("least"), first
    )
    return keys, written(nodes, "nodes"), twins


def _clusters(docs: DataFrame, nodes: DataFrame, bits: int, twins: dict) -> DataFrame:
    """(node, cluster): any two nodes that link are in one cluster together.

    A cluster is what nodes reach over their signatures in two steps from the smallest node. Every signature that some
    set looks up belongs to one cluster, with all sets that have it.
    """
    shingles = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-shingles // BUCKET))
    signed = docs.select("text").mapInPandas(released(_index(bits, twins, buckets)), "bucket long, nodes binary, counts binary, sigs binary, segs binary")
    dealt = signed.repartition(min(buckets, MOST_PARTS), "bucket").sortWithinPartitions("bucket").withColumn("buckets", F.lit(buckets).cast("long"))
    shared = written(dealt.mapInPandas(released(_met), "sig long, node long, seg int, uses int"), "shared")

    need = F.when(F.col("n") <= TINY, 1).when(F.col("n") < PLAIN, F.expr("n div 8 + 1")).otherwise(F.expr("n div 4 + 1"))
    own = F.col("seg") >= 0
    certain = shared.where("uses = 0").groupBy("sig").agg(F.count("*").cast("int").alias("more"))
    shared = shared.join(certain, "sig", "left").withColumn("uses", F.col("uses") + F.coalesce("more", F.lit(0)))
    cost = F.when(own, F.sum(F.col("uses") - 1).over(Window.partitionBy("node", "seg")))
    by_node = shared.repartition("node").withColumn("cost", cost)
    by_node = by_node.withColumn("rank", F.dense_rank().over(Window.partitionBy("node").orderBy(F.col("cost").asc_nulls_last(), "seg")))
    by_node = by_node.withColumn("with", F.coalesce(F.max(F.when(own, F.col("rank"))).over(Window.partitionBy("node")), F.lit(0)))
    marked = by_node.join(nodes.select("node", "n", "segs"), "node").select("sig", "node", (own & (F.col("rank") <= need - (F.col("segs") - F.col("with")))).alias("kept"))
    marked = written(marked, "marked")
    hubs = marked.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("most"), F.max("kept").alias("any"))
    alive = written(marked.join(hubs.where("any and hub <> most").select("sig", "hub"), "sig").select("sig", "node", "hub"), "alive")
    near = alive.groupBy("node").agg(F.min("hub").alias("near"))
    of_sig = alive.join(near, "node").groupBy("sig").agg(F.min("near").alias("cluster"))
    return written(alive.select("sig", "node").join(of_sig, "sig").select("node", "cluster").distinct(), "clusters")


def _likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows and texts of docs without most that are not in `wanted`, a stored table with ROW: one bit of a hash tells them."""
    bit = F.pmod(F.xxhash64(*ROW), F.lit(BITS))
    word, place = F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(63).cast("int")
    words = wanted.select(word, place.alias("place")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, place))").alias("bits"))
    return docs.select(*ROW, "text", word).join(F.broadcast(words), "word").where(F.getbit("bits", place) == 1).select(*ROW, "text")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `wanted` with their texts. These are by far the most bytes, and few are wanted."""
    return _likely(docs, wanted).join(wanted, ROW)


def _large(nodes: DataFrame, clusters: DataFrame, side: int) -> DataFrame:
    """Clusters of more than one block, and how many they take."""
    sized = clusters.join(nodes.select("node", "n"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / side), F.ceil(F.sum("n") / LOAD))
    return sized.groupBy("cluster").agg(blocks.alias("blocks")).where("blocks > 1")


def _split(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, side: int) -> DataFrame:
    """`clusters`, those of more than one block split into sets that share one of their rarest shingles.

    Any two nodes that link still are in one cluster together. What shares none of its rarest shingles drops out.
    """
    large = written(_large(nodes, clusters, side).select("cluster"), "large")
    if large.isEmpty():
        return clusters
    members = clusters.join(large, "cluster").groupBy("node").agg(F.collect_list("cluster").alias("clusters"))
    members = written(members.join(nodes.select("node", *[f"first.{c}" for c in ROW]), "node"), "split-rows")
    members = written(_texts(docs, members).select("node", "clusters", "text"), "members")
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for at, c in members.select("text").mapInPandas(released(_counted), "at long, c long").groupBy("at").agg(F.sum("c")).collect():
        counts[at] = c
    rare = members.mapInPandas(released(_rare(counts)), "cluster long, shingle long, node long")
    rare = written(rare.select("cluster", "node", F.xxhash64("cluster", "shingle").alias("sig")), "rare")
    hubs = rare.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub <> most")
    alive = written(rare.join(hubs.select("sig", "hub"), "sig"), "sharing")
    near = alive.groupBy("cluster", "node").agg(F.min("hub").alias("near"))
    of_sig = alive.join(near, ["cluster", "node"]).groupBy("sig").agg(F.min("near").alias("near"))
    parts = alive.join(of_sig, "sig").select("node", F.xxhash64("cluster", "near").alias("cluster")).distinct()
    whole = clusters.join(large, "cluster", "left_anti").select("node", "cluster")
    return written(whole.unionByName(parts), "split")


def _linked(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, side: int) -> DataFrame:
    """Link counts of nodes, and links that join all nodes which links join: (a, null, links) and (a, b, 0)."""
    large = _large(nodes, clusters, side)
    many = clusters.join(large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    many = many.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    deals = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.array(F.col("cluster"), F.least("own", b), F.greatest("own", b), F.col("own")))
    dealt = many.groupBy("node").agg(F.flatten(F.flatten(F.collect_list(deals))).alias("deals"), F.collect_list("cluster").alias("clusters"))
    dealt = written(dealt.join(nodes.select("node", "copies", *[f"first.{c}" for c in ROW]), "node"), "deals")
    sets = _texts(docs, dealt).select("node", "copies", "clusters", "deals", "text")
    schema = "node long, copies long, clusters array<long>, cluster long, lo long, hi long, own long, values binary"
    grouped = sets.mapInPandas(released(_sets), schema).repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    return written(grouped.mapInPandas(released(_compared(80)), "a long, b long, links long"), "linked")


def _joined(docs: DataFrame, bits: int = 64, side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """For numbered docs: rows with their nodes, and nodes with their component, its smallest id and first row, and their links."""
    docs = docs.select(*ROW, id_in(), "text")
    keys, nodes, twins = _nodes(docs, bits)
    linked = _linked(docs, nodes, _split(docs, nodes, _clusters(docs, nodes, bits, twins), side), side)
    comps = connected_components(linked.where("b is not null").select("a", "b"))
    others = linked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    known = nodes.join(comps, "node", "left").join(others, "node", "left")
    known = known.select("node", "least", "first", F.coalesce("comp", "node").alias("comp"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    known = written(known, "known")
    heads = known.groupBy("comp").agg(F.min("least").alias("component_id"), F.min("first").alias("head"))
    return keys, written(known.join(heads, "comp").select("node", "comp", "component_id", "head", "links"), "placed")


def similarity_components(docs: DataFrame, side: int = SIDE, bits: int = 64) -> DataFrame:
    """Components of documents (doc_id, text) whose shingle sets have a Jaccard similarity of 0.8 or more.

    Returns doc_id, n_shingles, component_id, links and comp, a row per row of docs. component_id is the smallest doc_id
    reachable, null ids aside (null where the component has no other). Null and empty texts have no shingles and stay
    alone, with null comp; equal sets, repeated rows among them, share a component, and an empty table gives an empty
    table. Texts of any length are whole. `links` counts the other rows that a row links with, those with an equal set
    among them. Sets are told apart by 128 bits (`bits` of them, 64 by default, in most places), shingles by 64. Other
    columns of docs are ignored.
    """
    keys, nodes = _joined(numbered(docs.select("doc_id", "text")), bits, side)
    nothing = F.lit(None).cast("long")
    alone = keys.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("links"), nothing.alias("comp"))
    rows = keys.where("node is not null").join(nodes, "node")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "links", "comp").unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near copies: of each component the row with the smallest doc_id stays.

    Null ids come last; of rows with that doc_id the first stored one stays; rows without words stay all. Columns and
    their names are those of docs.
    """
    names = fresh(docs, *ROW)
    stored = numbered(docs, names)
    rows = stored.select(*[F.col(a).alias(b) for a, b in zip(names, ROW, strict=True)], "doc_id", "text")
    keys, nodes = _joined(rows)
    gone = keys.where("node is not null").join(nodes.select("node", "head"), "node").where(" or ".join(f"{c} <> head.{c}" for c in ROW))
    gone = written(gone.select(*[F.col(a).alias(b) for a, b in zip(ROW, names, strict=True)]), "gone")
    return stored.join(gone, names, "left_anti").drop(*names)
