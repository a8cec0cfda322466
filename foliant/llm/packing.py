"""Best-fit packing of token pieces into sequences, improved by a swap-based local search.

Pieces are dealt at random into blocks of about BLOCK pieces, and each block is packed by one task. Pieces first go, in
the order they come, where they leave the least room; the local search then empties the least filled bins by moves,
one-for-one and two-for-one exchanges between underfull bins, each of which raises the sum of squared fills. Where it
ends above the volume bound, all short pieces are locked in full bins: the underfull bins and some full ones are filled
anew, largest first, and searched again, with more and more full bins until the bound is met or all took part.
"""

from __future__ import annotations

import contextlib
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import ROW, chunks, fresh, id_in, id_out, numbered, quoted, released, written

CAPACITY = 2048
#: Pieces a task packs at a time, and full bins that are first filled anew with the underfull ones.
BLOCK, ANEW = 4096, 64
#: Distinct parts of words of a generation whose ids a worker keeps.
CACHE = 250_000
#: Characters of the texts whose ids are found at a time.
TEXTS = 1 << 21
#: White space to Python and Arrow but perhaps not to the tokenizer.
ODD = "\x1c\x1d\x1e\x1f"
#: Letters of Latin-1 in lower case, which are one part, and signs that are a part of their own at a word's end.
LETTERS, ENDS = "[a-zß-öø-ÿ]+", "[.,;:!?%&$#*]"
VOCABULARY = "word_bpe_49k.json"
# The pre-tokenizer's pattern, and the signs that stand for the 256 bytes in the vocabulary.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _runs(first: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the items of the runs `of` in turn, where each of these ends); run i has size[i] items from first[i]."""
    n = size[of]
    ends = np.concatenate([[0], np.cumsum(n)])
    return np.arange(ends[-1]) + np.repeat(first[of] - ends[:-1], n), ends


class Cache:
    """Values by key in two generations: what was not asked for while a generation filled up goes.

    `make` gives the values of a list of new keys.
    """

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def all(self, keys: list[str]) -> list[bytes]:
        """Values of distinct keys."""
        out = list(map(self.young.get, keys))
        lost = [i for i, value in enumerate(out) if value is None]
        asked = [keys[i] for i in lost]
        found = list(map(self.old.get, asked))
        new = [i for i, value in enumerate(found) if value is None]
        for i, value in zip(new, self.make([asked[i] for i in new]), strict=True):
            found[i] = value
        for i, value in zip(lost, found, strict=True):
            out[i] = self.young[keys[i]] = value
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        return out


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokenizer drops white space and never matches across it, so a text's ids are those of its
    words in turn, and a word's those of its parts by the pre-tokenizer's pattern. Of the texts of a call each distinct
    part is looked up once, in a cache, and only new parts reach the vocabulary's merges. Where normalisation could do
    more than lower-case letters (words beyond Latin-1, white space on which Python differs), the tokenizer takes the
    word or text itself.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = [*ODD, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.pattern = regex.compile(PARTS)
        self.parts = Cache(self._merged)
        self.others = Cache(lambda words: [self._encoded(w) for w in words])

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, parts: list[str]) -> list[bytes]:
        tokenize, out = self.tokenizer.model.tokenize, []
        for part in parts:
            signs = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(BYTE_SIGNS)
            out.append(array("I", [t.id for t in tokenize(signs)]).tobytes())
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in turn, and how many each has."""
        plain, ended = (np.flatnonzero(pc.match_substring_regex(words, f"^{p}$")) for p in (LETTERS, LETTERS + ENDS))
        rest = np.ones(len(words), dtype=bool)
        rest[plain] = rest[ended] = False
        rest = np.flatnonzero(rest)
        parts, others, count, of = [], [], np.ones(len(words), dtype=np.int64), []
        for i, word in zip(rest.tolist(), words.take(rest).to_numpy(zero_copy_only=False).tolist(), strict=True):
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                of.append(-1 - len(others))
                others.append(word)
                continue
            found = self.pattern.findall(word.lower())
            count[i] = len(found)
            of += range(len(parts), len(parts) + len(found))
            parts += found
        count[ended] = 2
        first = np.cumsum(count) - count
        stems = words.take(ended)
        coded = pa.concat_arrays([words.take(plain), pc.utf8_slice_codeunits(stems, 0, -1), pc.utf8_slice_codeunits(stems, -1), pa.array(parts, pa.large_string())]).dictionary_encode()
        number, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.empty(int(count.sum()), dtype=np.int64)
        a, b = len(plain), len(plain) + len(ended)
        at[first[plain]], at[first[ended]], at[first[ended] + 1] = number[:a], number[a:b], number[b : b + len(ended)]
        own = np.array(of, dtype=np.int64)
        inside = own >= 0
        own[inside] = number[b + len(ended) :][own[inside]]
        own[~inside] = len(distinct) - 1 - own[~inside]
        at[_runs(first, count, rest)[0]] = own
        found = self.parts.all(distinct) + self.others.all(others)
        ids, size = np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        places, ends = _runs(np.cumsum(size) - size, size, at)
        return ids[places], ends[first + count] - ends[first]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out, split, places = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(sign in text for sign in self.whole):
                out[i] = self._encoded(text)
                continue
            with contextlib.suppress(UnicodeEncodeError):
                text.encode("latin-1")
                text = text.lower()
            split.append(text)
            places.append(i)
        if split:
            words = pc.utf8_split_whitespace(pa.array(split, pa.large_string()))
            coded = words.values.dictionary_encode()
            ids, size = self._words(coded.dictionary)
            at, ends = _runs(np.cumsum(size) - size, size, coded.indices.to_numpy())
            data = ids[at].tobytes()
            for i, (a, b) in zip(places, pairwise((ends[words.offsets.to_numpy()] * 4).tolist()), strict=True):
                out[i] = data[a:b]
        return out


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document (doc_id, text): doc_id, piece, start, length, ids (4 bytes each, little-endian).

    A document is the ids of its whole text, then id 0; null counts as empty. Only documents of more than `capacity`
    ids are cut, into pieces of `capacity` of which the last may be shorter.
    """
    path = path or vocabulary_path(VOCABULARY)

    def run(batches):
        # a local name, so that its caches are gone when `released` gives memory back
        find = WordIds(path)
        for part in chunks(batches, most=TEXTS):
            rows = []
            for doc_id, data in zip(part["doc_id"], find(part["text"].tolist()), strict=True):
                data += b"\0\0\0\0"
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(piece) // 4, piece))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(id_in(), "text").mapInPandas(released(run), "doc_id long, piece int, start long, length long, ids binary")


def best_fit(sizes: list[int], order: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, in the given order, goes where it leaves the least room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in order:
        size = sizes[i]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


def packed(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: a fill in the order of arrival, the local search, and new fills where it is stuck."""
    bins = local_search(sizes, best_fit(sizes, list(range(len(sizes))), capacity), capacity)
    least, anew = -(-sum(sizes) // capacity), ANEW
    while len(bins) > least:
        fills = [sum(sizes[i] for i in b) for b in bins]
        # underfull bins first, then full ones by their mean item
        order = sorted(range(len(bins)), key=lambda b: (fills[b] == capacity, fills[b] / len(bins[b])))
        some = [bins[b] for b in order[: sum(f < capacity for f in fills) + anew]]
        items = [i for b in some for i in b]
        own = [sizes[i] for i in items]
        again = local_search(own, best_fit(own, sorted(range(len(own)), key=lambda i: -own[i]), capacity), capacity)
        if len(again) < len(some):
            bins = [bins[b] for b in order[len(some) :]] + [[items[i] for i in b] for b in again]
        if len(some) == len(order):
            break
        anew *= 8
    return bins


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Exchanges items between underfull bins, the least filled first, until as few bins as fit are left or no exchange helps.

    Each exchange moves weight from a bin to one at least as full, which raises the sum of squared fills, so the search
    ends. A bin that found no step waits; once all wait, each looks at the bins that have changed since, and the search
    is over when none finds one.
    """
    size, bins = np.array(sizes, dtype=np.int64), [list(b) for b in bins]
    at = np.zeros(len(size), dtype=np.int64)
    for b, items in enumerate(bins):
        at[items] = b
    fill = np.bincount(at, weights=size, minlength=len(bins)).astype(np.int64)
    least, live, clock, again = -(-int(fill.sum()) // capacity), len(bins), 0, False
    waits, changed, checked = fill >= capacity, np.zeros(len(bins), dtype=np.int64), np.full(len(bins), -1)
    while live > least:
        if waits.all():
            if not again:
                break
            waits, again = (fill >= capacity) | (fill == 0), False
            continue
        d = int(np.where(waits, capacity, fill).argmin())
        step = _step(size, at, fill, bins[d], d, capacity, changed > checked[d])
        if not step:
            waits[d], checked[d] = True, clock
            continue
        give, b, take = step
        clock, again = clock + 1, True
        bins[d] = [i for i in bins[d] if i not in give] + take
        bins[b] = [i for i in bins[b] if i not in take] + give
        at[give], at[take] = b, d
        gain = int(size[give].sum() - size[take].sum())
        fill[d] -= gain
        fill[b] += gain
        for x in (d, b):
            changed[x], checked[x], waits[x] = clock, -1, not 0 < fill[x] < capacity
        live -= not bins[d]
    return [b for b in bins if b]


@lru_cache(maxsize=256)
def _two(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _step(size, at, fill, own, d, capacity, fresh):
    """(items that leave bin d, another bin, items that come back): the step that takes most out of d, else None.

    One item or two leave, and none or one comes back; `fresh` says which bins to look at.
    """
    open_ = fresh & (fill >= fill[d]) & (fill < capacity)
    open_[d] = False
    there = np.flatnonzero(open_)
    if not len(there):
        return None
    mine = size[own]
    i, j = _two(len(own))
    sums, first = np.unique(np.concatenate([mine, mine[i] + mine[j]]), return_index=True)
    back = np.flatnonzero(open_[at])
    take = np.concatenate([np.zeros(len(there), dtype=np.int64), size[back]])
    bins = np.concatenate([there, at[back]])
    most = np.searchsorted(sums, take + capacity - fill[bins], side="right") - 1
    gain = np.where(most >= 0, sums[most] - take, 0)
    k = int(gain.argmax())
    if gain[k] <= 0:
        return None
    g = int(first[most[k]])
    give = [own[g]] if g < len(own) else [own[i[g - len(own)]], own[j[g - len(own)]]]
    return give, int(bins[k]), [] if k < len(there) else [int(back[k - len(there)])]


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to the stored table `items`, whose `length` is 1 to `capacity`.

    All columns of items stay (its own `sequence_id` and `offset` would be replaced). Repeated rows are packed as often
    as they come, and lie in different blocks. An empty table gives an empty table.
    """
    kept = items.drop("sequence_id", "offset")
    names = fresh(kept, *ROW)
    order, place = fresh(kept, "pack_order", "pack_block")
    blocks = max(1, -(-kept.count() // block))
    stored = numbered(kept, names)
    dealt = stored.withColumn(order, F.xxhash64(names[1], *quoted(kept))).withColumn(place, F.pmod(order, F.lit(blocks)))
    columns = kept.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([order, *names], ignore_index=True)
        sizes = group["length"].tolist()
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        base = int(group[place].iloc[0]) << 32
        for b, members in enumerate(packed(sizes, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + b, at
                at += sizes[i]
        return group[columns].assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy(place).applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs whole documents (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one id. Null ids stay null; repeated rows are packed as often as they come;
    other columns are ignored.
    """
    found = pieces(docs, path, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(written(found, "pieces"), capacity).withColumn("doc_id", id_out())


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences of documents (doc_id, text) themselves: sequence_id, ids and doc_ids, a row per sequence.

    `ids` are its token ids, four bytes each, and `doc_ids` the documents of its pieces in order; nulls and repeated rows
    as in `pack_documents`. The pieces are written once, and only their lengths are packed.
    """
    stored = numbered(written(pieces(docs, path, capacity), "pieces"))
    placed = pack(written(stored.select(*[F.col(c).alias(f"of_{c}") for c in ROW], "length"), "lengths"), capacity)
    rows = stored.join(placed.drop("length"), [F.col(c) == F.col(f"of_{c}") for c in ROW])
    one = F.sort_array(F.collect_list(F.struct("offset", id_out(), "ids"))).alias("parts")
    parts = rows.groupBy("sequence_id").agg(one)
    return parts.select("sequence_id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
