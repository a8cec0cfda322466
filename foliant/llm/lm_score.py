"""Subword lattice likelihood: a unigram model over an existing piece vocabulary, summed over all segmentations.

The vocabulary's own scores order the pieces and give the first probabilities; expectation steps over every distinct
word of the training texts, weighted by its count, then fit them. A word's probability is the sum over all ways to
write it as pieces (forward recursion in log space); pieces never cross words, so a text's is the product of its words'
and of one end. Beside it stands a smoothed word unigram whose counts cover the whole training part of the corpus:
the most frequent words reach the scoring tasks as a table of at most HEAD entries, all others by a join on 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import ROW, chunks, id_in, id_out, numbered, released, remainder, written
from foliant.llm.kernels import _PRIME, _power, BYTE, FOLD, joined, mix, span_hashes, word_spans
from foliant.llm.packing import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
#: Entries of the broadcast table of frequent words, whatever the corpus: 16 bytes each.
HEAD = 1 << 17
#: Expectation steps, mass given to the first probabilities in each, and words whose score a worker keeps.
STEPS, PRIOR, CACHE = 4, 0.01, 400_000
#: Words up to this many bytes go through the recursion together, longer ones alone, so many bytes at a time.
LONG, SLICE = 64, 1 << 14
#: Words that go through the recursion together; leading bits of a key that are looked at first.
TOGETHER, COARSE = 50_000, 20
#: Levels of a doubling by which counts are sorted to find the most frequent words.
LEVELS = 16
_U = np.uint64


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Byte strings of the vocabulary and first probabilities by the rank its scores give; a word starts with a space.

    Pieces that hold a word start further in cannot occur. Every byte is a piece, so every word has a segmentation.
    The last entry is the end of a text.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score: dict[bytes, float] = {bytes([b]): -40_000.0 for b in range(256)}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or "▁" in piece[1:]:
            continue
        text = piece.replace("▁", " ").encode()
        score[text] = max(score.get(text, -1e12), model.get_score(i))
    pieces = sorted(score, key=lambda p: (-score[p], p))
    weight = 1.0 / (np.arange(len(pieces)) + 10.0)
    return [*pieces, b""], np.append(weight / weight.sum() * 0.99, 0.01)


class Lattice:
    """Forward and expectation passes over many distinct words at once."""

    def __init__(self, pieces: list[bytes], probability: np.ndarray):
        self.pieces = pieces
        self.log = np.log(probability)
        text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        size = np.array([len(p) for p in pieces[:-1]])
        end = np.cumsum(size)
        key = span_hashes(text, end - size, end)
        order = np.argsort(key)
        self.key, self.id = key[order], order
        self.some = np.zeros(1 << COARSE, dtype=bool)  # leading bits that some piece has
        self.some[(self.key >> _U(64 - COARSE)).astype(np.int64)] = True
        self.lengths = np.unique(size)
        self.by_text = {p: i for i, p in enumerate(pieces[:-1])}

    def _found(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are those of pieces, and the pieces' ids."""
        hit = np.flatnonzero(self.some[(key >> _U(64 - COARSE)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.key, key[hit]), len(self.key) - 1)
        same = self.key[at] == key[hit]
        return hit[same], self.id[at[same]]

    def _arcs(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Matches as (from, length, word numbers, piece ids), ascending by where they end; words longest first."""
        up, down = _power(max(len(data), 1 << 16))
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
        for stop in range(1, int(size[0]) + 1):
            active = int(np.searchsorted(-size, -stop, side="right"))
            end = start[:active] + stop
            to = total[end]
            for d in self.lengths:
                if d > stop:
                    break
                a = end - d
                hit, piece = self._found(mix((to - total[a]) * down[a] + _U(int(d) * int(_PRIME) % (1 << 64))))
                if len(hit):
                    yield stop - int(d), int(d), hit, piece

    def forward(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word, all segmentations together."""
        return self._run(words, None)

    def expect(self, words: list[bytes], count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece when each word comes `count` times; longer words count as stretches of LONG bytes."""
        uses = np.zeros(len(self.pieces))
        long = [i for i, w in enumerate(words) if len(w) >= LONG]
        if long:
            parts = [(words[i][at : at + LONG - 1], count[i]) for i in long for at in range(0, len(words[i]), LONG - 1)]
            kept = np.setdiff1d(np.arange(len(words)), long)
            words = [words[i] for i in kept] + [w for w, _ in parts]
            count = np.concatenate([count[kept], [c for _, c in parts]])
        for at in range(0, len(words), TOGETHER):
            self._run(words[at : at + TOGETHER], (count[at : at + TOGETHER], uses))
        return uses

    def _run(self, words, wanted):
        size = np.array([len(w) + 1 for w in words], dtype=np.int64)
        out = np.empty(len(words))
        short = np.flatnonzero(size <= LONG)
        short = short[np.argsort(-size[short], kind="stable")]
        for i in np.flatnonzero(size > LONG):
            out[i] = self._alone(b" " + words[i])
        if not len(short):
            return out
        data = np.frombuffer(b"".join(b" " + words[i] for i in short), dtype=np.uint8)
        size = size[short]
        start = np.cumsum(size) - size
        alpha = np.full((len(short), int(size[0]) + 1), -np.inf)
        alpha[:, 0] = 0.0
        arcs = []
        for begin, d, word, piece in self._arcs(data, start, size):
            stop = begin + d
            alpha[word, stop] = np.logaddexp(alpha[word, stop], alpha[word, begin] + self.log[piece])
            if wanted is not None:
                arcs.append((begin, d, word, piece))
        total = alpha[np.arange(len(short)), size]
        out[short] = total
        if wanted is not None:
            count, uses = wanted[0][short], wanted[1]
            beta = np.full(alpha.shape, -np.inf)
            beta[np.arange(len(short)), size] = 0.0
            ids, amount = [], []
            for begin, d, word, piece in sorted(arcs, key=lambda x: -x[0]):
                after = self.log[piece] + beta[word, begin + d]
                beta[word, begin] = np.logaddexp(beta[word, begin], after)
                ids.append(piece)
                amount.append(count[word] * np.exp(alpha[word, begin] + after - total[word]))
            uses += np.bincount(np.concatenate(ids), np.concatenate(amount), minlength=len(uses))
        return out

    def _alone(self, word: bytes) -> float:
        """Log probability of one word of any length: its matches are found a slice at a time, and few sums are kept."""
        data, most = np.frombuffer(word, dtype=np.uint8), int(self.lengths[-1])
        sums = [0.0]  # of the last places, the latest at the end
        for low in range(0, len(word), SLICE):
            stop = np.arange(low + 1, min(low + SLICE, len(word)) + 1)
            ends, back, log = [], [], []
            for d in self.lengths:
                end = stop[stop >= d]
                hit, piece = self._found(_keys(data, end - d, int(d)))
                ends.append(end[hit])
                back.append(np.full(len(hit), d))
                log.append(self.log[piece])
            ends = np.concatenate(ends)
            order = np.argsort(ends, kind="stable")
            bounds = np.searchsorted(ends[order], np.append(stop, stop[-1] + 1)).tolist()
            back, log = np.concatenate(back)[order].tolist(), np.concatenate(log)[order].tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                terms = [sums[-back[k]] + log[k] for k in range(a, b)]
                top = max(terms)
                sums.append(top + math.log(sum([math.exp(t - top) for t in terms])))
            del sums[:-most]
        return sums[-1]


def _keys(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """span_hashes of data[start:start + size], for spans in any order."""
    power = _power(1 << 10)[0]
    total = np.zeros(len(start), dtype=np.uint64)
    for k in range(size):
        total += BYTE[data[start + k]] * power[k]
    return mix(total + _U(size * int(_PRIME) % (1 << 64)))


def _distinct(texts):
    """Hash and place of each word, distinct hashes with their first place, and each word's number among them."""
    data, starts = joined(texts)
    data = FOLD[data]
    a, b = word_spans(data)
    key, first, inverse = np.unique(span_hashes(data, a, b), return_index=True, return_inverse=True)
    doc = np.searchsorted(starts, a, side="right") - 1
    return data, a, b, doc, key, first, inverse


def _count(batches):
    for part in chunks(batches, most=1 << 23):
        data, a, b, _, _, first, inverse = _distinct(part["text"].tolist())
        raw = data.tobytes()
        words = [raw[i:j] for i, j in zip(a[first], b[first], strict=True)]
        yield pd.DataFrame({"word": words, "c": np.bincount(inverse, minlength=len(words))})


def _expectation(lattice: Lattice):
    def run(batches):
        uses = np.zeros(len(lattice.pieces))
        for batch in batches:
            words, count = batch["word"].tolist(), batch["c"].to_numpy(dtype=float)
            uses += lattice.expect(words, count)
        used = np.flatnonzero(uses)
        yield pd.DataFrame({"piece": used, "uses": uses[used]})

    return run


def _hashed(batches):
    for batch in batches:
        words = batch["word"].tolist()
        size = np.array([len(w) + 1 for w in words])
        data = np.frombuffer(b"\n".join([*words, b""]), dtype=np.uint8)
        end = np.cumsum(size) - 1
        yield pd.DataFrame({"key": span_hashes(data, end - size + 1, end).view(np.int64), "c": batch["c"].to_numpy()})


def fit(vocab: DataFrame, texts: int, path: str) -> tuple[list[bytes], np.ndarray]:
    """Probabilities of the pieces by expectation steps over `vocab` (word binary, c long); collects a row per piece."""
    pieces, first = read_pieces(path)
    probability = first
    for _ in range(STEPS):
        rows = vocab.mapInPandas(released(_expectation(Lattice(pieces, probability))), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.zeros(len(pieces))
        for r in sorted(rows, key=lambda r: r["piece"]):
            uses[r["piece"]] = r["uses"]
        uses[-1] = texts
        mass = max(1.0, uses.sum())
        probability = (uses + PRIOR * mass * first) / (uses.sum() + PRIOR * mass)
    return pieces, probability


def _score(lattice: Lattice, head_key: np.ndarray, head_count: np.ndarray, total: int, distinct: int, ends: int):
    known: dict[str, np.ndarray] = {"key": np.empty(0, dtype=np.uint64), "log": np.empty(0)}
    base = np.log10(total + 0.1 * (distinct + 1))
    end_base = np.log10(ends + 0.1) - base
    end_score = lattice.log[-1] / np.log(10)

    def scores(key, words_of):
        at = np.minimum(np.searchsorted(known["key"], key), max(len(known["key"]) - 1, 0))
        new = np.flatnonzero(known["key"][at] != key) if len(known["key"]) else np.arange(len(key))
        out = np.empty(len(key))
        if len(known["key"]):
            out[:] = known["log"][at]
        for i in range(0, len(new), TOGETHER):
            out[new[i : i + TOGETHER]] = lattice.forward(words_of(new[i : i + TOGETHER]))
        if len(new):
            if len(known["key"]) + len(new) > CACHE:
                known.update(key=np.empty(0, dtype=np.uint64), log=np.empty(0))
            every = np.concatenate([known["key"], key[new]])
            order = np.argsort(every)[:CACHE]
            known.update(key=every[order], log=np.concatenate([known["log"], out[new]])[order])
        return out

    def run(batches):
        for part in chunks(batches, most=1 << 23):
            data, a, b, doc, key, first, inverse = _distinct(part["text"].tolist())
            row = part[ROW].to_numpy()
            raw = data.tobytes()
            log = scores(key, lambda at, a=a, b=b, first=first, raw=raw: [raw[i:j] for i, j in zip(a[first[at]], b[first[at]], strict=True)]) / np.log(10)
            n = np.bincount(doc, minlength=len(row))
            score = np.bincount(doc, log[inverse], minlength=len(row)) + end_score
            at = np.minimum(np.searchsorted(head_key, key), max(len(head_key) - 1, 0))
            in_head = head_key[at] == key if len(head_key) else np.zeros(len(key), dtype=bool)
            value = np.where(in_head, np.log10((head_count[at] if len(head_count) else 0) + 0.1) - base, 0.0)
            yield pd.DataFrame(
                {
                    **dict(zip(ROW, row.T, strict=True)),
                    "doc_id": part["doc_id"].to_numpy(),
                    "key": pd.array([None] * len(row), dtype="Int64"),
                    "n": n + 1,
                    "known": np.bincount(doc, in_head[inverse], minlength=len(row)).astype(np.int64) + (ends > 0),
                    "base": np.bincount(doc, value[inverse], minlength=len(row)) + end_base,
                    "score": score,
                }
            )
            rest = np.flatnonzero(~in_head[inverse])
            pair, times = np.unique(doc[rest] * max(1, len(key)) + inverse[rest], return_counts=True)
            at, word = np.divmod(pair.astype(np.int64), max(1, len(key)))
            yield pd.DataFrame(
                {
                    **dict(zip(ROW, row[at].T, strict=True)),
                    "doc_id": part["doc_id"].to_numpy()[at],
                    "key": pd.array(key.view(np.int64)[word], dtype="Int64"),
                    "n": times,
                    "known": 0,
                    "base": 0.0,
                    "score": 0.0,
                }
            )

    return run


def _head(counts: DataFrame) -> list:
    """The most frequent words, at most HEAD: all from the least level of counts on that leaves no more than that."""
    level = F.floor(F.log2("c") * LEVELS)
    found, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        found += r["n"]
        if found > HEAD:
            break
        least = r["level"]
    return [] if least is None else counts.where(level >= least).collect()


def score_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Scores all documents (doc_id, text), learning from those whose crc32(doc_id) modulo 10 is not 0.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null texts count as empty and have
    the end alone; without training rows every base token has probability one and the pieces keep their first
    probabilities. Repeated rows are scored and learned as often as they come; null ids count as the empty id and stay
    null; other columns are ignored.
    """
    path = path or vocabulary_path(VOCABULARY)
    train = remainder(F.col("doc_id"), 10) != 0
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    learned = docs.where(train)
    vocab = written(learned.select("text").mapInPandas(released(_count), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "vocab")
    ends = learned.count()
    sums = vocab.agg(F.sum("c").alias("c"), F.count("*").alias("v")).first()
    total, distinct = (sums["c"] or 0) + ends, sums["v"] + (ends > 0)
    pieces, probability = fit(vocab, ends, path)
    counts = written(vocab.mapInPandas(released(_hashed), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "counts")
    head = _head(counts)
    head_key = np.array([r["key"] for r in head], dtype=np.int64).view(np.uint64)
    order = np.argsort(head_key)
    head_count = np.array([r["c"] for r in head], dtype=np.int64)[order]
    model = (pieces, probability, head_key[order], head_count)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list = []

    def run(batches):
        if not made:
            p, q, k, c = shared.value
            made.append(_score(Lattice(p, q), k, c, total, distinct, ends))
        yield from made[0](batches)

    rows = numbered(docs).select(*ROW, id_in(), "text")
    scored = rows.mapInPandas(released(run), "row_file long, row_at long, doc_id long, key long, n long, known long, base double, score double")
    # rows of whole documents have no key: they get one of their own each, so that they spread over the join's tasks
    scored = scored.withColumn("own", F.col("key").isNull()).withColumn("key", F.coalesce("key", F.xxhash64(*ROW)))
    c = F.coalesce(F.col("c"), F.lit(0))
    full = float(np.log10(total + 0.1 * (distinct + 1)))
    per_row = (
        scored.join(counts, "key", "left")
        .select(
            *ROW,
            "doc_id",
            F.when(F.col("own"), F.col("n")).alias("n"),
            F.when(F.col("own"), F.col("known")).when(c > 0, F.col("n")).otherwise(0).alias("known"),
            F.when(F.col("own"), F.col("base")).otherwise(F.col("n") * (F.log10(c + 0.1) - full)).alias("base"),
            "score",
        )
        .groupBy(*ROW, "doc_id")
        .agg(*[F.sum(x).alias(x) for x in ("n", "known", "base", "score")])
        .withColumn("doc_id", id_out())
    )
    return per_row.select(
        "doc_id",
        (remainder(F.col("doc_id"), 10) == 0).alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
