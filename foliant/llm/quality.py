"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Its score is the logistic of  w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j ; the pairwise part is computed in
linear time as  1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].  Words are hashed into WORDS buckets, damped and
brought to length one; each statistic stands as one of BINS indicators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import chunks, remainder, written
from foliant.llm.kernels import FOLD, joined, span_hashes, word_spans

WORDS, BINS, FACTORS = 1 << 13, 12, 6
#: Labelled documents of each class the fit may use (a sample by hash, in expectation), its passes, step and penalty.
SAMPLE, PASSES, STEP, PENALTY = 1500, 60, 0.05, 1e-4
STATISTICS = ["letters", "upper", "digits", "marks", "other", "lines", "word_size", "distinct", "mark_words", "mark_runs", "capital_words", "word_again", "size", "meta_size"]
FEATURES = WORDS + len(STATISTICS) * BINS

# Classes of bytes. 1 letter, 2 upper case (also a letter), 3 digit, 4 mark, 5 line feed, 0 white space.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:127] = 4
_CLASS[128:] = 1
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[10] = 5


def features(texts: list[str | None], meta: list[float | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value), by document; every document has each statistic, metadata only where it is known."""
    n = len(texts)
    data, starts = joined(texts)
    a, b = word_spans(data)
    doc = np.searchsorted(starts, a, side="right") - 1
    kind = _CLASS[data]

    def per_doc(flag):
        run = np.concatenate([[0], np.cumsum(flag)])
        return (run[starts[1:]] - run[starts[:-1]]).astype(float)

    size = np.maximum(1.0, np.diff(starts) - 1.0)
    count = np.bincount(doc, minlength=n).astype(float)
    words = np.maximum(1.0, count)

    def per_word(flag):
        return np.bincount(doc, flag, minlength=n) / words

    mark = np.concatenate([[0], np.cumsum(kind == 4)])
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    letters = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2))])
    key = span_hashes(FOLD[data], a, b)
    bucket = (key >> np.uint64(64 - 13)).astype(np.int64)
    pair, times = np.unique(doc * WORDS + bucket, return_counts=True)
    word_doc, word = pair // WORDS, pair % WORDS
    value = 1.0 + np.log(times)
    value /= np.sqrt(np.maximum(1e-12, np.bincount(word_doc, value**2, minlength=n)))[word_doc]
    again = np.append(False, (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]))[: len(key)]
    run_of_marks = (kind[:-1] == 4) & (kind[1:] == 4) & (data[:-1] == data[1:])
    stats = [
        per_doc((kind == 1) | (kind == 2)) / size,
        per_doc(kind == 2) / size,
        per_doc(kind == 3) / size * 4,
        per_doc(kind == 4) / size * 2,
        per_doc(data < 9) / size * 4,
        np.log1p(per_doc(kind == 5)) / 8,
        np.bincount(doc, b - a, minlength=n) / words / 16,
        np.bincount(word_doc, minlength=n) / words,
        per_word(mark[b] - mark[a] > 0),
        per_doc(np.append(run_of_marks, False)) / size * 4,
        per_word((upper[b] - upper[a] > 1) & (upper[b] - upper[a] >= letters[b] - letters[a])),
        per_word(again),
        np.log1p(size) / 14,
    ]
    stats.append(np.array([np.nan if m is None or not m >= 0 else np.log1p(m) / 14 for m in meta], dtype=float))
    parts_doc, parts_feature = [word_doc], [word]
    for i, s in enumerate(stats):
        known = np.flatnonzero(~np.isnan(s))
        parts_doc.append(known)
        parts_feature.append(WORDS + i * BINS + np.clip(s[known] * BINS, 0, BINS - 1).astype(np.int64))
    values = np.concatenate([value, np.full(sum(len(d) for d in parts_doc[1:]), 0.5)])
    document, feature = np.concatenate(parts_doc), np.concatenate(parts_feature)
    order = np.argsort(document, kind="stable")
    return document[order], feature[order], values[order]


def decide(model: dict, document: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The machine's sum for each of n documents."""
    out = model["w0"] + np.bincount(document, model["w"][feature] * value, minlength=n)
    for v in model["v"]:
        part = v[feature] * value
        out += 0.5 * (np.bincount(document, part, minlength=n) ** 2 - np.bincount(document, part**2, minlength=n))
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def train(document, feature, value, label, weight, passes: int = PASSES) -> dict:
    """Fits the machine to weighted labels by full-batch steps with adapted sizes; the same data give the same model."""
    n, rng = len(label), np.random.default_rng(11)
    model = {"w0": 0.0, "w": np.zeros(FEATURES), "v": rng.normal(0, 0.03, (FACTORS, FEATURES))}
    weight = weight / max(1e-12, weight.sum())
    first, second = {}, {}

    def step(name, gradient, t):
        first[name] = 0.9 * first.get(name, 0.0) + 0.1 * gradient
        second[name] = 0.99 * second.get(name, 0.0) + 0.01 * gradient**2
        return STEP * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.99**t)) + 1e-8)

    for t in range(1, passes + 1):
        error = (logistic(decide(model, document, feature, value, n)) - label) * weight
        slope = error[document] * value
        change = {"w0": step("w0", error.sum(), t), "w": step("w", np.bincount(feature, slope, minlength=FEATURES) + PENALTY * model["w"], t)}
        for f, v in enumerate(model["v"]):
            total = np.bincount(document, v[feature] * value, minlength=n)
            gradient = np.bincount(feature, slope * (total[document] - v[feature] * value), minlength=FEATURES) + PENALTY * v
            change[f] = step(f, gradient, t)
        model["w0"] -= change["w0"]
        model["w"] -= change["w"]
        for f in range(FACTORS):
            model["v"][f] -= change[f]
    return model


def _sparse(batches):
    for batch in batches:
        for part in chunks([batch], most=1 << 20):
            document, feature, value = features(part["text"].tolist(), part["n_chars"].tolist())
            bounds = np.searchsorted(document, np.arange(len(part) + 1))
            cut = list(zip(bounds[:-1], bounds[1:], strict=True))
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "quality": part["quality"].to_numpy(), "feature": [feature[a:b] for a, b in cut], "value": [value[a:b] for a, b in cut]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Learns from `docs` (doc_id, text, n_chars) with a row in `labels` (doc_id, quality); None without two classes.

    Only labels of ids that `docs` has count, in sizes and weights too; an id whose labels disagree has none. About
    `sample` documents of each class, by a hash of the id and no more than 4 * `sample` ids in all, weighted so that
    classes count as they come; where ids repeat in `docs`, no more than 4 * `sample` rows are learned from, the first by
    a hash of their text.
    """
    labels = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    labels = written(labels.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"), "labels")
    sizes = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    rate = {q: min(1.0, sample / n) for q, n in sizes.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    chosen = labels.where(draw < F.when(F.col("quality") == 1, rate[1]).otherwise(rate[0])).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(4 * sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"), "quality")
    rows = rows.orderBy(F.xxhash64("doc_id", "text")).limit(4 * sample)
    found = rows.mapInPandas(_sparse, "doc_id long, quality int, feature array<int>, value array<double>").toPandas()
    if found["quality"].nunique() < 2:
        return None
    found = found.sort_values(["doc_id", "quality"], ignore_index=True)
    document = np.repeat(np.arange(len(found)), found["feature"].map(len))
    label = found["quality"].to_numpy(dtype=float)
    weight = np.where(label == 1, 1 / rate[1], 1 / rate[0])
    return train(document, np.concatenate(found["feature"].to_list()), np.concatenate(found["value"].to_list()), label, weight)


def score_column(docs: DataFrame, model: dict | None):
    """The model's score as a column of docs (text, n_chars): 0 to 1, 0.5 everywhere without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = shared.value
        for texts, meta in batches:
            out = []
            for part in chunks([pd.DataFrame({"text": texts, "meta": meta})], most=1 << 20):
                if model is None:
                    out.append(np.full(len(part), 0.5))
                else:
                    out.append(logistic(decide(model, *features(part["text"].tolist(), part["meta"].tolist()), len(part))))
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)

    return F.pandas_udf(run, "double")(F.col("text"), F.col("n_chars").cast("double"))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learning from two of three folds of the labelled ones.

    Null and empty texts have their structure statistics alone. A null n_chars is left out, a null id counts as the
    empty id, labels other than 0 and 1 are ignored, and without both classes every score is 0.5. Repeated rows are
    scored alike; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_chars")
    model = fit(docs.where(remainder(F.col("doc_id"), 3) != 1), labels)
    scored = docs.select("doc_id", score_column(docs, model).alias("score"))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
