"""Language identification: script ranges narrow the candidates, Viterbi over word scores labels spans.

A word is a maximal run of letters. Its score in a language is the sum of log frequencies of its character n-grams
(orders 1 to ORDERS, with marks at its ends, hashed). Languages that do not use the word's script in the training texts
are no candidates for it. The path of languages over a document's words maximises the sum of scores less SWITCH for
every change of language; runs of one language are the spans, and the language of most letters is the document's.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import chunks, fresh, give_back, quoted, released, remainder

#: Training documents per language (a sample by hash, in expectation), the bound of the classifier's fit.
SAMPLE = 1500
ORDERS, BUCKETS, SMOOTH = 3, 1 << 16, 0.5
#: Cost of a change of language, in nats, and least share of a language's letters for a script to count as its own.
SWITCH, OWN_SCRIPT = 12.0, 0.01
#: Languages a model may have: more of them are an error, as none may be left out.
LANGUAGES = 200
UNKNOWN = "und"

# First code points of the ranges that belong to one script, and the script's name.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
_FIRST = np.array([first for first, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(name) for _, name in SCRIPTS])
_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, and its lower case (itself where that is not one code point)."""
    if not _tables:
        # a block at a time: strings of all code points at once are 150 MB in each worker
        letter, lower = np.empty(sys.maxunicode + 1, dtype=bool), np.empty(sys.maxunicode + 1, dtype=np.uint32)
        for at in range(0, len(letter), 1 << 14):
            text = list(map(chr, range(at, min(at + (1 << 14), len(letter)))))
            letter[at : at + len(text)] = [c.isalpha() for c in text]
            lower[at : at + len(text)] = [ord(low) if len(low := c.lower()) == 1 else ord(c) for c in text]
        _tables["letter"], _tables["lower"] = letter, lower
    return _tables["letter"], _tables["lower"]


def grams(texts: list[str | None]):
    """Words of all texts: text number, size, script, and (n-gram bucket, word number) of every n-gram."""
    letter, lower = _letters()
    whole = "\n".join([*((t or "") for t in texts), ""])
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
    inside = np.zeros(len(code) + 2, dtype=np.int8)
    inside[1:-1] = letter[code]
    change = np.diff(inside)
    a, b = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    doc = np.searchsorted(starts, a, side="right") - 1
    code = np.where(inside[1:-1] == 1, lower[code], 1).astype(np.uint64)
    script = _SCRIPT[np.searchsorted(_FIRST, code[a], side="right") - 1] if len(a) else np.empty(0, dtype=np.int64)
    word = np.repeat(np.arange(len(a)), b - a)
    at = np.arange(len(word)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
    padded = np.concatenate([np.ones(1, dtype=np.uint64), code, np.ones(ORDERS, dtype=np.uint64)])
    out = []
    for order in range(1, ORDERS + 1):
        key = np.zeros(len(at), dtype=np.uint64)
        # from the second order on, an n-gram starts one before its letter, so that a word's start is marked
        for k in range(order):
            key = (key + padded[at + 1 + k - (order > 1)] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((key >> np.uint64(64 - 16)).astype(np.int64))
    return doc, b - a, script, out, word


def _counts(languages: list[str]):
    """Adds up n-grams and script letters by language: rows (lang, order or -1, bucket or script, n)."""
    index = {name: i for i, name in enumerate(languages)}

    def run(batches):
        total = np.zeros((ORDERS, len(languages), BUCKETS), dtype=np.int32)
        scripts = np.zeros((len(languages), len(NAMES)))
        for batch in batches:
            for part in chunks([batch], most=1 << 18):
                doc, size, script, keys, word = grams(part["text"].tolist())
                lang = part["lang"].map(index).to_numpy(dtype=np.int64)[doc]
                for order, key in enumerate(keys):
                    cell, n = np.unique(lang[word] * BUCKETS + key, return_counts=True)
                    total[order].reshape(-1)[cell] += n.astype(np.int32)
                scripts += np.bincount(lang * len(NAMES) + script, size, minlength=scripts.size).reshape(scripts.shape)
        for order in range(ORDERS):
            lang, key = np.nonzero(total[order])
            yield pd.DataFrame({"lang": lang, "order": order, "key": key, "n": total[order][lang, key]})
        lang, key = np.nonzero(scripts)
        yield pd.DataFrame({"lang": lang, "order": -1, "key": key, "n": scripts[lang, key]})

    return run


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Learns from `docs` (doc_id, text, lang): about `sample` documents of each language, by a hash of the id."""
    docs = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages are marked")
    languages = sorted(sizes)
    if not languages:
        return {"languages": []}
    rate = F.lit(0.0)
    for name in languages:
        rate = F.when(F.col("lang") == name, min(1.0, sample / sizes[name])).otherwise(rate)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < rate * 1_000_000).select("text", "lang")
    rows = chosen.mapInPandas(released(_counts(languages)), "lang int, order int, key int, n double").groupBy("lang", "order", "key").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((ORDERS, BUCKETS, len(languages)))
    scripts = np.zeros((len(NAMES), len(languages)))
    for (order,), part in rows.groupby(["order"]):
        (scripts if order < 0 else total[order])[part["key"], part["lang"]] = part["n"]
    used = (total.sum(axis=2) > 0).sum(axis=1)[:, None, None]
    tables = np.log((total + SMOOTH) / (total.sum(axis=1, keepdims=True) + SMOOTH * used))
    share = scripts / np.maximum(1, scripts.sum(axis=0))
    allowed = share >= OWN_SCRIPT
    allowed[~allowed.any(axis=1)] = True
    return {"languages": languages, "tables": tables.astype(np.float32), "allowed": allowed}


def word_scores(model: dict, texts: list[str | None]):
    """Score of each word in each language; a language that does not use the word's script is far behind."""
    doc, size, script, keys, word = grams(texts)
    n = len(model["languages"])
    score = np.zeros((len(doc), n))
    if len(doc):
        first = np.cumsum(size) - size
        for table, key in zip(model["tables"], keys, strict=True):
            score += np.add.reduceat(table[key], first, axis=0)
        score /= ORDERS
        score[~model["allowed"][script]] -= 1e4
    return doc, size, score


def viterbi(score: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word of one document (ties: the first language, and no change).

    Where no stretch of other languages gains more than its changes cost, the best single language is the whole path;
    that holds for most documents and is seen without a step per word.
    """
    lead = int(score.sum(axis=0).argmax())
    gain = np.cumsum(score.max(axis=1) - score[:, lead])
    if not len(gain) or gain[-1] <= switch:
        return np.full(len(score), lead)
    rest = score - score[:, [lead]]
    rest[:, lead] = -np.inf
    run = np.concatenate([[0.0], np.cumsum(rest.max(axis=1))])
    if (run - np.minimum.accumulate(run)).max() <= switch:
        return np.full(len(score), lead)
    steps = score.tolist()
    best, back = steps[0], []
    for now in steps[1:]:
        top = max(best)
        source = best.index(top)
        change = top - switch
        came = [i if x >= change else source for i, x in enumerate(best)]
        back.append(came)
        best = [(x if x >= change else change) + s for x, s in zip(best, now, strict=True)]
    path = [best.index(max(best))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return np.array(path[::-1])


def label(model: dict, texts: list[str | None], switch: float = SWITCH) -> list[tuple[str, float, list[tuple[int, str]]]]:
    """(language, score, spans as (words, language)) of each text.

    The score is the share of letters in spans of the language, times how surely the whole text is closer to it than to
    the next language; und scores 0.
    """
    doc, size, score = word_scores(model, texts) if model["languages"] else (np.empty(0, dtype=int), None, None)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b:
            out.append((UNKNOWN, 0.0, []))
            continue
        part, letters = score[a:b], size[a:b]
        path = viterbi(part, switch)
        weight = np.bincount(path, letters, minlength=len(model["languages"]))
        top = int(weight.argmax())
        total = part.sum(axis=0)
        others = np.delete(total, top)
        margin = total[top] - others.max() if len(others) else 50.0
        sure = 1.0 / (1.0 + np.exp(-np.clip(margin, -30.0, 30.0)))
        turn = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
        spans = [(int(j - i), model["languages"][path[i]]) for i, j in zip(turn[:-1], turn[1:], strict=True)]
        out.append((model["languages"][top], float(weight[top] / weight.sum() * sure), spans))
    return out


def language_column(docs: DataFrame, model: dict, spans: bool = False):
    """The language of each text of `docs` as a column; with `spans` a struct of lang_pred, lang_score and lang_spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    most = max(1 << 14, (1 << 21) // max(1, len(model["languages"])))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out = [x for part in chunks([pd.DataFrame({"text": batch})], most=most) for x in label(model, part["text"].tolist())]
            parts = [[{"words": n, "lang": name} for n, name in s] for _, _, s in out]
            yield pd.DataFrame({"lang_pred": [o[0] for o in out], "lang_score": [o[1] for o in out], "lang_spans": pd.Series(parts, dtype=object)})
        give_back()

    schema = "lang_pred string, lang_score double, lang_spans array<struct<words: int, lang: string>>"
    found = F.pandas_udf(run, schema)(F.col("text"))
    return found if spans else found["lang_pred"]


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """Adds lang_pred, lang_score and lang_spans (words, lang) to `docs`, whose other columns stay.

    Null texts and texts without a letter are `und` with score 0 and no spans; so are all texts under a model without
    languages. Columns of these names are replaced. An empty table gives an empty table.
    """
    kept = docs.drop("lang_pred", "lang_score", "lang_spans")
    name = fresh(kept, "found")[0]
    named = kept.withColumn(name, language_column(kept, model, spans=True))
    return named.select(*quoted(kept), *[F.col(f"{name}.{c}") for c in ("lang_pred", "lang_score", "lang_spans")])


def learn(docs: DataFrame, folds: int = 3, out: int = 1) -> dict:
    """Model of the documents whose crc32(doc_id) modulo `folds` is not `out`."""
    return fit(docs.where(remainder(F.col("doc_id"), folds) != out))


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every document; learns from two of three folds of docs itself."""
    model = learn(docs)
    return identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select(
        "doc_id",
        (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.size("lang_spans").alias("n_spans"),
    )
