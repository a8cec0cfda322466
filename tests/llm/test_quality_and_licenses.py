"""The quality model learns from its own labels alone and scores as its formula says; licences are judged as the model
says, line by line and paragraph by paragraph, and prose in other languages is no licence."""

import re
import zlib

import numpy as np
import pytest

from foliant.llm import license_scan, quality

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def scores(docs, labels):
    return {r["doc_id"]: (r["score"], r["predicted"], r["held_out"]) for r in quality.predict(docs, labels).collect()}


def test_held_out_labels_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r["doc_id"], r["quality"]) for r in labels.collect()]
    schema = "doc_id long, quality int"
    want = scores(docs, labels)
    flipped = [(i, 1 - q) if held_out(i) else (i, q) for i, q in rows]
    gone = [(i, q) for i, q in rows if not held_out(i)]
    invented = rows + [(i, 0) for i in range(10**6, 10**6 + 500)] + [(i, 1) for i in range(1000) if held_out(i)]
    assert sum(held_out(i) for i, _ in rows) > 50
    for other in (flipped, gone, invented):
        assert scores(docs, spark.createDataFrame(other, schema)) == want
    assert all(h == held_out(i) and p == (s >= 0.5) for i, (s, p, h) in want.items())


def test_scores_follow_the_formula(spark):
    """The scores of whole documents are the sum over all pairs of features, written out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "n_chars")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    some = docs.where("length(text) < 400").collect()[:12]
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.score_column(docs, model).alias("s")).collect()}
    for r in some:
        _, feature, value = quality.features([r["text"]], [float(r["n_chars"])])
        total = model["w0"] + sum(model["w"][f] * x for f, x in zip(feature, value, strict=True))
        for i in range(len(feature)):
            for j in range(i):
                total += float(model["v"][:, feature[i]] @ model["v"][:, feature[j]]) * value[i] * value[j]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_labels_that_disagree_or_repeat(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "x" * (i % 7), i) for i in range(60)], "doc_id long, text string, n_chars long")
    rows = [(i, i % 2) for i in range(40)]
    want = scores(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    again = rows * 3 + [(i, q) for i in range(40, 60) for q in (0, 1)] + [(None, 1), (3, 7)]
    assert scores(docs, spark.createDataFrame(again, "doc_id long, quality int")) == want


# --- licences ---


def judged(text, model):
    """{(paragraph, line): (family, probability, similarity)} by the model's own n-grams, for what is kept."""
    out = {}
    for p, block in enumerate(re.split(r"\n(?:[ \t\r\f\x0B]*\n)+", text or "")):
        lines = [license_scan.words(line) for line in block.split("\n")]
        parts = {i + 1: t for i, t in enumerate(lines)} | ({0: sum(lines, [])} if len(lines) > 1 else {})
        for place, tokens in parts.items():
            z = np.array(model["bias"]) + sum((np.array(model["weights"][g]) for g in license_scan.ngrams(tokens) if g in model["weights"]), np.zeros(len(model["bias"])))
            share = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            family = model["classes"][int(z.argmax())]
            if share.max() < license_scan.SURE:
                family = license_scan.UNKNOWN
            cue = bool(set(tokens) & set(license_scan.ANCHORS)) or any(f" {b} " in f" {' '.join(tokens)} " for b in license_scan.BESIDE)
            if family == license_scan.UNKNOWN and not cue:
                continue
            mine = license_scan.pairs(tokens)
            near = max((len(mine & license_scan.pairs(license_scan.words(n))) / len(license_scan.pairs(license_scan.words(n))) for n in license_scan.NOTICES.get(family, [])), default=0.0)
            out[p, place] = (family, share.max(), near)
    return out


def test_licenses_equal_the_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(10**6 + i, t) for i, t in enumerate([None, "", "MIT License", "mit licence\n\n\nGPL", "Licensed under\nthe Apache License,\nVersion 2.0.", "cc by", "gnu general", " \n \n ", "x" * 3000])]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    model = license_scan.fit()
    got = {}
    for r in license_scan.paragraphs(docs, model).collect():
        got[r["doc_id"], r["paragraph"], r["line"]] = (r["family"], r["probability"], r["notice_similarity"])
    want = {(r["doc_id"], *k): v for r in docs.collect() for k, v in judged(r["text"], model).items()}
    assert set(got) == set(want)
    for k, (family, probability, near) in want.items():
        assert got[k][0] == family and got[k][1] == pytest.approx(probability, abs=1e-9)
        assert got[k][2] == pytest.approx(near if family != license_scan.UNKNOWN else 0.0, abs=1e-9)


PROSE = [
    "Der Mann ging mit seinem Hund in den Wald, und die Frau kam mit dem Zug.", "Mit freundlichen Grüßen", "Wir fahren mit dem Rad.\nMit 20 Jahren zog er um.",
    "Il a reçu une lettre de sa mère et il est parti avec elle.", "Cette maison est libre de toute charge.", "La redistribución no fue tema del debate, dijo el señor.",
    "El libro está en la mesa con la carta.", "The House of Commons met on Tuesday.", "Students at MIT built a small robot.", "Apache helicopters flew over the valley.",
]


def test_prose_is_no_license(spark):
    rows = spark.createDataFrame(list(enumerate(PROSE)), "doc_id long, text string")
    assert {r["license"] for r in license_scan.scan(rows).collect()} == {None}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = license_scan.scan(docs).join(docs.select("doc_id", "lang", "text"), "doc_id")
    by_lang = found.groupBy("lang").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()
    unknown = {r["lang"]: r["count"] for r in found.where("license = 'unknown'").groupBy("lang").count().collect()}
    for r in by_lang:
        assert unknown.get(r["lang"], 0) < max(2, 0.01 * r["n"]), (r["lang"], unknown)
