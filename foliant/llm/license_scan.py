"""Licence scan: a trained paragraph classifier, with DataFrame operations alone on the scanning path.

A multinomial logistic regression over word n-grams (orders 1 to ORDERS) is fitted on the driver to variants of the
notices below and to paragraphs that use the same words otherwise; a temperature fitted on other variants calibrates it.
A paragraph is a run of lines without a blank one; it is judged whole, for notices that are wrapped, and line by line.
What is judged is of a family when that family's probability is at least SURE, and unknown otherwise. The notice nearest
to it by shared word pairs then confirms the family or does not. Only what holds neither a licence word nor any of the
words that `needed_words` derives from the weights leaves early: without one of those no family can come out on top.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.llm.common import ROW, numbered, written

ORDERS, SURE, CONFIRM = 3, 0.5, 0.5
#: Weight beyond unknown's, for some family, that an n-gram must have to stay in the model.
SAYING = 0.3
#: Variants of each notice to learn from, share of them kept for calibration, passes and penalty of the fit.
VARIANTS, HELD, PASSES, PENALTY, SEED = 40, 4, 150, 1e-3, 3
UNKNOWN = "unknown"

# Notices by family.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This software is distributed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0 or later.",
        "Distributed under the terms of the GPLv3.", "Released under the GPL, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL, version 2.1.", "Distributed under the terms of the LGPLv2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties are disclaimed.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.", "Released under the MPL 2.0.", "MPL 2.0",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
}
# Words that make a paragraph without a family count as unknown, and paragraphs that use them otherwise.
ANCHORS = [
    "licence", "licences", "licensed", "license", "licenses", "redistribute", "redistribution", "permission", "copyright",
    "gpl", "bsd", "gplv2", "gplv3", "lgpl", "lgplv2", "lgplv2.1", "lgplv3", "agpl", "agplv3", "mpl", "cc0", "warranty",
]
# Words of other meanings, and languages, that speak of licences only beside another word.
BESIDE = ["apache software", "apache v2", "under apache", "under mit", "mit x11", "gnu general", "gnu lesser", "gnu affero", "gnu free", "mozilla public", "cc by", "creative commons"]
OTHERWISE = [
    "Her driving license was renewed in May.", "All rights reserved. Copyright by the authors.", "He asked for permission to leave the room.",
    "The town council granted a fishing license to the harbour.", "Students at MIT built a small robot.", "Apache helicopters flew over the valley.",
    "The House of Commons met on Tuesday.", "The gnu is a large antelope of the plains.", "Licensed under the terms of the vendor agreement.",
    "Released under an open source license of the company.", "This work is licensed to the buyer only.", "Licensed under the Artistic License 2.0.",
    "Wealth redistribution was the theme of the debate.", "Please send a cc to the office.", "This license may be revoked without notice.",
    "The program is free for members of the club.", "Mozilla released a new browser version.", "Version 2.0 of the license server is available.",
    "Released under GPLv2 or later.", "Licensed under the AGPLv3.", "Dedicated to the public domain (CC0).", "The warranty of the machine ends after two years.",
    "Distributed under the terms of the GPLv2.", "Released under the GPL, version 2.", "The house is sold as is.",
]
#: Words of any English text, which `needed_words` tries to do without first.
COMMON = "the of and to in a is it for that with be by as not or this are any may can at on from have".split()
WORDS = r"[0-9a-z]+(?:\.[0-9]+)?"


def words(text: str) -> list[str]:
    return re.findall(WORDS, text.lower(), re.ASCII)


def ngrams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in range(1, ORDERS + 1) for i in range(len(tokens) - n + 1)}


def pairs(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + 2]) for i in range(len(tokens) - 1)}


def _variants(rng: random.Random) -> list[tuple[list[str], str]]:
    """Each notice whole, with words lost or between other words; other paragraphs likewise, and notices out of order."""
    filler = words(" ".join(OTHERWISE))
    plain = [w for w in filler if w not in {*ANCHORS, *" ".join(BESIDE).split()}]
    out = []
    for family, notices in [*NOTICES.items(), (UNKNOWN, OTHERWISE)]:
        for notice in notices:
            base = words(notice)
            for k in range(VARIANTS if family != UNKNOWN else VARIANTS // 2):
                tokens = list(base) if k % 3 == 0 else [w for w in base if rng.random() > 0.1]
                around = rng.choices(plain, k=rng.choice([0, 0, 3, 12]))
                cut = rng.randint(0, len(around))
                out.append((around[:cut] + tokens + around[cut:], family))
            if family != UNKNOWN:
                for _ in range(VARIANTS // 4):
                    mixed = rng.sample(base, max(1, len(base) // 2))
                    out.append((mixed, UNKNOWN))
    rng.shuffle(out)
    return out


def fit(seed: int = SEED) -> dict:
    """Weights by n-gram and class, biases, and the calibrated temperature already divided out."""
    rows = _variants(random.Random(seed))
    classes = [*NOTICES, UNKNOWN]
    # n-grams across a notice and the words drawn around it mean nothing
    vocabulary = sorted({g for t in [*sum(NOTICES.values(), []), *OTHERWISE] for g in ngrams(words(t))})
    index = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary) + 1))
    x[:, -1] = 1
    for r, (tokens, _) in enumerate(rows):
        x[r, [index[g] for g in ngrams(tokens) if g in index]] = 1
    y = np.eye(len(classes))[[classes.index(f) for _, f in rows]]
    held = np.arange(len(rows)) % HELD == 0
    w = np.zeros((x.shape[1], len(classes)))
    first, second = np.zeros_like(w), np.zeros_like(w)
    a, b = x[~held], y[~held]
    for t in range(1, PASSES + 1):
        gradient = a.T @ (_softmax(a @ w) - b) / len(a) + PENALTY * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    def calibrated(w):
        z = x[held] @ w
        return w / min((0.25 * 1.15**k for k in range(25)), key=lambda h: -np.log((_softmax(z / h) * y[held]).sum(axis=1)).mean())

    w = calibrated(w)
    # n-grams that say next to nothing go: the model is sparse, and few words of ordinary text are any of its own
    said = np.abs(w - w[:, [classes.index(UNKNOWN)]]).max(axis=1) >= SAYING
    w = calibrated(np.where(said[:, None] | (np.arange(len(w)) == len(w) - 1)[:, None], w, 0.0))
    index = {g: i for g, i in index.items() if said[i]}
    return {"classes": classes, "bias": w[-1].tolist(), "weights": {g: w[i].tolist() for g, i in index.items()}}


def needed_words(model: dict) -> list[str]:
    """Words one of which a text must hold for the model to put any family above unknown.

    For each family, all n-grams without such a word together weigh less than unknown's lead without any n-gram.
    """
    k = model["classes"].index(UNKNOWN)
    bias, grams = np.array(model["bias"]), list(model["weights"])
    over = np.array([model["weights"][g] for g in grams])
    over = np.maximum(np.delete(over - over[:, [k]], k, axis=1), 0)
    lead = np.delete(bias[k] - bias, k)
    if (lead <= 0).any():
        raise ValueError("the model names a family where no n-gram speaks for it")
    held: dict[str, list[int]] = {}
    for i, g in enumerate(grams):
        for w in set(g.split(" ")):
            held.setdefault(w, []).append(i)
    needed = set(held)
    for w in sorted(held, key=lambda w: (w not in COMMON, over[held[w]].sum(axis=0).max(), w)):
        rest = needed - {w}
        if (sum((over[i] for i, g in enumerate(grams) if not rest & set(g.split(" "))), np.zeros(len(lead))) < 0.999 * lead).all():
            needed = rest
    return sorted(needed)


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _grams(tokens: Column, n: int) -> Column:
    places = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(places, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def paragraphs(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """What is judged of `docs` (doc_id, text) and is of a family or holds a licence word.

    Returns the names of the row, doc_id, paragraph (from 0), line (from 1; 0 for a paragraph of several lines as a whole), family,
    probability, notice_similarity, confirmed. Whole texts of any length are read; null texts have no paragraphs; other
    columns are ignored.
    """
    return _judged(numbered(docs.select("doc_id", "text")), model)


def _judged(rows: DataFrame, model: dict | None) -> DataFrame:
    model = model or fit()
    spark = rows.sparkSession
    classes = model["classes"]
    words_of = lambda line: F.regexp_extract_all(F.lower(line), F.lit(WORDS), 0)
    # each line's words are made once, and a paragraph's are those of its lines; *_outer, as the filter that Spark derives
    # from explode would make them again
    parts = let(F.transform(F.split("block", "\n"), words_of), lambda t: F.concat(F.array(F.when(F.size(t) > 1, F.flatten(t))), t))
    lines = (
        rows.select(*ROW, "doc_id", F.posexplode_outer(F.split("text", r"\n(?:[ \t\r\f\x0B]*\n)+")).alias("paragraph", "block"))
        .select(*ROW, "doc_id", "paragraph", F.posexplode_outer(parts).alias("line", "tokens"))
        .where(F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in sorted({*needed_words(model), *ANCHORS, *(b.split(" ")[0] for b in BESIDE)})])))
    )
    # the model's tables hold one row per n-gram or word pair of the fixed notices, whatever the input
    weights = spark.createDataFrame([(g, w) for g, w in model["weights"].items()], "gram string, w array<double>")
    notices = [(f, i, p, len(pairs(words(t)))) for f, ts in NOTICES.items() for i, t in enumerate(ts) for p in sorted(pairs(words(t)))]
    known = spark.createDataFrame(notices, "family string, notice int, gram string, notice_size int")
    key = [*ROW, "doc_id", "paragraph", "line"]
    # n-grams are made within runs of words that some n-gram of the model has; few runs of ordinary text are longer than a word
    own = sorted({*model["weights"], *(r[2] for r in notices)})
    some = sorted({w for g in own for w in g.split(" ")})
    runs = F.split(F.array_join(F.transform("tokens", lambda t: F.when(t.isin(some), t).otherwise("|")), " "), r"[ |]*\|[ |]*")
    every = F.flatten(F.transform(F.filter(runs, lambda r: r != ""), lambda r: let(F.split(r, " "), lambda t: F.concat(*[_grams(t, n) for n in range(1, ORDERS + 1)]))))
    kept = F.array_intersect(every, F.array(*[F.lit(g) for g in own])).alias("grams")
    beside = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")).rlike(" (" + "|".join(BESIDE) + ") ")
    cue = (F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in ANCHORS])) | beside).alias("cue")
    held = written(lines.select(*key, cue, kept), "grams")
    found = held.select(*key, "cue", F.explode_outer("grams").alias("gram")).join(F.broadcast(weights), "gram", "left")
    z = found.groupBy(*key).agg(F.first("cue").alias("cue"), *[(F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)) + model["bias"][k]).alias(f"z{k}") for k in range(len(classes))])
    top = F.greatest(*[F.col(f"z{k}") for k in range(len(classes))])
    z = z.withColumn("top", top).withColumn("sum", sum((F.exp(F.col(f"z{k}") - F.col("top")) for k in range(len(classes))), F.lit(0.0)))
    family = F.coalesce(*[F.when(F.col(f"z{k}") == F.col("top"), F.lit(c)) for k, c in enumerate(classes)])
    judged = z.select(*key, "cue", (1 / F.col("sum")).alias("probability"), family.alias("guess"))
    judged = judged.withColumn("family", F.when((F.col("guess") != UNKNOWN) & (F.col("probability") >= SURE), F.col("guess")).otherwise(F.lit(UNKNOWN)))
    judged = judged.where(F.col("cue") | (F.col("family") != UNKNOWN))
    mine = held.select(*key, F.explode("grams").alias("gram"))
    # share of the notice's word pairs that the paragraph has: words around a notice do not count against it
    near = mine.join(F.broadcast(known), "gram").groupBy(*key, "family", "notice").agg((F.count("*") / F.max("notice_size")).alias("similarity"))
    best = near.groupBy(*key, "family").agg(F.max("similarity").alias("similarity"))
    out = judged.join(best, [*key, "family"], "left").withColumn("notice_similarity", F.coalesce("similarity", F.lit(0.0)))
    return out.select(*key, "family", "probability", "notice_similarity", (F.col("notice_similarity") >= CONFIRM).alias("confirmed"))


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, license, probability, similarity, confirmed, families, unknown.

    `license` is the surest confirmed family of the document's paragraphs, else the surest unconfirmed one, `unknown`
    where only unknown paragraphs hold a licence word, and null where none does. `families` lists all, in order;
    `unknown` counts unknown lines, but not those of a paragraph that as a whole is of a family none of its lines is.
    Repeated rows are scanned alike; null ids stay null; an empty table gives an
    empty table.
    """
    docs = numbered(docs.select("doc_id", "text"))
    found = _judged(docs, model)
    named = F.col("family") != UNKNOWN
    single = F.col("line") > 0
    best = F.max(F.struct((named & F.col("confirmed")).alias("sure"), named.alias("named"), "probability", "family", "notice_similarity"))
    per_paragraph = found.groupBy(*ROW, "paragraph").agg(
        best.alias("best"),
        F.collect_set(F.when(named, F.col("family"))).alias("families"),
        F.collect_set(F.when(named & single, F.col("family"))).alias("by_line"),
        F.max(F.when(named & ~single, F.col("family"))).alias("whole"),
        F.sum(F.when(~named & single, 1).otherwise(0)).alias("unknown"),
    )
    wrapped = F.col("whole").isNotNull() & ~F.array_contains("by_line", F.col("whole"))
    per_row = per_paragraph.groupBy(*ROW).agg(
        F.max("best").alias("best"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"),
        F.sum(F.when(wrapped, 0).otherwise(F.col("unknown"))).alias("unknown"),
    )
    rows = docs.select(*ROW, F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(per_row, ROW, "left").select(
        "doc_id",
        F.col("best.family").alias("license"),
        F.col("best.probability").alias("probability"),
        F.col("best.notice_similarity").alias("similarity"),
        F.coalesce("best.sure", F.lit(False)).alias("confirmed"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("unknown", F.lit(0)).cast("long").alias("unknown"),
    )


