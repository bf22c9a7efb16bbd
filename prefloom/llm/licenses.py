"""Operator 1 (native), license scans by a trained paragraph classifier.

A sparse logistic regression on word uni- and bigrams tells license families and an unknown class apart; a
predicted family is confirmed by comparing the paragraph's bigrams with the family's templates.  The model
is trained here: license paragraphs come from the templates below, in several wordings, and the unknown
class from fixed sentences and from a bounded sample of the corpus' own paragraphs (``NEGATIVES`` paragraphs
of the documents with the least hashes of doc_id, in the order of their hashes; paragraphs that mostly consist
of a template's bigrams are left out, near misses stay in as unknown).  The temperature of the softmax is fitted
on whole wordings and on unknown paragraphs that were held out of training, so that the unknown class is
calibrated; ``reliability`` holds the mean probability and the accuracy of the held-out rows.

Scanning is one pass without a shuffle.  Every n-gram of the model holds an anchor, a template word that the
unknown sample lacks.  Without an anchor only the bias speaks, and it says unknown (the model sees to that), so
documents and paragraphs without any anchor are set aside by a look-up of their words: a shortcut that changes
no prediction.

Defined results: null and empty texts have no paragraph and no license; paragraphs are lines; texts of any length
are scanned whole; of equally likely families the first by name is taken; repeated rows each get their result; an
empty table gives none, and the model is then trained on the fixed sentences alone; other columns pass through
(``licenses`` is replaced).
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEGATIVES = 4000
#: share of a corpus paragraph's bigrams from which it may be a license and is no sample of the unknown
NEAR_MISS = 0.3
LEAST_P = 0.5
LEAST_LIKENESS = 0.4
#: Names of licenses by family, and sentences of their notices
NAMES = {
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license"),
    "mit": ("MIT License", "MIT license", "The MIT License (MIT)", "X11 MIT license"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD license", "Simplified BSD License"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL-3.0-or-later", "GPLv3", "GPLv2"),
    "lgpl": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPL-2.1-or-later", "LGPLv3"),
    "agpl": ("GNU Affero General Public License, version 3", "GNU AGPL", "AGPL-3.0-or-later", "AGPLv3"),
    "mpl": ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0", "MPL 2.0"),
    "cc-by": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution ShareAlike 3.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc0": ("CC0 1.0", "CC0-1.0", "Creative Commons Zero", "CC0 1.0 Universal Public Domain Dedication"),
    "isc": ("ISC License", "ISC license"),
    "unlicense": ("Unlicense", "The Unlicense"),
}
NOTICES = {
    "apache": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "agpl": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",),
    "cc-by": ("To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",),
    "cc-by-sa": ("To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",),
    "cc-by-nc": ("To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",),
    "cc0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",),
    "proprietary": ("All rights reserved.", "Copyright (c) 2020 The Authors. All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
WORDINGS = ("{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the terms of the {}.", "This software is available under the {}.", "SPDX-License-Identifier: {}", "The code is covered by the {}.", "License: {}")
OTHERS = (
    "The driver showed a valid license at the border.",
    "A fishing license costs ten dollars and is renewed each year.",
    "The reserved seats are on the left side of the hall.",
    "He studied at MIT before he moved to the coast.",
    "Human rights groups wrote to the public prosecutor.",
    "The general public was invited to the opening of the free museum.",
    "An Apache helicopter landed near the village.",
    "Her version of the story was published in a public magazine.",
    "The software company hired two hundred people this year.",
    "Permission to enter was granted by the mayor.",
    "Copies of the report are available in the library.",
    "The creative team gave attribution to common sources.",
)
_WORD = re.compile(r"[a-z0-9]+")


def grams(paragraph: str) -> set[str]:
    w = _WORD.findall(paragraph.lower())
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


def _paragraphs() -> tuple[list[str], list[str], list[bool]]:
    """Texts, families, and whether a text's wording is held out of the first fit."""
    text, family, out = [], [], []
    for f, names in NAMES.items():
        for n in names:
            for k, w in enumerate(WORDINGS):
                text.append(w.format(n))
                family.append(f)
                out.append(k % 4 == 3)
    for f, notices in NOTICES.items():
        for n in notices:
            words = n.split()
            for a in range(0, max(1, len(words) - 7), 6):  # notices are often broken into lines
                text += [" ".join(words[a : a + 12]), " ".join(words[a:])]
                family += [f, f]
                out += [a % 24 == 18] * 2
    return text, family, out


class Model:
    """Classes, vocabulary, weights (gram x class), bias, temperature, anchors and templates."""

    def __init__(self, negatives: list[str], l1: float = 2e-4, steps: int = 250):
        text, label, apart = _paragraphs()
        self.templates = {}
        for t, f in zip(text, label, strict=True):
            self.templates.setdefault(f, set()).update(g for g in grams(t) if " " in g)
        every = set().union(*self.templates.values())
        share = lambda n: len(grams(n) & every) / max(1, sum(" " in g for g in grams(n)))
        negatives = [*OTHERS, *(n for n in negatives if share(n) < NEAR_MISS)]
        common = set().union(*(set(_WORD.findall(n.lower())) for n in negatives))
        self.anchors = sorted({w for t in text for w in _WORD.findall(t.lower())} - common - {"a", "c", "s", "d"} | {"license", "licensed", "apache", "rights", "reserved", "copyright", "gnu", "gpl"})
        hold = set(self.anchors)
        vocabulary = sorted({g for t in text for g in grams(t) if hold & set(g.split())})
        self.classes = ["unknown", *sorted(self.templates)]
        place = {g: i for i, g in enumerate(vocabulary)}
        # equal rows are one row with more weight; most paragraphs of the corpus hold none of the vocabulary
        rows: dict[tuple, int] = {}
        held: dict[tuple, bool] = {}
        for t, f, o in [*zip(text, label, apart, strict=True), *((n, "unknown", k % 4 == 3) for k, n in enumerate(negatives))]:
            row = (self.classes.index(f), *sorted(place[g] for g in grams(t) if g in place))
            rows[row] = rows.get(row, 0) + 1
            held[row] = held.get(row, True) and o
        y, many = np.array([r[0] for r in rows]), np.array(list(rows.values()))
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, r in enumerate(rows):
            x[i, list(r[1:])] = 1
        test = np.array([held[r] for r in rows])
        share = np.bincount(y, weights=many, minlength=len(self.classes))
        weight = many / np.maximum(share, 1)[y]
        w, b = self.fit(x[~test], y[~test], weight[~test], l1, steps)
        z = x[test] @ w + b
        nll = lambda t: -(weight[test] * np.log(np.maximum(softmax(z / t)[np.arange(len(z)), y[test]], 1e-12))).sum()
        self.temperature = float(min(np.geomspace(0.2, 3, 28), key=nll))
        p = softmax(z / self.temperature)
        sure, right = p.max(axis=1), p.argmax(axis=1) == y[test]
        self.reliability = (float(np.average(sure, weights=many[test])), float(np.average(right, weights=many[test]))) if test.any() else (1.0, 1.0)
        w, self.bias = self.fit(x, y, weight, l1, steps)
        self.bias[0] = max(self.bias[0], self.bias[1:].max() + 1e-6)  # nothing known is unknown
        used = np.flatnonzero(np.abs(w).max(axis=1) > 1e-6)
        self.vocabulary, self.weights = [vocabulary[i] for i in used], w[used]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Softmax regression with an L1 penalty, by accelerated proximal gradient."""
        k = len(self.classes)
        target, weight = np.eye(k)[y], weight / weight.sum()
        rate = 1 / (0.5 * float((weight * (x.sum(axis=1) + 1)).sum()) + 1e-9)
        w = v = np.zeros((x.shape[1], k))
        b = c = np.zeros(k)
        for t in range(1, steps + 1):
            g = (softmax(x @ v + c) - target) * weight[:, None]
            new = v - rate * (x.T @ g)
            new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
            bias = c - rate * g.sum(axis=0)
            m = (t - 1) / (t + 2)
            v, c, w, b = new + m * (new - w), bias + m * (bias - b), new, bias
        return w, b

    def predict(self, paragraph: str) -> tuple[str, float, float]:
        """(family, probability, likeness to the family's templates) by the plain way, for tests."""
        g = grams(paragraph)
        at = [i for i, v in enumerate(self.vocabulary) if v in g]
        p = softmax((self.bias + self.weights[at].sum(axis=0))[None, :] / self.temperature)[0]
        f = self.classes[int(p.argmax())]
        two = {x for x in g if " " in x}
        return f, float(p.max()), len(two & self.templates.get(f, set())) / max(1, len(two))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, negatives: int = NEGATIVES) -> Model:
    """Paragraphs come from up to negatives / 4 documents, at most 20 of each."""
    ids = docs.select(F.col("doc_id").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, negatives // 4)).collect()
    some = docs.where(F.col("doc_id").isin([r.doc_id for r in ids]))
    rows = some.select(F.explode(F.slice(F.split("text", "\n"), 1, 20)).alias("p")).orderBy(F.xxhash64("p"), "p").limit(negatives)
    return Model([r.p for r in rows.collect()])


def _grams(p: Column) -> Column:
    w = F.regexp_extract_all(F.lower(p), F.lit("([a-z0-9]+)"), F.lit(1))
    two = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, i: F.concat_ws(" ", a, F.get(w, i + 1)))
    return F.array_distinct(F.concat(w, two))


def _constant(value, kind: str) -> Column:
    """One literal of a nested type, folded when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, model: Model | None = None, least_p: float = LEAST_P, least_likeness: float = LEAST_LIKENESS) -> DataFrame:
    """``docs`` with ``licenses``: an array of (paragraph, family, p, likeness, confirmed), one for each license paragraph."""
    m = train(docs) if model is None else model
    anchors, vocabulary = _constant(m.anchors, "array<string>"), _constant(m.vocabulary, "array<string>")
    weights = _constant({g: [float(v) for v in w] for g, w in zip(m.vocabulary, m.weights, strict=True)}, "map<string,array<double>>")
    bias, classes = _constant([float(v) for v in m.bias], "array<double>"), _constant(m.classes, "array<string>")
    templates = _constant({f: sorted(t) for f, t in sorted(m.templates.items())}, "map<string,array<string>>")
    words = lambda c: F.split(F.lower(c), "[^a-z0-9]+")
    may = F.arrays_overlap(words(F.col("text")), anchors)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: F.arrays_overlap(words(x["p"]), anchors))
    rest = [c for c in docs.columns if c != "licenses"]
    d = docs.select(F.struct(*[docs[c] for c in rest]).alias("row"), F.when(may, F.transform(lines, lambda x: F.struct(x["i"].alias("i"), _grams(x["p"]).alias("g")))).alias("__g"))
    add = lambda g: F.aggregate(F.array_intersect(g, vocabulary), bias, lambda a, x: F.zip_with(a, F.element_at(weights, x), lambda u, v: u + v))
    d = d.withColumn("__g", F.transform("__g", lambda x: F.struct(x["i"].alias("i"), x["g"].alias("g"), F.transform(add(x["g"]), lambda z: z / m.temperature).alias("z"))))
    d = d.withColumn("__g", F.transform("__g", lambda x: F.struct(x["i"].alias("i"), x["g"].alias("g"), F.array_max(x["z"]).alias("top"), x["z"].alias("z"))))
    d = d.withColumn(
        "__g",
        F.transform(
            "__g",
            lambda x: F.struct(
                x["i"].alias("i"),
                F.filter(x["g"], lambda g: F.contains(g, F.lit(" "))).alias("two"),
                F.element_at(classes, F.array_position(x["z"], x["top"]).cast("int")).alias("family"),
                (1 / F.aggregate(x["z"], F.lit(0.0), lambda a, z: a + F.exp(z - x["top"]))).alias("p"),
            ),
        ),
    )
    d = d.withColumn("__g", F.filter("__g", lambda x: (x["family"] != "unknown") & (x["p"] >= least_p)))
    like = lambda x: F.size(F.array_intersect(x["two"], F.element_at(templates, x["family"]))) / F.greatest(F.size(x["two"]), F.lit(1))
    out = F.transform(
        "__g",
        lambda x: F.struct(x["i"].alias("paragraph"), x["family"].alias("family"), x["p"].alias("p"), like(x).alias("likeness"), (like(x) >= least_likeness).alias("confirmed")),
    )
    kind = "array<struct<paragraph:int,family:string,p:double,likeness:double,confirmed:boolean>>"
    return d.select(*[F.col("row").getField(c).alias(c) for c in rest], F.coalesce(out.cast(kind), F.array().cast(kind)).alias("licenses"))


def by_document(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, the confirmed families by name, and the least certain confirmed probability."""
    d = scan(docs.select("doc_id", "text"), model)
    ok = F.filter("licenses", lambda x: x["confirmed"])
    return d.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_paragraphs"),
        F.array_join(F.sort_array(F.array_distinct(F.transform(ok, lambda x: x["family"]))), ",").alias("families"),
        F.array_min(F.transform(ok, lambda x: x["p"])).alias("least_p"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"], F.when(x["confirmed"], "confirmed").otherwise("unconfirmed"))), ",").alias("paragraphs"),
    )
