"""Licence notices: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a line of a document, together with the lines it runs on to: a line of at
least ``WRAPPED`` bytes that ends in a letter or a comma goes on in the next one if that
begins with a letter, as hard-wrapped notices do. Its features are the distinct 1-, 2- and
3-grams of its lower-cased words; a multinomial logistic regression over families and
"unknown" weighs those that occur in the templates. Training paragraphs are notices made
from the templates (with words dropped and neighbours added) and, as unknown, those of a
bounded sample of the corpus's rows, whole, licence words and all, unless they hold a
template. Half of them calibrate a temperature and the probability from which a family is
named, that at which at most ``WRONG`` of the held-out names are wrong. A paragraph that
looks more like a family than like none but stays below is reported as unknown. A
prediction is confirmed if the paragraph holds at least ``MIN_COVER`` of the word bigrams
of one of the family's templates.

Nulls and the like: null, empty and wordless texts give no rows; each notice of a
document is a row, also where it repeats; a paragraph of any length is scored whole; equal
rows give equal results each; on a tie the family first in the alphabet is named; rows
with a null doc_id are scanned too; without any corpus paragraph the model is trained on
templates and word lists alone; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import random
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import common, textvec

UNKNOWN = "unknown"
#: Corpus rows whose paragraphs train the unknown class: a documented bound of the classifier.
TRAIN_ROWS = 200
MIN_COVER = 0.6
#: Share of held-out names that may be wrong at the threshold, and bytes from which a line may be wrapped.
WRONG, WRAPPED = 0.01, 40
ORDERS = (1, 2, 3)

TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under the CC0 1.0 Universal dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; see the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful; see the GNU Lesser General Public License for more details.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at the Mozilla site.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
}
#: Ordinary sentences with licence words: lookalikes of the unknown class.
LOOKALIKES = (
    "The driver showed a license to the officer.",
    "Her fishing license was released in version 2 of the public register.",
    "The general public may use the work under the terms of the agreement.",
    "He was licensed to practise medicine in 2004.",
    "Students of MIT released a free program about software conditions.",
    "An Apache helicopter was used in the film.",
    "Permission is granted to enter the building.",
    "The GNU is a large antelope.",
    "All rights reserved by the publisher of this magazine.",
    "Copyright law differs from country to country.",
    "The software license costs forty dollars for each seat and year.",
    "See the terms of service for more details about the program.",
    "The library is free and open to any person with a card.",
    "Boost the engine before you distribute the load.",
    "The eclipse was visible to the public in the north.",
    "A creative mind finds common ground.",
)


def grams(w: textvec.Words, para: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of n words that stays in a paragraph, and the paragraph."""
    if len(w.h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(w.h) - n + 1
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = textvec.mix(h * np.uint64(0x100000001B3) + w.h[k : k + m])
    ok = para[:m] == para[n - 1 :]
    return h[ok], para[:m][ok]


_LETTER = textvec.WORD_BYTES.copy()
_LETTER[48:58] = False
_GOES_ON = _LETTER.copy()
_GOES_ON[ord(",")] = True


def breaks(w: textvec.Words) -> np.ndarray:
    """The ends of the step's paragraphs: newlines (the texts are joined by them) over which no wrapped line runs on."""
    lines = np.flatnonzero(w.buf == 10)
    before = np.concatenate(([-1], lines[:-1])) if len(lines) else lines
    wrapped = (lines - before > WRAPPED) & _GOES_ON[w.buf[lines - 1]] & _LETTER[w.buf[np.minimum(lines + 1, len(w.buf) - 1)]]
    return lines[~wrapped | np.isin(lines, w.offsets[1:] - 1)]


def paragraphs(w: textvec.Words) -> np.ndarray:
    """The number of each word's paragraph within the step."""
    return np.searchsorted(breaks(w), w.start)


@dataclass
class Model:
    families: list[str]  # "unknown" is the last
    features: np.ndarray  # hashes
    weights: np.ndarray  # features x families
    bias: np.ndarray
    temperature: float
    threshold: float
    template_of: np.ndarray  # bigram hash -> ...
    template: np.ndarray  # ... the template that has it
    size: np.ndarray  # bigrams of each template
    family: np.ndarray  # family of each template

    def predict(self, w: textvec.Words, para: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The paragraphs that have a known feature, and their calibrated probabilities."""
        hit_p, hit_f = [], []
        for n in ORDERS:
            h, p = grams(w, para, n)
            at = pc.fill_null(pc.index_in(pa.array(h.view(np.int64)), value_set=pa.array(self.features.view(np.int64))), -1).to_numpy(zero_copy_only=False)
            hit_p.append(p[at >= 0])
            hit_f.append(at[at >= 0].astype(np.int64))
        pair = np.unique(np.concatenate(hit_p) * len(self.features) + np.concatenate(hit_f))
        which, f = pair // max(len(self.features), 1), pair % max(len(self.features), 1)
        found, at = np.unique(which, return_inverse=True)
        z = np.stack([np.bincount(at, self.weights[f, k], len(found)) for k in range(len(self.families))], 1) + self.bias
        return found, _softmax(z / self.temperature)

    def cover(self, w: textvec.Words, para: np.ndarray, wanted: np.ndarray, family: np.ndarray) -> np.ndarray:
        """For each wanted paragraph the largest share of a template of its family that it holds."""
        inside = np.isin(para, wanted)
        part = textvec.Words(w.buf, w.offsets, w.start[inside], w.end[inside], w.doc[inside], w.first, w.h[inside])
        h, p = grams(part, para[inside], 2)
        best = np.zeros(len(wanted))
        for t in range(len(self.size)):
            mine = self.template_of[self.template == t]
            hit = np.isin(h, mine)
            pairs = np.unique(np.stack([p[hit].astype(np.uint64), h[hit]], 1), axis=0)[:, 0].astype(np.int64)
            share = np.bincount(np.searchsorted(wanted, pairs), minlength=len(wanted))[: len(wanted)] / self.size[t]
            best = np.where(family == self.family[t], np.maximum(best, share), best)
        return best


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return e / e.sum(1, keepdims=True)


def _vary(rng: random.Random, words: list[str], around: list[str]) -> str:
    """A notice as it may be met: a few words lost or added, ordinary words before or after it."""
    kept = [x for x in words if rng.random() > 0.06] or words
    if rng.random() < 0.5:
        kept = rng.choices(around, k=rng.randint(1, 12)) + kept
    if rng.random() < 0.5:
        kept = kept + rng.choices(around, k=rng.randint(1, 12))
    return " ".join(kept)


def holds_template(texts: list[str]) -> np.ndarray:
    """Whether each text holds at least ``MIN_COVER`` of the bigrams of some template."""
    w, own = textvec.words(pa.array(texts, pa.string())), textvec.words(pa.array([t for name in sorted(TEMPLATES) for t in TEMPLATES[name]]))
    h, p = grams(w, w.doc, 2)
    mine, of = grams(own, own.doc, 2)
    found = np.zeros(len(texts), bool)
    for t in np.unique(of).tolist():
        wanted = np.unique(mine[of == t])
        hit = np.isin(h, wanted)
        pairs = np.unique(np.stack([p[hit].astype(np.uint64), h[hit]], 1), axis=0)[:, 0].astype(np.int64) if hit.any() else np.zeros(0, np.int64)
        found |= np.bincount(pairs, minlength=len(texts)) >= MIN_COVER * len(wanted)
    return found


def train(corpus: list[str], seed: int = 7, variants: int = 24) -> Model:
    """corpus: paragraphs that stand for the unknown class."""
    rng = random.Random(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    corpus = [p for p in corpus if p and p.strip()]
    plain = [p for p, held in zip(corpus, holds_template(corpus)) if not held] + list(LOOKALIKES)
    around = [x for p in plain for x in p.split()]
    texts, label = [], []
    for k, name in enumerate(families[:-1]):
        for t in TEMPLATES[name]:
            for _ in range(variants):
                texts.append(_vary(rng, t.split(), around))
                label.append(k)
    for p in plain:
        texts.append(p)
        label.append(len(families) - 1)
    licence_words = sorted({x for ts in TEMPLATES.values() for t in ts for x in t.split()})
    for _ in range(variants * 4):  # licence vocabulary without a notice
        texts.append(" ".join(rng.choices(around, k=20) + rng.sample(licence_words, 3)))
        label.append(len(families) - 1)
    texts = [t.replace("\n", " ") for t in texts]
    y = np.array(label)
    w = textvec.words(pa.array(texts))
    own = textvec.words(pa.array([t for name in families[:-1] for t in TEMPLATES[name]]))
    features = np.unique(np.concatenate([grams(own, own.doc, n)[0] for n in ORDERS]))
    x = np.zeros((len(texts), len(features)))
    for n in ORDERS:
        h, p = grams(w, w.doc, n)
        at = np.searchsorted(features, h)
        ok = (at < len(features)) & (features[np.minimum(at, len(features) - 1)] == h)
        x[p[ok], at[ok]] = 1
    fit = np.array([rng.random() < 0.5 for _ in texts])
    weights, bias = np.zeros((len(features), len(families))), np.zeros(len(families))
    goal = np.eye(len(families))[y]
    balance = 1 / np.bincount(y[fit], minlength=len(families)).clip(1)[y]
    balance = (balance / balance[fit].sum())[:, None]
    for step in range(400):  # full-batch gradient with an L2 penalty
        error = (_softmax(x[fit] @ weights + bias) - goal[fit]) * balance[fit]
        weights -= 4.0 * (x[fit].T @ error + 1e-4 * weights)
        bias -= 4.0 * error.sum(0)
    held = x[~fit] @ weights + bias
    scale = min(np.geomspace(0.05, 20, 60).tolist(), key=lambda t: -np.log(_softmax(held / t)[np.arange(len(held)), y[~fit]] + 1e-12).mean())
    prob = _softmax(held / scale)
    named, wrong = np.sort(prob[:, :-1].max(1))[::-1], (prob[:, :-1].argmax(1) != y[~fit])[np.argsort(-prob[:, :-1].max(1), kind="stable")]
    good = np.flatnonzero(np.cumsum(wrong) <= WRONG * np.arange(1, len(wrong) + 1))
    threshold = float(max(named[good[-1]], 0.5)) if len(good) else 1.0
    template_of, template, size, family = [], [], [], []
    h, p = grams(own, own.doc, 2)
    for t, k in enumerate(k for k, name in enumerate(families[:-1]) for _ in TEMPLATES[name]):
        mine = np.unique(h[p == t])
        template_of.append(mine)
        template.append(np.full(len(mine), t))
        size.append(max(len(mine), 1))
        family.append(k)
    return Model(families, features, weights, bias, scale, threshold, np.concatenate(template_of), np.concatenate(template), np.array(size), np.array(family))


SCHEMA = "doc_id long, paragraph long, family string, probability double, similarity double, confirmed boolean"


def scan_step(model: Model, step: pa.RecordBatch) -> pa.RecordBatch:
    w = textvec.words(step.column("text"))
    para = paragraphs(w)
    found, prob = model.predict(w, para)
    best = prob[:, :-1].argmax(1) if len(found) else np.zeros(0, np.int64)
    p = prob[np.arange(len(found)), best] if len(found) else np.zeros(0)
    like = p > prob[:, -1] if len(found) else np.zeros(0, bool)
    found, best, p = found[like], best[like], p[like]
    named = p >= model.threshold
    cover = model.cover(w, para, found, best)
    lines = np.flatnonzero(w.buf == 10)
    begin = np.concatenate(([0], breaks(w) + 1))[found]  # of each paragraph
    doc = np.searchsorted(w.offsets, begin, side="right") - 1
    number = np.searchsorted(lines, begin) - np.searchsorted(lines, w.offsets[doc])  # of its first line in the document
    best = np.where(named, best, len(model.families) - 1)
    names = pa.array(np.array(model.families, object)[best], pa.string())
    return pa.RecordBatch.from_arrays([step.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int64)), names, pa.array(np.round(p, 6)), pa.array(np.round(cover, 6)), pa.array(named & (cover >= MIN_COVER))], [x.split()[0] for x in SCHEMA.split(", ")])


def train_on(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model whose unknown class knows paragraphs of about train_rows documents, chosen by a hash of doc_id."""
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    total = texts.count()
    if total > train_rows:
        texts = texts.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * train_rows / total))
    wanted = texts.select(F.xxhash64("id", "text").alias("h"), "text").orderBy("h").limit(2 * train_rows)
    return train([p for r in wanted.collect() for p in r.text.split("\n")])


_held: dict[str, Model] = {}


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), family, probability, similarity, confirmed: a row for each paragraph like a licence notice."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model or train_on(docs)), uuid.uuid4().hex

    def run(step: pa.RecordBatch) -> pa.RecordBatch:
        if name not in _held:
            _held.clear()
            _held[name] = sent.value
        return scan_step(_held[name], step)

    return common.map_steps(common.id_text(docs), run, SCHEMA)
