"""Licence scans with a trained paragraph classifier.

Paragraphs (lines; windows of ``WINDOW`` words, half overlapping, where a line
is longer) are classified into licence families or *unknown* by multinomial
logistic regression over hashed word unigrams and bigrams, sparse and
L2-normalised. It is trained here: positives are windows of the families'
notices with words dropped, replaced and put in surrounding prose; negatives are
paragraphs of a bounded sample of the corpus and other legal phrases. A held-out
third of the former and the whole corpus set the temperature of the probabilities and the threshold below which a
paragraph is unknown. Notices that are wrapped over lines, or lie across two
windows of a line, are sought in windows of ``RUNS`` words over each block of
lines without a blank one between them; they count where the notice begins.

Template comparison confirms a prediction: of the families that the classifier
gives at least ``RIVAL`` of its best probability, the one whose notice is most
alike counts, and it has to reach ``CONFIRM``. Likeness is the share of the
notice's words that occur in the paragraph in order, each weighted by how rare
the word is among the lines, so that the words that tell licences apart decide; of
equal likeness the notice of greater weight wins.

Counts and calibration are of the whole corpus: how rare a word of the notices
is comes from all lines, temperature and threshold from the scores of all
paragraphs that match no notice, which have the weight that the sample's
held-out lines would have. Only the weights are fitted on the sample.

Bounds of the training sample, all parameters: ``NEGATIVE_DOCS`` documents (the
least by a hash of their text, equal texts once) of at most ``NEGATIVE_CHARS``
characters, of which ``NEGATIVE_LINES`` lines, the first ``WINDOW`` words of
each; surrounding prose is made of ``FILLER_WORDS`` words. Scanning has no bounds.

Defined results: null, empty and wordless texts have no licences; several
paragraphs of a family give several rows; repeated rows repeat; of equally
probable and alike families the first in ``NOTICES`` counts; an empty corpus
trains on the notices alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm.bpe import ranges
from inkstrata.llm.textvec import U64, Words, map_text, mix, slices, table

FEATURES = 1 << 16
WINDOW = 32
#: Window lengths over blocks of lines, each a third of itself apart: any 8, 16 or 32 words in a row are in one; the longest notice has 29.
RUNS = (12, 24, 48)
NEGATIVE_DOCS, NEGATIVE_CHARS, NEGATIVE_LINES, FILLER_WORDS = 300, 20_000, 6000, 4000
COPIES = 40  # training variants of each notice
CONFIRM, RIVAL = 0.8, 0.05
PRECISION = 0.995  # asked of the threshold on the held-out third
TEMPERATURES = np.exp(np.linspace(-2, 2, 41))
BINS = 1000  # of the confidence, in which the threshold is sought
UNKNOWN = "unknown"
#: family -> notices, which are what is learned and what is compared.
NOTICES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 License."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GNU General Public License version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPLv3.", "You should have received a copy of the GNU General Public License along with this program."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the LGPLv3.", "You should have received a copy of the GNU Lesser General Public License along with this library."],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only", "Licensed under the AGPLv3."],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under CC BY-SA 3.0.", "Released under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.", "Released under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 3.0.", "Text is available under CC BY-NC-SA 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License v2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "BSL": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Licensed under the zlib license.", "SPDX-License-Identifier: Zlib"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "This document is proprietary and confidential. All rights reserved."],
}
#: Legal and ordinary phrases that are no licence.
OTHER = [
    "A driving license is required for this position.", "The license plate was seen by a witness.", "Apache helicopters and the city of Apache Junction.", "The public hearing on general rights was held.",
    "The university of MIT released a paper.", "Permission to enter is granted to any person.", "The source of the river is subject to the terms of the treaty.", "Version 2.0 of the report was released.",
    "This work is about the general public.", "The right of way is reserved.", "All seats reserved.", "Software and documentation are on the disk.", "Creative writing for the commons.",
]
FAMILIES = [UNKNOWN, *NOTICES]
SCHEMA = "doc_id bigint, paragraph int, family string, probability double, similarity double"


@dataclass
class Paragraphs:
    """Runs of words that are classified: ``begin``/``end`` are word numbers, ``row`` and ``line`` say where."""

    words: Words
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    line: np.ndarray


def _lines(w: Words) -> np.ndarray:
    """The line of its row, from 0, in which each word lies."""
    newline = np.concatenate([[0], np.cumsum(w.buf == 10)])
    return newline[w.start] - newline[w.text_off[:-1]][w.doc]


def paragraphs(text: pa.Array) -> Paragraphs:
    w = Words(text)
    if not len(w.doc):
        none = np.zeros(0, np.int64)
        return Paragraphs(w, none, none, none, none)
    line = _lines(w)
    cut = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])]))
    stop = np.append(cut[1:], len(w.doc))
    half = WINDOW // 2
    pieces = np.where(stop - cut <= WINDOW, 1, -(-(stop - cut - half) // half))
    first = np.repeat(cut, pieces) + half * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    last = np.minimum(first + WINDOW, np.repeat(stop, pieces))
    return Paragraphs(w, first, last, w.doc[first].astype(np.int64), line[first])


def block_windows(w: Words) -> Paragraphs:
    """Windows of ``RUNS`` words over the blocks that have several lines or a line of several windows."""
    none = np.zeros(0, np.int64)
    if not len(w.doc):
        return Paragraphs(w, none, none, none, none)
    line = _lines(w)
    # a blank line: two line breaks with nothing but white space between them
    ink = np.concatenate([[0], np.cumsum((w.buf != 32) & (w.buf != 9) & (w.buf != 13) & (w.buf != 10))])
    breaks = np.flatnonzero(w.buf == 10)
    blank = np.cumsum(np.bincount(breaks[1:][ink[breaks[1:]] == ink[breaks[:-1]]], minlength=len(w.buf)))
    blank = blank[w.start]
    cut = np.flatnonzero(np.concatenate([[True], (blank[1:] != blank[:-1]) | (w.doc[1:] != w.doc[:-1])]))
    stop = np.append(cut[1:], len(w.doc))
    wanted = (line[stop - 1] != line[cut]) | (stop - cut > WINDOW)
    cut, stop = cut[wanted], stop[wanted]
    first, last = [], []
    for size in RUNS:
        step = size // 3
        pieces = np.maximum(1, -(-(stop - cut - (size - step)) // step))
        begin = np.repeat(cut, pieces) + step * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        first.append(begin)
        last.append(np.minimum(begin + size, np.repeat(stop, pieces)))
    b, e = np.concatenate(first), np.concatenate(last)
    order = np.lexsort((e, b))
    b, e = b[order], e[order]
    return Paragraphs(w, b, e, w.doc[b].astype(np.int64), line)


def _slots(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each word and of the pair that begins with it."""
    one = (mix(w.hash + U64(3)) >> U64(20)).astype(np.int64) & (FEATURES - 1)
    two = (mix(w.hash * U64(0x9E3779B97F4A7C15) + np.append(w.hash[1:], U64(0))[: len(w.hash)]) >> U64(20)).astype(np.int64) & (FEATURES - 1)
    return one, two


def scores(p: Paragraphs, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Class scores of each paragraph: sums of the weights of its features over the root of their number."""
    if not len(p.begin):
        return np.zeros((0, len(bias)), np.float32)
    one, two = _slots(p.words)
    out = np.empty((len(p.begin), len(bias)), np.float32)
    step = 4096  # paragraphs at once
    for a in range(0, len(p.begin), step):
        b, e = p.begin[a : a + step], p.end[a : a + step]
        lo, hi = int(b[0]), int(e.max())
        pairs = weights[two[lo:hi]]
        both = np.zeros((hi - lo + 1, len(bias)), np.float64)
        np.cumsum(weights[one[lo:hi]] + pairs, 0, dtype=np.float64, out=both[1:])
        total = both[e - lo] - both[b - lo] - pairs[e - 1 - lo]  # the last word's pair leads out
        out[a : a + step] = total / np.sqrt(2 * (e - b) - 1)[:, None] + bias
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _matrix(p: Paragraphs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paragraph, feature, value) of the sparse training matrix."""
    one, two = _slots(p.words)
    rows, cols = [], []
    for i, (b, e) in enumerate(zip(p.begin, p.end)):
        f = np.concatenate([one[b:e], two[b : max(e - 1, b)]])
        rows.append(np.full(len(f), i))
        cols.append(f)
    r, c = np.concatenate(rows), np.concatenate(cols)
    return r, c, 1 / np.sqrt(np.bincount(r, minlength=len(p.begin)))[r]


def fit_softmax(p: Paragraphs, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by Adam over the whole sample."""
    r, c, v = _matrix(p)
    used, c = np.unique(c, return_inverse=True)
    n, k = len(y), len(FAMILIES)
    w, b = np.zeros((len(used), k)), np.zeros(k)
    hot = np.eye(k)[y]
    m, s = np.zeros((len(used) + 1, k)), np.zeros((len(used) + 1, k))
    order = np.argsort(c, kind="stable")
    by_col, starts = c[order], None
    starts = np.flatnonzero(np.concatenate([[True], by_col[1:] != by_col[:-1]]))
    row_starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    for t in range(1, rounds + 1):
        z = np.add.reduceat(w[c] * v[:, None], row_starts, axis=0) + b
        d = (softmax(z) - hot) * weight[:, None] / weight.sum()
        g = np.add.reduceat((d[r] * v[:, None])[order], starts, axis=0) + l2 * w / n
        g = np.vstack([g, d.sum(0)[None]])
        m = 0.9 * m + 0.1 * g
        s = 0.99 * s + 0.01 * g * g
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    full = np.zeros((FEATURES, k), np.float32)
    full[used] = w
    return full, b.astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    rarity: dict[str, float]  # weight of each word of the notices

    def likeness(self, template: list[str], words: list[str]) -> float:
        """Share of the template's weight that occurs in ``words`` in order (heaviest common subsequence)."""
        weight = [self.rarity[t] for t in template]
        row = [0.0] * (len(template) + 1)
        for x in words:
            last = 0.0
            for j, t in enumerate(template, 1):
                last, row[j] = row[j], max(row[j], row[j - 1], last + weight[j - 1] if t == x else 0.0)
        return row[-1] / sum(weight)


def _variants(notice: str, filler: list[str], rng: np.random.Generator) -> list[str]:
    words, out = notice.split(), [notice, notice.upper(), notice.lower()]
    for _ in range(COPIES):
        kept = [x for x in words if rng.random() > 0.06] or words
        lead = [filler[j] for j in rng.integers(0, len(filler), rng.integers(0, 13))] if rng.random() < 0.4 else []
        tail = [filler[j] for j in rng.integers(0, len(filler), rng.integers(0, 15))] if rng.random() < 0.4 else []
        out.append(" ".join([*lead, *kept, *tail]))
    return out


def train(negatives: pa.Array, seed: int = 3, rarity: dict[str, float] | None = None, corpus: Callable[[Model], tuple[np.ndarray, np.ndarray]] | None = None) -> Model:
    """The classifier; ``negatives`` are corpus texts, of which lines that match a notice are left out.

    ``rarity`` and ``corpus``, ``calibration`` of a model, are of all lines; without them the sample stands for the corpus.
    """
    rng = np.random.default_rng(seed)
    lines = [s for t in negatives.to_pylist() if t for s in t.split("\n") if s.strip()]
    sets = [set(_plain(s)) for s in lines]
    number = Counter(w for own in sets for w in own)
    rarity = rarity or weights_of_words(len(lines), number)
    heavy = [(set(t), sum(rarity[w] for w in set(t))) for notices in _templates().values() for t in notices]
    clean = [all(sum(rarity[w] for w in t & own) < 0.7 * total for t, total in heavy) for own in sets]
    lines = [s for s, ok in zip(lines, clean) if ok]
    lines = [lines[i] for i in rng.permutation(len(lines))[:NEGATIVE_LINES]]
    filler = " ".join(lines).split()[:FILLER_WORDS] or ["the", "of", "a", "page", "section", "one"]
    texts, y = [], []
    for k, family in enumerate(NOTICES, 1):
        for notice in NOTICES[family]:
            for t in _variants(notice, filler, rng):
                texts.append(t), y.append(k)
    for t in OTHER:
        for v in _variants(t, filler, rng):
            texts.append(v), y.append(0)
    # notices without their two heaviest words are unknown
    for notices in _templates().values():
        for t in notices:
            gone = sorted(set(t), key=lambda w: -rarity[w])[:2]
            if rest := [w for w in t if w not in gone]:
                texts.append(" ".join(rest)), y.append(0)
    first_line = len(texts)
    for s in lines:
        texts.append(" ".join(s.split()[:WINDOW])), y.append(0)
    p = paragraphs(pa.array(texts))
    y = np.array(y)[p.row]
    held = rng.random(len(y)) < 1 / 3
    share = np.bincount(y, minlength=len(FAMILIES))
    weight = np.sqrt(1 / np.maximum(share, 1))[y]
    own = np.flatnonzero(~held)
    weights, bias = fit_softmax(Paragraphs(p.words, p.begin[own], p.end[own], p.row[own], p.line[own]), y[own], weight[own])
    z, yh = scores(p, weights, bias)[held], y[held]
    if corpus is not None:
        loss_all, number_all = corpus(Model(weights, bias, 1.0, 0.5, rarity))
        if number_all[0].sum():
            line = (p.row >= first_line)[held]
            return _calibrated(weights, bias, rarity, z[~line], yh[~line], max(int(line.sum()), 1), loss_all, number_all)
    loss = [-np.log(softmax(z / t)[np.arange(len(yh)), yh] + 1e-12).mean() for t in TEMPERATURES]
    temperature = float(TEMPERATURES[int(np.argmin(loss))])
    prob = softmax(z / temperature)
    best = prob[:, 1:].argmax(1) + 1
    conf, right = prob[np.arange(len(yh)), best], best == yh
    order = np.argsort(-conf, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    ok = np.flatnonzero(precision >= PRECISION)
    threshold = float(min(conf[order][ok[-1]], 0.5)) if len(ok) else 0.5
    return Model(weights, bias, temperature, threshold, rarity)


def _calibrated(weights: np.ndarray, bias: np.ndarray, rarity: dict[str, float], z: np.ndarray, y: np.ndarray, lines: int, loss_all: np.ndarray, number_all: np.ndarray) -> Model:
    """Temperature and threshold from held-out variants (``z``, ``y``) and all paragraphs of the corpus, which weigh as ``lines`` rows."""
    share = lines / number_all[0].sum()
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).sum() + share * loss_all[k] for k, t in enumerate(TEMPERATURES)]
    k = int(np.argmin(loss))
    prob = softmax(z / TEMPERATURES[k])
    best = prob[:, 1:].argmax(1) + 1
    at = _bin(prob[np.arange(len(y)), best])
    right, every = np.bincount(at[best == y], minlength=BINS), np.bincount(at, minlength=BINS) + share * number_all[k]
    precision = np.cumsum(right[::-1]) / np.maximum(np.cumsum(every[::-1]), 1e-9)
    ok = np.flatnonzero(precision >= PRECISION)
    threshold = min((BINS - 1 - int(ok[-1])) / BINS, 0.5) if len(ok) else 0.5
    return Model(weights, bias, float(TEMPERATURES[k]), threshold, rarity)


def _bin(conf: np.ndarray) -> np.ndarray:
    return np.minimum((conf * BINS).astype(np.int64), BINS - 1)


@lru_cache(maxsize=1)
def _templates() -> dict[str, list[list[str]]]:
    return {f: [_plain(n) for n in notices] for f, notices in NOTICES.items()}


def _plain(text: str) -> list[str]:
    w = Words(pa.array([text]))
    raw = bytes(w.buf)
    return [raw[s:e].decode() for s, e in zip(w.start, w.end)]


def confirm(model: Model, families: list[str], words: list[str]) -> tuple[str, float, list[str]]:
    """The family whose notice is most like the words, how alike they are, and the notice's words."""
    best = (0.0, 0.0, "", [])
    have = set(words)
    for family in families:
        for t in _templates()[family]:
            total = sum(model.rarity[w] for w in t)
            if sum(model.rarity[w] for w in t if w in have) < CONFIRM * total:
                continue
            like = round(model.likeness(t, words), 6)
            if (like, total) > best[:2]:
                best = (like, total, family, t)
    return best[2], best[0], best[3]


def tight(template: list[str], words: list[str]) -> tuple[int, int]:
    """The words from ``begin`` to ``end`` that have as much of the template in order as all of them."""

    def reach(template: list[str], words: list[str]) -> int:
        row, best, at = [0] * (len(template) + 1), 0, 0
        for n, x in enumerate(words, 1):
            last = 0
            for j, t in enumerate(template, 1):
                last, row[j] = row[j], max(row[j], row[j - 1], last + (t == x))
            if row[-1] > best:
                best, at = row[-1], n
        return at

    end = reach(template, words)
    return end - reach(template[::-1], words[:end][::-1]), end


def _likely(model: Model, p: Paragraphs) -> list[tuple[int, list[str], np.ndarray]]:
    """(number, rival families, probabilities) of the paragraphs that are not unknown."""
    z = scores(p, model.weights, model.bias)
    if not len(z):
        return []
    prob = softmax(z / model.temperature)
    top = prob[:, 1:].max(1)
    return [(int(i), [FAMILIES[k] for k in np.flatnonzero(prob[i] >= RIVAL * top[i]) if k], prob[i]) for i in np.flatnonzero(top >= model.threshold)]


def detect(model: Model, text: pa.Array) -> list[tuple[int, int, str, float, float]]:
    """(row, line, family, probability, similarity) of confirmed licence paragraphs; of overlapping notices the heaviest counts."""
    p = paragraphs(text)
    raw, cands = bytes(p.words.buf), []
    q = block_windows(p.words)
    line = _lines(p.words)
    for part in (p, q):
        for i, rivals, prob in _likely(model, part):
            begin, end = int(part.begin[i]), int(part.end[i])
            words = [raw[s:e].decode() for s, e in zip(p.words.start[begin:end], p.words.end[begin:end])]
            family, like, template = confirm(model, rivals, words)
            if like >= CONFIRM:
                s, e = tight(template, words)
                if (like := model.likeness(template, words[s:e])) >= CONFIRM:
                    heavy = round(like * sum(model.rarity[w] for w in template), 6)
                    cands.append((-heavy, e - s, begin + s, begin + e, -float(prob[FAMILIES.index(family)]), int(part.row[i]), family, like))
    held: dict[int, list[tuple[int, int]]] = {}
    found: dict[tuple[int, int, str], tuple[float, float]] = {}
    for _, _, begin, end, top, row, family, like in sorted(cands):
        spans = held.setdefault(row, [])
        if all(end <= b or e <= begin for b, e in spans):
            spans.append((begin, end))
            key = (row, int(line[begin]), family)
            found[key] = max(found.get(key, (0.0, 0.0)), (like, -top))
    return [(r, n, f, round(prob_, 4), round(like, 4)) for (r, n, f), (like, prob_) in sorted(found.items())]


def fit(docs: DataFrame, limit: int = NEGATIVE_DOCS, chars: int = NEGATIVE_CHARS, then: Callable[[pa.Array], Model] | None = None) -> Model:
    """The model, with negatives of at most ``limit`` documents of at most ``chars`` characters.

    The sample is chosen by hashes under a threshold that follows the number of documents, so no task gets more than the sample.
    """
    then = then or train
    rows = docs.select(F.col("text").cast("string").alias("text")).where(F.length("text").between(1, chars)).select("text", F.xxhash64("text").alias("h"))
    n = rows.count()
    least: list[int] = []
    for factor in (2, 64, 0):  # the second and third for corpora of few distinct texts
        bound = (1 << 63) - 1 if not factor or n <= limit * factor else -(1 << 63) + (1 << 64) * limit * factor // n
        least = sorted(r[0] for r in rows.where(F.col("h") <= bound).select("h").distinct().orderBy("h").limit(limit).toLocalIterator())
        if len(least) == limit or bound == (1 << 63) - 1:
            break
    if not least:
        return then(pa.array([], pa.string()))
    found = rows.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("text").alias("text")).toArrow().sort_by("h")
    return then(found.column("text").combine_chunks())


def weights_of_words(lines: int, number: dict[str, int]) -> dict[str, float]:
    """How rare each word of the notices is, which ``number`` of so many ``lines`` have."""
    return {w: float(np.log((lines + 20) / (number.get(w, 0) + 1))) for notices in _templates().values() for t in notices for w in t}


@lru_cache(maxsize=1)
def _vocabulary() -> tuple[list[str], np.ndarray]:
    """The words of the notices by hash, and their hashes."""
    words = sorted({w for notices in _templates().values() for t in notices for w in t})
    hashes = np.array([int(Words(pa.array([w])).hash[0]) for w in words], U64)
    order = np.argsort(hashes)
    return [words[i] for i in order], hashes[order]


def _numbers(w: Words) -> np.ndarray:
    """The number of each word in the notices' vocabulary, -1 for others."""
    hashes = _vocabulary()[1]
    at = np.minimum(np.searchsorted(hashes, w.hash), len(hashes) - 1)
    return np.where(hashes[at] == w.hash, at, -1)


def line_counts(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of lines with a word, and of those that have each word of the notices; over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(_vocabulary()[0])
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                w = Words(part.column(0).fill_null(""))
                if not len(w.doc):
                    continue
                line = _lines(w)
                row = np.cumsum(np.concatenate([[0], (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])]))
                number = _numbers(w)
                own = np.unique((row * size + number)[number >= 0])
                total[:size] += np.bincount(own % size, minlength=size)
                total[size] += row[-1] + 1
        yield pa.record_batch([pa.array(np.arange(size + 1), pa.int32()), pa.array(total)], names=["word", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    words, n = _vocabulary()[0], dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist()))
    return n.get(len(words), 0), {w: n.get(k, 0) for k, w in enumerate(words)}


def _matching(p: Paragraphs, rarity: dict[str, float]) -> np.ndarray:
    """Whether each paragraph has 0.7 of the weight of a notice's words."""
    words = _vocabulary()[0]
    weight = np.array([rarity[w] for w in words])
    notices = [set(t) for ts in _templates().values() for t in ts]
    share = np.array([[weight[k] * (w in own) for own in notices] for k, w in enumerate(words)])
    share = (share / share.sum(0)).astype(np.float32)
    number, out = _numbers(p.words), np.empty(len(p.begin), bool)
    for a in range(0, len(p.begin), 4096):
        b, e = p.begin[a : a + 4096], p.end[a : a + 4096]
        col, row = number[ranges(b, e - b)], np.repeat(np.arange(len(b)), e - b)
        has = np.zeros((len(b), len(words)), np.float32)
        has[row[col >= 0], col[col >= 0]] = 1
        out[a : a + 4096] = (has @ share >= 0.7).any(1)
    return out


def calibration(docs: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of all paragraphs that match no notice, at each of ``TEMPERATURES``: the loss, and how many have a licence's probability in each of ``BINS``."""
    rarity, weights, bias = model.rarity, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, number = np.zeros((len(TEMPERATURES), BINS)), np.zeros((len(TEMPERATURES), BINS), np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                p = paragraphs(part.column(0).fill_null(""))
                z = scores(p, weights, bias)[~_matching(p, rarity)]
                if not len(z):
                    continue
                apart = (z[:, 1:] - z[:, :1]).astype(np.float32)
                top = apart.max(1)
                for k, t in enumerate(TEMPERATURES):
                    high = np.maximum(top, 0) / t
                    norm = np.exp(-high) + np.exp(apart / np.float32(t) - high[:, None]).sum(1)
                    at = _bin(np.exp(top / t - high) / norm)
                    number[k] += np.bincount(at, minlength=BINS)
                    loss[k] += np.bincount(at, weights=np.log(norm) + high, minlength=BINS)
        k, at = np.nonzero(number)
        yield pa.record_batch([pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(number[k, at]), pa.array(loss[k, at])], names=["t", "bin", "n", "loss"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "t int, bin int, n bigint, loss double")
    found = rows.groupBy("t", "bin").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).toArrow()
    number, loss = np.zeros((len(TEMPERATURES), BINS), np.int64), np.zeros(len(TEMPERATURES))
    t = found.column("t").to_numpy()
    number[t, found.column("bin").to_numpy()] = found.column("n").to_numpy()
    np.add.at(loss, t, found.column("loss").to_numpy())
    return loss, number


def fit_all(docs: DataFrame) -> Model:
    """The model with counts, temperature and threshold of all of ``docs``; its weights are fitted on the sample of ``fit``."""
    rarity = weights_of_words(*line_counts(docs))
    return fit(docs, then=lambda texts: train(texts, rarity=rarity, corpus=lambda model: calibration(docs, model)))


def licenses(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every licence paragraph of every document; ``paragraph`` is its line, from 0."""
    model = model or fit_all(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = detect(model, batch.column(1).fill_null(""))
        if not found:
            return None
        row, line, family, prob, like = zip(*found)
        return pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(line, pa.int32()), pa.array(family), pa.array(prob), pa.array(like)], names=["doc_id", "paragraph", "family", "probability", "similarity"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_text(rows, ["doc_id", "text"], "text", run, SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
