"""License scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line with at least one word, or a notice that is wrapped over
neighbouring lines or embedded in a longer text.  Its features are words and
pairs of neighbouring words; a sparse logistic regression names the licence
family, and its scores are calibrated on held-out paragraphs so that
``unknown`` is a class with a meaningful probability.  A named family is
confirmed where the paragraph shares enough word pairs with one of the
family's templates.

Windows of one and a half times a template's length slide over every block of
non-blank lines.  One that shares enough of the template's pairs is classified
with a few words around it, so neither line ends nor the length of a line hide
a notice.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import distinct_sample, text_slices

UNKNOWN = "unknown"
LEAST_PROBABILITY = 0.5   # a family below this is unknown
CONFIRM = 0.5             # share of common word pairs that confirms a family
SAMPLE_DOCS = 2_000       # bound: different texts whose paragraphs teach the unknown class
SAMPLE_PARAGRAPHS = 4_000  # bound: different paragraphs taken from all of these texts
SAMPLE_CHARS = 2_000       # bound: characters of a paragraph, from a place chosen by its hash
VARIANTS = 60             # altered copies of each template
COMMON = 0.01             # a feature in a larger share of unknown paragraphs says nothing
SEED = 17

# Notices by which the licence families are commonly declared.
TEMPLATES = {
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
             "General Public License as published by the Free Software Foundation.",
             "Licensed under the GNU Affero General Public License, version 3.", "License: AGPL-3.0-or-later"],
    "Apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License.", "License: Apache-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met:",
            "Released under the BSD 3-Clause License.", "License: BSD-2-Clause"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "Licensed under CC BY 4.0."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Licensed under CC BY-SA 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.",
            "Released into the public domain under CC0 1.0."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation.", "License: GPL-3.0-only"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted.", "Released under the ISC License."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License.", "Licensed under the GNU Lesser General Public License, version 3.",
             "License: LGPL-2.1-or-later"],
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction.", "License: MIT"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License, version 2.0.", "License: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright by the authors. All rights reserved.",
                    "No part of this publication may be reproduced without prior written permission."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "License: Unlicense"],
}
# Ordinary sentences with the words of licences, for the unknown class.
ORDINARY = [
    "The driver showed a valid license to the officer.", "The new version of the program was released in spring.",
    "All members reserved seats under their own names.", "The general public was free to use the library.",
    "They apply the terms of the contract with or without a fee.", "Human rights are part of the work of the foundation.",
    "A creative idea is common in the public domain of art.", "The copy of the file is subject to review.",
    "Permission to enter the building was granted.", "The Apache people lived in the south west.",
    "He studied at MIT and released a book.", "The source of the river is under the mountain.",
    "Er kommt mit dem Zug.", "Der Weg nach oben, mit.", "La licencia del conductor es general.",
]

# Bytes that are no part of a word become spaces; A-Z become a-z; line ends stay.
_FOLD = bytearray(range(256))
for _b in range(128):
    if not (chr(_b).isalnum() or _b == 0x0A):
        _FOLD[_b] = 0x20
    elif 0x41 <= _b <= 0x5A:
        _FOLD[_b] = _b + 32
_FOLD = bytes(_FOLD)


def paragraphs(text: str | None) -> list[list[bytes]]:
    """Words of each line: runs of ASCII letters and digits (A-Z as a-z) and of
    other characters beyond ASCII.  Digits alone all count as one word, so a
    version number does not change a notice."""
    return [words_of(line) for line in text.encode("utf-8", "replace").translate(_FOLD).split(b"\n")] if text else []


def words_of(line: bytes) -> list[bytes]:
    return line.split()


def features(words: list[bytes]) -> list[bytes]:
    words = [b"0" if w.isdigit() else w for w in words]
    return words + [a + b" " + b for a, b in zip([b"^", *words], [*words, b"$"])]


@dataclass
class LicenseModel:
    families: list[str]              # without unknown; unknown is the last class
    vocabulary: dict[bytes, int]     # feature -> row of weights
    weights: np.ndarray              # (features + 1, classes), the last row the bias
    temperature: float
    templates: dict[str, list[frozenset]]

    def __post_init__(self):
        self.anchors = frozenset(w for f in self.vocabulary for w in f.split(b" "))
        self.every = [t for own in self.templates.values() for t in own]
        self.holders: dict[tuple, list[int]] = {}  # word pair -> templates that have it
        for k, t in enumerate(self.every):
            for pair in t:
                self.holders.setdefault(pair, []).append(k)
        self.window = 2 * max(map(len, self.every))

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        return _softmax(self._scores(words)[None] / self.temperature)[0]

    def _scores(self, words: list[bytes]) -> np.ndarray:
        mine = set(features(words))
        own = sorted(self.vocabulary[f] for f in mine if f in self.vocabulary)
        return self.weights[-1] + self.weights[own].sum(axis=0) / _length(mine)

    def classify(self, words: list[bytes]) -> tuple[str, float, float]:
        """(family, probability, similarity to the family's closest template)."""
        if self.anchors.isdisjoint(words):  # no feature at all: what the bias says, which is unknown
            return UNKNOWN, 1.0, 0.0
        p = self.probabilities(words)
        best = int(p.argmax())
        if best == len(self.families) or p[best] < LEAST_PROBABILITY:
            return UNKNOWN, float(p[-1]), 0.0
        family = self.families[best]
        return family, float(p[best]), max(similarity(words, t) for t in self.templates[family])

    def close(self, words: list[bytes]) -> dict[int, list[tuple[int, tuple]]]:
        """Templates of which the words have CONFIRM of the pairs or more, with
        the places of those pairs.  No other template can confirm any part."""
        words = [b"0" if w.isdigit() else w for w in words]
        hits = [(i, pair) for i, pair in enumerate(zip(words, words[1:])) if pair in self.holders]
        if not hits:
            return {}
        tally: dict[int, int] = {}
        for pair in {pair for _, pair in hits}:
            for k in self.holders[pair]:
                tally[k] = tally.get(k, 0) + 1
        return {k: [h for h in hits if h[1] in self.every[k]] for k, n in tally.items()
                if n >= CONFIRM * len(self.every[k])}

    def notices(self, words: list[bytes]) -> list[tuple[int, int, str, float, float]]:
        """(first word, end, family, probability, similarity) of all confirmed
        notices in a text, whatever stands around them.  A span is judged by
        its own words; of those that overlap the one with most of the word pairs of
        its family's templates stays, of several the closest, the shortest."""
        spans = {s for k, hits in self.close(words).items() for s in _windows(hits, len(self.every[k]))}
        found = []
        for a, b in spans:
            family, p, share = self.classify(words[a:b])
            if family != UNKNOWN and share >= CONFIRM:
                own = pairs_of(words[a:b])
                most = max(len(own & t) for t in self.templates[family])
                found.append((a, b, family, p, share, most))
        return [f[:5] for f in _apart(found, lambda f: (-f[5], -f[4], f[1] - f[0], -f[3], f[0]))]


def _windows(hits: list[tuple[int, tuple]], size: int) -> list[tuple[int, int]]:
    """(first word, end) of the windows of 1.5 template lengths that have CONFIRM
    of a template's pairs or more, the fullest of those that overlap."""
    reach = size + (size + 1) // 2
    out, tally, end = [], {}, 0
    for k, (start, pair) in enumerate(hits):
        while end < len(hits) and hits[end][0] < start + reach:
            tally[hits[end][1]] = tally.get(hits[end][1], 0) + 1
            end += 1
        if len(tally) >= CONFIRM * size:
            out.append((start, hits[end - 1][0] + 2, len(tally)))
        tally[pair] -= 1
        if not tally[pair]:
            del tally[pair]
    return [(a, b) for a, b, _ in _apart(out, lambda w: (-w[2], w[1] - w[0], w[0]))]


def _apart(spans: list[tuple], order) -> list[tuple]:
    """Spans that overlap none of a better one, by place."""
    kept: list[tuple] = []
    for s in sorted(spans, key=order):
        at = bisect_left(kept, s[0], key=lambda t: t[0])
        if (at == 0 or kept[at - 1][1] <= s[0]) and (at == len(kept) or kept[at][0] >= s[1]):
            kept.insert(at, s)
    return kept


def declared(text: str | None, model: LicenseModel, unconfirmed: bool = False) -> list[tuple]:
    """(first line, last line, family, probability, similarity) of everything
    that declares a licence in a text, at most one per first line and family.

    Every line is judged as a whole, then every block of non-blank lines for
    notices that are wrapped or embedded.  A notice in a line that was
    recognised as a whole and is no longer than a window adds nothing; one over
    several lines takes the place of its lines' rows of the same family and of
    weaker ones.
    """
    lines = paragraphs(text)
    found: dict[tuple[int, str], tuple] = {}
    block: list[bytes] = []
    owner: list[int] = []

    def finish():
        whole = {n: r for (n, _), r in found.items() if owner[0] <= n and r[4] >= CONFIRM}
        for a, b, family, p, share in model.notices(block):
            first, last = owner[a], owner[b - 1]
            if first == last:
                if first not in whole or len(lines[first]) > model.window:
                    _better(found, (first, first, family, p, share))
                continue
            inside = [r for n, r in whole.items() if first <= n <= last]
            if all(r[2] == family or r[4] < share for r in inside):
                for r in inside:
                    found.pop((r[0], r[2]), None)
                _better(found, (first, last, family, p, share))

    for n, words in enumerate([*lines, []]):
        if words:
            block += words
            owner += [n] * len(words)
            if unconfirmed or model.close(words):
                pieces = [words]
                if unconfirmed and len(words) > model.window:
                    pieces += [words[k:k + model.window] for k in range(0, len(words), model.window // 2)]
                for piece in pieces:
                    family, p, share = model.classify(piece)
                    if family != UNKNOWN and (unconfirmed or share >= CONFIRM):
                        _better(found, (n, n, family, p, share))
        elif block:
            finish()
            block, owner = [], []
    return sorted(found.values())


def _better(found: dict[tuple[int, str], tuple], row: tuple) -> None:
    old = found.get((row[0], row[2]))
    if old is None or old[4] < row[4]:
        found[row[0], row[2]] = row


def _length(mine: set) -> float:
    """A feature's value is 1 / sqrt(different features of the paragraph, known
    or not), so one licence word in a long paragraph weighs little."""
    return float(np.sqrt(len(mine)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def pairs_of(words: list[bytes]) -> frozenset:
    words = [b"0" if w.isdigit() else w for w in words]
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset((w, b"") for w in words)


def similarity(words: list[bytes], template: frozenset) -> float:
    """Share of a template's word pairs that the paragraph has."""
    return len(pairs_of(words) & template) / len(template)


def _variants(words: list[bytes], rng: np.random.Generator, context: list[list[bytes]]) -> list[list[bytes]]:
    """Altered copies of a notice: words left out, ordinary words around it."""
    out = [words]
    for _ in range(VARIANTS):
        kept = [w for w in words if rng.random() > 0.1] or words
        if context and rng.random() < 0.5:
            around = context[int(rng.integers(len(context)))][:6]
            kept = around + kept if rng.random() < 0.5 else kept + around
        out.append(kept)
    return out


def fit(ordinary: list[list[bytes]], steps: int = 300, rate: float = 0.3, decay: float = 1e-4) -> LicenseModel:
    """Softmax regression with an L1 pull to zero, on altered templates and on
    ordinary paragraphs; the temperature is the one of least log-loss on every
    fifth paragraph, which is not trained on."""
    rng = np.random.default_rng(SEED)
    families = sorted(TEMPLATES)
    templates = {f: [words_of(t.encode().translate(_FOLD)) for t in TEMPLATES[f]] for f in families}
    pairs = {f: [pairs_of(t) for t in templates[f]] for f in families}
    everything = [p for own in pairs.values() for p in own]
    unknown = [w for w in ordinary if w and max(similarity(w, t) for t in everything) < CONFIRM]
    unknown += [words_of(t.encode().translate(_FOLD)) for t in ORDINARY for _ in range(5)]
    rows = [(v, k) for k, f in enumerate(families) for t in templates[f] for v in _variants(t, rng, unknown)]
    known = {f for words, _ in rows for f in features(words)} & \
            {f for own in templates.values() for t in own for f in features(t)}
    tally: dict[bytes, int] = {}
    for words in unknown:
        for f in set(features(words)) & known:
            tally[f] = tally.get(f, 0) + 1
    useful = sorted(f for f in known if tally.get(f, 0) <= max(10, COMMON * len(unknown)))
    vocabulary = {f: i for i, f in enumerate(useful)}
    rows += [(w, len(families)) for w in unknown]

    x = np.zeros((len(rows), len(useful) + 1), dtype=np.float32)
    x[:, -1] = 1
    for i, (words, _) in enumerate(rows):
        mine = set(features(words))
        own = [vocabulary[f] for f in mine if f in vocabulary]
        if own:
            x[i, own] = 1 / _length(mine)
    y = np.array([k for _, k in rows])
    held = np.arange(len(rows)) % 5 == 0
    classes = len(families) + 1
    target = np.eye(classes, dtype=np.float32)[y]
    # Each class weighs the same, whatever its number of paragraphs.
    weight = (1 / np.bincount(y[~held], minlength=classes).clip(1))[y][~held, None].astype(np.float32) / classes
    w = np.zeros((x.shape[1], classes), dtype=np.float32)
    moment, scale = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        gradient = x[~held].T @ ((_softmax(x[~held] @ w) - target[~held]) * weight)
        moment = 0.9 * moment + 0.1 * gradient
        scale = 0.99 * scale + 0.01 * gradient ** 2
        w -= rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(scale / (1 - 0.99 ** step)) + 1e-8)
        w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - rate * decay)
    z = x[held] @ w
    losses = {t: -np.log(_softmax(z / t)[np.arange(held.sum()), y[held]] + 1e-12).mean()
              for t in (0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0)}
    return LicenseModel(families, vocabulary, w.astype(float), min(losses, key=losses.get), pairs)


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> LicenseModel:
    """Learn from the templates and, for the unknown class, from paragraphs of
    a bounded sample of different texts; both are drawn by their hashes, from
    whole texts.  Paragraphs that resemble a template are not taken as unknown."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    lines = distinct_sample(texts, "text", sample_docs).select(F.explode(F.split("text", "\n")).alias("line")) \
        .where(F.col("line").rlike("[A-Za-z0-9]|[^\\x00-\\x7F]"))  # others have no word
    drawn = distinct_sample(lines, "line", SAMPLE_PARAGRAPHS)
    spare = F.greatest(F.lit(0), F.char_length("line") - SAMPLE_CHARS)
    part = F.substring("line", F.pmod(F.col("_hash"), spare + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))
    rows = drawn.select("_hash", part.alias("line")).collect()
    return fit([words_of(r["line"].encode("utf-8", "replace").translate(_FOLD)) for r in sorted(rows)])


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text",
         unconfirmed: bool = False) -> DataFrame:
    """One row per paragraph that declares a licence: ``doc_id, paragraph``
    (number of its first line, from 0), ``family, probability, similarity,
    confirmed`` and the paragraph's ``text``, all its lines.  A line that
    declares several families gives a row for each.

    Every line of every whole text is judged, and every block of non-blank
    lines for notices over several lines or within a long one (see
    ``declared``).  Paragraphs that are unknown give no row, nor (without ``unconfirmed``) do those whose family no
    template confirms, so null, empty and blank texts give none.  Null ids and repeated rows
    are scanned like any other; other columns are not read.  An empty table
    gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("paragraph", T.IntegerType()),
                           T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()),
                           T.StructField("similarity", T.DoubleType()), T.StructField("confirmed", T.BooleanType()),
                           T.StructField("text", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the templates

    def run(batches):
        m = shared.value
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                at, rows = [], []
                for i, text in enumerate(texts):
                    found = declared(text, m, unconfirmed)
                    if found:
                        lines = text.split("\n")
                        at += [i] * len(found)
                        rows += [(n, f, p, s, s >= CONFIRM, "\n".join(lines[n:last + 1]))
                                 for n, last, f, p, s in found]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(
                    (pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int32())), *columns],
                                                 names=schema.names)

    return src.mapInArrow(run, schema)
