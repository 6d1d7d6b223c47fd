"""Licence scans by a trained paragraph classifier that templates confirm.

A paragraph is a line, or some adjoining lines that only together hold a template, as wrapped
notices do. Its features are its words and word pairs, hashed to a fixed number of
columns; a multinomial logistic regression gives each licence family and ``unknown`` a
probability. It learns the families from notice templates, whole and worn (words dropped, halves,
text of the corpus around them), and ``unknown`` from a bounded sample of paragraphs that resemble
no template. Probabilities are calibrated by one temperature fitted on rows the weights have not
seen. A paragraph whose likeliest class is a family is then compared with that family's templates:
the share of a template's words and pairs it holds confirms the prediction or does not.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.sampling import texts_of
from ledgerlight.llm.common import arrow_map, picked, row_ranges, utf8
from ledgerlight.llm.words import spans, stir, word_hashes

#: Notices in public use, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the "
        "LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ],
    "Public-Domain": [
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
}
UNKNOWN = "unknown"
CLASSES = [*TEMPLATES, UNKNOWN]
COLUMNS = 1 << 16
#: ``unknown`` is learned from the paragraphs of at most so many distinct texts, in hash order.
SAMPLE = 1000
#: Of these, at most so many paragraphs and so many words of each are fitted.
SAMPLE_LINES = 3000
SAMPLE_WORDS = 40
#: Worn copies of each template.
WORN = 60
#: Share of a template's words and pairs that confirms it, and that bars a paragraph from ``unknown``.
CONFIRMED = 0.75
RESEMBLES = 0.4
#: Adjoining lines that may hold one wrapped template.
WINDOW = 12
FOUND = ("doc_id *, paragraph long, family string, probability double, template int, "
         "similarity double, confirmed boolean")
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[b for b in range(128) if not chr(b).isalnum() and b != 10]] = 32


def paragraph_features(data: np.ndarray, offsets: np.ndarray):
    """(row, paragraph number, first feature) of each paragraph with a word, and all features.

    Features are hashes of words and of pairs inside the paragraph. Lines end at a newline.
    """
    return _line_features(data, offsets)[:2]


def _line_features(data, offsets):
    """``paragraph_features``, and of each paragraph the pair of its first word with the word before."""
    plain = _PLAIN[data]
    starts, ends, at = spans(plain, offsets)
    if not len(starts):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = word_hashes(plain, starts, ends)
    breaks = np.concatenate([[0], np.cumsum(plain == 10)])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    line = breaks[starts] - breaks[offsets[:-1]][row]
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])])
    pairs = stir(hashes[:-1] * np.uint64(0xA0761D6478BD642F) + hashes[1:])
    features = np.empty(2 * len(hashes), np.uint64)  # a word, then its pair with the one before
    features[0::2] = hashes
    features[1::2] = np.concatenate([[np.uint64(0)], pairs])
    kept = np.ones(len(features), bool)
    kept[1::2] = ~fresh
    first = np.concatenate([[0], np.cumsum(kept)])[2 * np.flatnonzero(fresh)]
    return np.stack([row[fresh], line[fresh], first], 1), features[kept], features[1::2][fresh]


def _of(texts):
    """Features of each text taken as one paragraph."""
    raw = [t.replace("\n", " ").encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    where, features = paragraph_features(data, np.cumsum([0, *map(len, raw)]))
    out = [np.zeros(0, np.uint64)] * len(texts)
    for (row, _, a), b in zip(where, [*where[1:, 2], len(features)]):
        out[row] = features[a:b]
    return out


_TEMPLATE_SETS = {name: [np.unique(x) for x in _of(texts)] for name, texts in TEMPLATES.items()}


def similarity(features: np.ndarray, family: str) -> tuple[int, float]:
    """The family's template that most of stands in the paragraph, and how much of it."""
    shares = [np.isin(t, features).mean() for t in _TEMPLATE_SETS[family]]
    best = int(np.argmax(shares))
    return best, float(shares[best])


#: All features of templates, and of each template which of them it holds.
_KNOWN = np.unique(np.concatenate([t for ts in _TEMPLATE_SETS.values() for t in ts]))
_HOLDS = np.array([np.isin(_KNOWN, t) for ts in _TEMPLATE_SETS.values() for t in ts])


def wrapped(where, features, joints, confirmed):
    """Windows (first, last) of two to ``WINDOW`` adjoining lines that hold ``confirmed`` of a template,
    the best first, and the features of each.

    Lines adjoin where none without a word lies between. Windows are
    tried only where all lines in reach hold enough together.
    """
    n = len(where)
    ends = np.append(where[1:, 2], len(features))
    at = np.searchsorted(_KNOWN, features)
    hit = np.flatnonzero(_KNOWN[np.minimum(at, len(_KNOWN) - 1)] == features)
    line = np.searchsorted(where[:, 2], hit, "right") - 1
    joins = np.concatenate([[False], (where[1:, 0] == where[:-1, 0]) & (where[1:, 1] == where[:-1, 1] + 1)])
    at_joint = np.searchsorted(_KNOWN, joints)
    joint = np.flatnonzero(joins & (_KNOWN[np.minimum(at_joint, len(_KNOWN) - 1)] == joints))
    within = [set() for _ in range(n)]
    for i, k in zip(line.tolist(), at[hit].tolist()):
        within[i].add(k)
    before = {i: k for i, k in zip(joint.tolist(), at_joint[joint].tolist())}
    sizes = _HOLDS.sum(1)
    found = []
    for a in np.flatnonzero(np.append(joins[1:], False)).tolist():
        if not within[a]:
            continue
        last = a
        while last + 1 < n and last + 1 - a < WINDOW and joins[last + 1]:
            last += 1
        everything = set().union(*within[a:last + 1], (before[i] for i in range(a + 1, last + 1) if i in before))
        if len(everything) < confirmed * sizes.min():
            continue
        can = np.flatnonzero(_HOLDS[:, list(everything)].sum(1) >= confirmed * sizes)
        if not len(can):
            continue
        some = set(within[a])
        for b in range(a + 1, last + 1):
            some |= within[b]
            if b in before:
                some.add(before[b])
            share = (_HOLDS[np.ix_(can, list(some))].sum(1) / sizes[can]).max()
            if share >= confirmed:
                found.append((-share, b - a, a, b))
    for _, _, a, b in sorted(found):
        parts = [features[where[a, 2]:ends[b]], joints[a + 1:b + 1]]
        yield a, b, np.concatenate(parts)


def _columns(features):
    return (features >> np.uint64(48)).astype(np.int64)


def _worn(plain_words, rng):
    """Texts and classes: each template whole, and with words lost or the corpus around it."""
    texts, y = [], []
    for k, (name, templates) in enumerate(TEMPLATES.items()):
        for template in templates:
            words = template.split()
            texts.append(template)
            y.append(k)
            for i in range(WORN):
                some = [w for w in words if rng.random() > 0.15 * (i % 3)] or words
                if i % 5 == 4 and len(some) > 16:
                    some = some[:len(some) // 2]
                if i % 2 and len(plain_words):
                    around = [str(w) for w in rng.choice(plain_words, 6)]
                    some = around[:int(rng.integers(0, 4))] + some + around[4:]
                texts.append(" ".join(some))
                y.append(k)
    return texts, y


class Model:
    """Weights (columns by classes), a bias for each class and a temperature."""

    def __init__(self, features, y, rounds=120, rate=0.5, ridge=1e-4):
        y = np.array(y)
        held = np.arange(len(y)) % 5 == 4
        self.weights, self.bias = np.zeros((COLUMNS, len(CLASSES))), np.zeros(len(CLASSES))
        self.heat = 1.0
        rows = np.repeat(np.arange(len(y)), [len(f) for f in features])
        columns = _columns(np.concatenate(features))
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(y))))
        train = ~held
        used, index = np.unique(columns, return_inverse=True)
        w = np.zeros((len(used), len(CLASSES)))
        share = np.bincount(y[train], minlength=len(CLASSES))
        importance = train / np.maximum(share, 1)[y]  # each class counts alike
        importance = importance / importance.sum()
        momentum, momentum_bias = np.zeros_like(w), np.zeros_like(self.bias)
        target = np.eye(len(CLASSES))[y]
        for _ in range(rounds):
            z = self._sums(w, rows, index, len(y)) * scale[:, None] + self.bias
            off = (_softmax(z) - target) * importance[:, None]
            slope = np.zeros_like(w)
            scaled = off * scale[:, None]
            for k in range(len(CLASSES)):
                slope[:, k] = np.bincount(index, scaled[rows, k], len(used))
            momentum = 0.9 * momentum + slope + ridge * w
            momentum_bias = 0.9 * momentum_bias + off.sum(0)
            w -= rate * 10 * momentum
            self.bias -= rate * momentum_bias
        self.weights[used] = w
        z = (self._sums(w, rows, index, len(y)) * scale[:, None] + self.bias)[held]
        self.heat = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=lambda t: -np.log(
            _softmax(z / t)[np.arange(held.sum()), y[held]] + 1e-12).mean())

    @staticmethod
    def _sums(w, rows, index, n):
        return np.stack([np.bincount(rows, w[index, k], n) for k in range(w.shape[1])], 1)

    def probabilities(self, features, first):
        """Of each paragraph; ``first`` are the indexes of their first features."""
        columns = _columns(features)
        lengths = np.diff(np.append(first, len(features)))
        z = np.stack([np.add.reduceat(self.weights[:, k][columns], first)
                      for k in range(len(CLASSES))], 1)
        return _softmax((z / np.sqrt(lengths)[:, None] + self.bias) / self.heat)


def _softmax(z):
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Fits the classifier; ``unknown`` comes from a bounded sample of distinct texts, chosen by
    their hashes before any text is moved."""
    texts = docs.select(F.col(text).cast("string").alias("text")).where("length(text) > 0")
    texts = texts.withColumn("h", F.xxhash64("text"))
    chosen = texts.select("h").distinct().orderBy("h").limit(sample)
    rows = texts_of(texts, chosen, ["h"], "text").collect()
    lines = sorted({line for r in rows for line in r.text.split("\n")})
    lines = [x for x in lines if x.strip()]
    likeness = [max(similarity(f, name)[1] for name in TEMPLATES) for f in _of(lines)]
    rng = np.random.default_rng(7)
    lines = [" ".join(x.split()[:SAMPLE_WORDS]) for x, s in zip(lines, likeness) if s < RESEMBLES]
    lines = [lines[i] for i in rng.permutation(len(lines))[:SAMPLE_LINES]]
    plain_words = np.array(sorted({w for x in lines[:2000] for w in x.split()[:20]}), dtype=object)
    worn, y = _worn(plain_words, rng)
    # lines of a few words, too, as a notice is short
    short = [" ".join(x.split()[:int(rng.integers(2, 14))]) for x in lines]
    texts = worn + lines + short
    y = y + [len(CLASSES) - 1] * (len(lines) + len(short))
    order = rng.permutation(len(texts))
    texts, y = [texts[i] for i in order], [y[i] for i in order]
    pairs = [(f, k) for f, k in zip(_of(texts), y) if len(f)]
    return Model([f for f, _ in pairs], [k for _, k in pairs])


def _scan(held, confirmed):
    def run(batches):
        model = held.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = [[], [], [], [], [], []]
            rows = []
            for i, j in row_ranges(offsets, 1 << 20):
                where, features, joints = _line_features(
                    data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                if not len(where):
                    continue
                p = model.probabilities(features, where[:, 2])
                ends = np.append(where[1:, 2], len(features))
                best = p.argmax(1)
                single = {}
                for k in np.flatnonzero(best != len(CLASSES) - 1).tolist():
                    name = CLASSES[best[k]]
                    single[k] = name, float(p[k, best[k]]), *similarity(features[where[k, 2]:ends[k]], name)
                taken = {k for k, x in single.items() if x[3] >= confirmed}
                for a, b, some in wrapped(where, features, joints, confirmed):
                    if not taken.isdisjoint(range(a, b + 1)):
                        continue
                    q = model.probabilities(some, np.zeros(1, np.int64))[0]
                    name = CLASSES[q.argmax()]
                    if name == UNKNOWN:
                        continue
                    template, share = similarity(some, name)
                    if share >= confirmed:
                        taken.update(range(a, b + 1))
                        for k in range(a, b + 1):
                            single.pop(k, None)
                        single[a] = name, float(q.max()), template, share
                for k, (name, probability, template, share) in sorted(single.items()):
                    rows.append(i + int(where[k, 0]))
                    for column, value in zip(out, (
                            int(where[k, 1]), name, probability, template, share, share >= confirmed)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int64()),
                pa.array(out[1], pa.string()), pa.array(out[2], pa.float64()),
                pa.array(out[3], pa.int32()), pa.array(out[4], pa.float64()),
                pa.array(out[5], pa.bool_())],
                ["doc_id", "paragraph", "family", "probability", "template", "similarity", "confirmed"])
    return run


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
         confirmed: float = CONFIRMED) -> DataFrame:
    """Each paragraph whose likeliest class is a licence family: doc_id, paragraph (the line's
    number from 0), family, its calibrated probability, the nearest template of that family,
    similarity (the share of the template's words and pairs present) and whether it confirms.
    Adjoining lines, ``WINDOW`` at most, that only together confirm give one row in place of their
    own, with the number of the first.

    Null and empty texts and lines without a word give no row. Equal probabilities go to the
    family listed first. Null and repeated ids and repeated rows each give their rows. Further
    columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # columns by classes: a fixed size
    return arrow_map(picked(docs, doc_id, text), _scan(held, confirmed), FOUND)
