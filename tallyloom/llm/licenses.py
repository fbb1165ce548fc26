"""Licence notices in texts: a trained paragraph classifier, confirmed against templates (8)."""

from __future__ import annotations

import random
import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import id_text, per_block

UNKNOWN = "unknown"
#: Phrases of well-known notices, by family; # stands for a version or year.
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License", "This project is licensed under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache": ["Licensed under the Apache License, Version #", "Released under the Apache License, Version #", "You may obtain a copy of the License at apache.org/licenses", "This software is licensed under the Apache License Version #"],
    "GPL": ["This work is licensed under the GNU General Public License, version #", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "Licensed under the GNU General Public License version # or later", "Released under the GNU GPL version #"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version #", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "Released under the GNU AGPL version #"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version #", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD #-Clause License", "Licensed under the BSD License", "Use of this source code is governed by a BSD-style license"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. #", "Licensed under the Mozilla Public License Version #"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v#", "Licensed under the Eclipse Public License version #"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License"],
    "CC-BY-NC": ["Licensed under CC BY-NC #", "This work is licensed under a Creative Commons Attribution-NonCommercial # International License", "Available under CC BY-NC-SA #"],
    "CC-BY": ["Licensed under CC BY #", "This work is licensed under a Creative Commons Attribution # International License", "Text is available under the Creative Commons Attribution-ShareAlike License #", "Licensed under CC BY-SA #"],
    "CC0": ["Released under CC0 # Universal", "To the extent possible under law, the author has waived all copyright and related rights to this work", "Dedicated to the public domain under CC0 #"],
    "Proprietary": ["All rights reserved", "Copyright # All rights reserved", "All rights reserved. No part of this publication may be reproduced without prior written permission", "Proprietary and confidential; unauthorized copying is strictly prohibited"],
}
FAMILIES = [UNKNOWN, *TEMPLATES]
#: At most so many documents give paragraphs of the unknown class, those with the smallest hashes of their ids; and at most so many paragraphs with a word of the vocabulary, those with the smallest hashes.
SAMPLE, PARAGRAPHS = 1_000, 20_000
#: A paragraph is of a family at this calibrated probability, if its words also cover this share of one of its templates' word pairs.
SURE, COVERED = 0.5, 0.6
HASHES = 1 << 14
_STRIP = b".,;:!?()[]\"'"


def plain(word: bytes) -> bytes:
    """A word as the features see it: lower case, no marks at its ends, digits as #."""
    word = word.strip(_STRIP)
    return re.sub(rb"[0-9][0-9.]*", b"#", word).lower()


def words_of(text: str) -> list[bytes]:
    return [w for w in (plain(x) for x in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())) if w]


VOCABULARY = {w: k + 1 for k, w in enumerate(sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)}))}  # 0: any other


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 1_000_003 + b * 7919 + 12345) % HASHES


#: Of each template: its pairs of neighbouring words.
_PAIRS = [(FAMILIES.index(f), {(VOCABULARY[a], VOCABULARY[b]) for a, b in zip(w, w[1:])}) for f, ts in TEMPLATES.items() for w in map(words_of, ts)]


def confirmed(family: int, ids: list[int]) -> bool:
    """Whether the paragraph holds enough of the pairs of one of the family's templates."""
    own = set(zip(ids, ids[1:]))
    return any(len(own & pairs) >= COVERED * len(pairs) for f, pairs in _PAIRS if f == family)


class Classifier:
    """Softmax over families of sums of weights: of words and of pairs of neighbouring words, of the vocabulary only."""

    def __init__(self, word: np.ndarray, pair: np.ndarray, bias: np.ndarray, heat: float):
        self.word, self.pair, self.bias, self.heat = word, pair, bias, heat

    def logits(self, ids: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
        """ids: the words' numbers in the vocabulary, line: their paragraphs, in order."""
        out = np.tile(self.bias, (n, 1))
        known = np.flatnonzero(ids)
        near = known[:-1][(np.diff(known) == 1) & (line[known[1:]] == line[known[:-1]])] if len(known) else known
        for at, weight in ((line[known], self.word[ids[known]]), (line[near], self.pair[pair_hash(ids[near], ids[near + 1])])):
            if len(at):
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                out[at[first]] += np.add.reduceat(weight, first, axis=0)
        return out / self.heat

    def probabilities(self, ids, line, n) -> np.ndarray:
        z = self.logits(ids, line, n)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def flatten(paragraphs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for p in paragraphs for i in p], np.int64), np.repeat(np.arange(len(paragraphs)), [len(p) for p in paragraphs])


def train(ordinary: list[list[int]], seed: int = 5, rounds: int = 300, rate: float = 0.5) -> Classifier:
    """ordinary: paragraphs of the corpus as vocabulary numbers. Notices are templates among
    ordinary words, with words lost; scattered template words, shuffled templates and what ordinary paragraphs hold are the unknown class.
    The temperature is set on a fifth that isn't trained on."""
    rng = random.Random(seed)
    rows, target = [], []
    for family, templates in TEMPLATES.items():
        for t in templates:
            ids = [VOCABULARY[w] for w in words_of(t)]
            for k in range(60):
                kept = [i for i in ids if k < 20 or rng.random() > 0.1]
                rows.append([0] * rng.randint(0, 12) * (k % 3 > 0) + kept + [0] * rng.randint(0, 12) * (k % 2))
                target.append(FAMILIES.index(family))
            for _ in range(20):
                rows.append(rng.sample(ids, len(ids)))
                target.append(0)
    every = list(VOCABULARY.values())
    for _ in range(2000):
        rows.append([rng.choice(every) if rng.random() < 0.3 else 0 for _ in range(rng.randint(1, 40))])
        target.append(0)
    # a paragraph of the corpus that mostly is a template would teach the wrong class
    plain_rows = [p for p in ordinary if not any(confirmed(f, p) for f in range(1, len(FAMILIES)))]
    rows += plain_rows
    target += [0] * len(plain_rows)
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows, y = [rows[i] for i in order], np.array([target[i] for i in order])
    cut = len(rows) * 4 // 5
    ids, line = flatten(rows[:cut])
    known = np.flatnonzero(ids)
    near = known[:-1][(np.diff(known) == 1) & (line[known[1:]] == line[known[:-1]])]
    pairs = pair_hash(ids[near], ids[near + 1])
    c = len(FAMILIES)
    model = Classifier(np.zeros((len(VOCABULARY) + 1, c)), np.zeros((HASHES, c)), np.zeros(c), 1.0)
    sums = [np.full_like(x, 1e-6) for x in (model.word, model.pair, model.bias)]
    used = np.unique(pairs)
    for _ in range(rounds):
        p = model.probabilities(ids, line, cut)
        p[np.arange(cut), y[:cut]] -= 1
        p /= cut
        grad_word, grad_pair = np.zeros_like(model.word), np.zeros_like(model.pair)
        for k in range(c):
            grad_word[:, k] = np.bincount(ids[known], p[line[known], k], minlength=len(grad_word))
            grad_pair[:, k] = np.bincount(pairs, p[line[near], k], minlength=HASHES)
        grad_word += 1e-5 * model.word
        grad_pair[used] += 1e-5 * model.pair[used]
        for x, g, s in zip((model.word, model.pair, model.bias), (grad_word, grad_pair, p.sum(axis=0)), sums):
            s += g * g
            x -= rate * g / np.sqrt(s)
    ids, line = flatten(rows[cut:])
    z = model.logits(ids, line, len(rows) - cut)
    loss = []
    heats = np.linspace(0.5, 4, 36)
    for heat in heats:
        e = z / heat
        e -= e.max(axis=1, keepdims=True)
        loss.append(float((np.log(np.exp(e).sum(axis=1)) - e[np.arange(len(e)), y[cut:]]).mean()))
    model.heat = float(heats[int(np.argmin(loss))])
    return model


def paragraphs(texts: blocks.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, blocks.Words]:
    """Of all words: numbers in the vocabulary, and their paragraphs (lines with a word, numbered from 0); of the paragraphs: their texts."""
    words = blocks.words(texts)
    codes, distinct = words.encode()
    number = np.fromiter((VOCABULARY.get(plain(w), 0) if len(w) < 64 else 0 for w in distinct.to_pylist()), np.int64, len(distinct))
    breaks = np.flatnonzero(texts.data == 10)
    doc = np.repeat(np.arange(len(texts)), np.diff(words.docs))
    raw = np.searchsorted(breaks, words.at) + doc
    fresh = np.append(True, raw[1:] != raw[:-1]) if len(raw) else np.zeros(0, bool)
    line = np.cumsum(fresh) - 1
    return number[codes], line, doc[fresh], words


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = PARAGRAPHS) -> Classifier:
    """Trains on the templates and on at most `most` paragraphs of at most `sample` documents. Both bound the fit alone: `scan` reads every paragraph of every text.

    Null ids aren't in the sample; null and empty texts give no paragraph. An empty table leaves the templates.
    """
    source = id_text(docs)
    ids = [r.doc_id for r in source.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]

    def numbers(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, line, _, _ = paragraphs(blocks.texts_of(batch.column(1)))
        n = int(line[-1]) + 1 if len(line) else 0
        rows = np.split(ids, np.searchsorted(line, np.arange(1, n))) if n else []
        rows = [r.tolist() for r in rows if (r > 0).any()]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], ["ids"])

    few = source.where(F.col("doc_id").isin(ids)) if ids else source.limit(0)
    found = few.mapInArrow(per_block(numbers), "ids array<long>").orderBy(F.xxhash64("ids"), "ids").limit(most).collect()
    return train([list(r.ids) for r in found])


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_paragraphs, n_notices, families (sorted, joined by commas; empty: none), best_probability, unconfirmed, and spans of every document.

    A paragraph is a line with a word. It is a notice if a family's calibrated probability is
    at least 0.5 and the template comparison agrees; `unconfirmed` counts those for which it
    doesn't. spans: family, first and last byte (exclusive) and probability of each notice.
    Null and empty texts have no paragraphs; repeated rows are scanned alike.
    """
    span = pa.struct([("family", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = blocks.texts_of(batch.column(1))
        ids, line, doc, words = paragraphs(texts)
        n = len(doc)
        # a paragraph without a word of the vocabulary has the bias alone for logits, and all such have one answer
        known = np.zeros(n, bool)
        known[line[ids > 0]] = True
        renumber = np.cumsum(known) - 1
        inside = known[line] if n else np.zeros(0, bool)
        p = model.probabilities(ids[inside], renumber[line[inside]], int(known.sum()))
        best = p[:, 1:].argmax(axis=1) + 1 if len(p) else np.zeros(0, int)
        chance = p[np.arange(len(p)), best]
        rows = np.flatnonzero(known)
        first = np.searchsorted(line, np.arange(n + 1))
        top = np.zeros(batch.num_rows)
        np.maximum.at(top, doc[rows], chance)
        spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        doubtful = np.zeros(batch.num_rows, np.int64)
        for k in np.flatnonzero(chance >= SURE):
            r, d = rows[k], doc[rows[k]]
            a, b = first[r], first[r + 1]
            if confirmed(int(best[k]), ids[a:b].tolist()):
                end = words.at[b - 1] + words.offsets[b] - words.offsets[b - 1] - texts.offsets[d]
                spans[d].append({"family": FAMILIES[best[k]], "begin": int(words.at[a] - texts.offsets[d]), "end": int(end), "probability": round(float(chance[k]), 6)})
            else:
                doubtful[d] += 1
        families = [",".join(sorted({s["family"] for s in x})) for x in spans]
        columns = [pa.array(np.bincount(doc, minlength=batch.num_rows)), pa.array([len(x) for x in spans], pa.int64()), pa.array(families), pa.array(np.round(top, 6)), pa.array(doubtful), pa.array(spans, pa.list_(span))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_paragraphs", "n_notices", "families", "best_probability", "unconfirmed", "spans"])

    return id_text(docs).mapInArrow(per_block(run), "doc_id long, n_paragraphs long, n_notices long, families string, best_probability double, unconfirmed long, spans array<struct<family: string, begin: long, end: long, probability: double>>")
