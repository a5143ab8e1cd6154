"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is the lines up to an empty one, whose breaks count as white space, or a window
of WINDOW words of a longer one (windows overlap by half). Its hashed word n-grams of up to
three words go into a multinomial logistic regression over licence families and an unknown
class, trained from the templates, variants of them, and a bounded sample of paragraphs
of the corpus as unknown. Its scale is fitted to held-out paragraphs, and so is the probability
that each family must reach.

Where the known families together are likely enough, the regression looks closer: at windows of
SIZES words around there, so that short notices do not drown and two in a line are told apart.
A window whose likeliest class is a family, with that family's probability reached, predicts that
family, and a notice is a prediction that a template of the same family confirms: the template
runs through the window and at least SIMILARITY of its five-word shingles are there. Of
notices that share most of their words the most similar one stays.
"""

from __future__ import annotations

import re
import string
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.word_ids import Codes, chunks, groups
from reelspark.llm.worker import held

BUCKETS, NGRAMS, WINDOW = 1 << 16, 3, 24
#: Words of the windows looked at closely, and by how many words each kind moves on.
SIZES = ((6, 1), (12, 2), (24, 4))
#: Words of a very long text's piece that the next piece sees again: more than any template has.
CARRY = 128
SHINGLE, SIMILARITY = 5, 0.8
UNKNOWN = "unknown"
#: Documents, of up to so many characters, whose paragraphs are the sample of the unknown class.
SAMPLE_DOCS, SAMPLE_CHARS = 600, 20_000

#: Notices by which licences are commonly given, by family.
TEMPLATES = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU Affero General Public License version 3 or later.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache License 2.0.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Use of this source code is governed by a BSD-style license",
    ],
    "CC": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU General Public License version 2 or later.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Released under the GNU Lesser General Public License version 2.1 or later.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
}
FAMILIES = [UNKNOWN, *TEMPLATES]
#: Longer texts come in pieces of about so many characters.
PIECE = 1 << 20
_CHUNK = re.compile("[^ \t\n\r\x0b\x0c]+")
_EMPTY_LINE = re.compile("\n[ \t\r\x0b\x0c]*\n")


def plain(chunk: str) -> str:
    return chunk.lower().strip(string.punctuation)


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; the whole of a shorter one."""
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


_SHINGLES = {f: [shingles([w for c in t.split() if (w := plain(c))]) for t in texts] for f, texts in TEMPLATES.items()}


def _places() -> dict[tuple[str, ...], list[tuple[str, int, int]]]:
    """(family, template, place in it) of every shingle."""
    out: dict[tuple[str, ...], list[tuple[str, int, int]]] = {}
    for family, texts in TEMPLATES.items():
        for number, text in enumerate(texts):
            words = [w for c in text.split() if (w := plain(c))]
            for k in range(max(1, len(words) - SHINGLE + 1)):
                out.setdefault(tuple(words[k : k + SHINGLE]), []).append((family, number, k))
    return out


_PLACES = _places()
_SHINGLE_SIZES = sorted({len(x) for x in _PLACES})


_SEEN_BITS = 22


def _runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """Buckets of all runs of n word hashes."""
    value = np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(value)]
        return (value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _SEEN_BITS)


_SEEN = {n: np.zeros(1 << _SEEN_BITS, bool) for n in _SHINGLE_SIZES}
for _shingle in _PLACES:
    _SEEN[len(_shingle)][_runs_of(np.array([zlib.crc32(w.encode()) for w in _shingle], np.uint64), len(_shingle))] = True


def covered(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paragraph, start, length) of the stretches of words that shingles of templates cover (and a rare other one)."""
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    edge = np.zeros(len(words) + 1, np.int64)
    for n, seen in _SEEN.items():
        at = np.flatnonzero(seen[_runs_of(words, n)])
        at = at[owner[at] == owner[at + n - 1]]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]))
    first = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(owner[at], prepend=-1) > 0)) if len(at) else at
    lengths = np.diff(np.append(first, len(at)))
    return owner[at[first]], at[first] - bounds[owner[at[first]]], lengths


def occurrences(words: list[str], regions: list[tuple[int, int]]) -> list[tuple[str, int, list[tuple[int, int]]]]:
    """(family, template, (place, words) of each shared shingle) of what runs along a template within regions of `words`."""
    out, last = [], {}
    for begin, end in regions:
        for at in range(begin, end):
            for n in _SHINGLE_SIZES:
                if at + n > end:
                    continue
                for family, number, k in _PLACES.get(tuple(words[at : at + n]), ()):
                    hits, k0 = last.get((family, number), (None, 0))
                    # The same template from an earlier place on, or far away, is another notice.
                    if hits is None or k <= k0 or at - hits[-1][0] > WINDOW + k - k0:
                        hits = []
                        out.append((family, number, hits))
                    hits.append((at, n))
                    last[family, number] = hits, k
    return out


def close_windows(regions: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the windows of all SIZES within regions of a paragraph."""
    starts, lengths = [], []
    for a, b in regions:
        for size, move in SIZES:
            last = max(a, b - size)
            at = np.unique(np.append(np.arange(a, last + 1, move), last))
            starts.append(at)
            lengths.append(np.minimum(size, b - at))
    return np.concatenate(starts), np.concatenate(lengths)


def confirmed(words: list[str], regions: list[tuple[int, int]], predicted: list[tuple[int, int, str, float]]) -> list[tuple[int, str, float, float]]:
    """(first word, family, probability, similarity) of the predictions (begin, end, family, probability) that templates confirm."""
    found = []
    for family, number, hits in occurrences(words, regions):
        begin, end = hits[0][0], sum(hits[-1])
        close = len({at for at, _ in hits}) / len(_SHINGLES[family][number])
        chances = [p for a, b, f, p in predicted if f == family and a < end and b > begin]
        if close >= SIMILARITY and chances:
            found.append((begin, family, max(chances), min(1.0, close), {x for at, n in hits for x in range(at, at + n)}))
    found.sort(key=lambda x: (-x[3], -len(x[4]), -x[2], x[1]))
    out, taken = [], set()
    for begin, family, chance, close, at in found:
        if 2 * len(at & taken) <= len(at):
            out.append((begin, family, chance, close))
            taken |= at
    return out


def similarity(words: list[str], family: str) -> float:
    """The largest share of a template's shingles found here, or of these found in a template."""
    mine = shingles(words)
    best = 0.0
    for template in _SHINGLES[family]:
        shared = len(mine & template)
        if shared:
            best = max(best, shared / len(template), shared / len(mine) if len(words) >= SHINGLE else 0.0)
    return best


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paragraph, start, length) of the windows of paragraphs of so many words; those without words have none."""
    half = WINDOW // 2
    n = np.where(lengths > WINDOW, -(-(lengths - half) // half), (lengths > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * half
    return owner, start, np.minimum(WINDOW, lengths[owner] - start)


def ngrams(words: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of windows over word hashes, and where each window's begin (`lengths` are at least 1)."""
    ends = np.cumsum(lengths)
    place = np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    left = np.repeat(ends, lengths) - np.arange(len(place))  # words of the window from here on
    out = np.empty((len(place), NGRAMS), np.int64)
    value = np.zeros(len(place), np.uint64)
    for k in range(NGRAMS):
        follows = left > k
        with np.errstate(over="ignore"):
            value = value * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(place + k, len(words) - 1)]
        # Beyond the window there is no n-gram: a bucket of its own whose weight stays zero.
        out[:, k] = np.where(follows, (value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48), BUCKETS)
    return out, ends - lengths


@dataclass
class Model:
    weights: np.ndarray
    """(BUCKETS + 1, families); the last row is zero."""
    bias: np.ndarray
    threshold: float
    """Of all families together, for a closer look."""
    least: np.ndarray
    """Of each family, to be predicted."""
    scale: float = 1.0

    def probabilities(self, buckets: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        total = np.add.reduceat(self.weights[buckets].sum(axis=1), begins) if len(begins) else np.zeros((0, len(FAMILIES)), np.float32)
        z = self.scale * (total / np.sqrt(np.maximum(lengths, 1))[:, None] + self.bias)
        e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return e / e.sum(axis=1, keepdims=True) if len(z) else z


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode())


def variants(random: np.random.Generator, fillers: list[str], n: int = 25) -> tuple[list[list[str]], list[int]]:
    """Word lists made from the templates: whole, cut short, with words left out or others around them."""
    units, labels = [], []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = [w for c in text.split() if (w := plain(c))]
            for k in range(n):
                now = list(words)
                if k % 3 == 1 and len(now) > 8:
                    at = int(random.integers(0, len(now) - 7))
                    now = now[at : at + int(random.integers(7, len(now) - at + 1))]
                if k % 4 == 2 and len(now) > 5:
                    now.pop(int(random.integers(len(now))))
                if k % 2 and fillers:
                    around = [fillers[i] for i in random.integers(0, len(fillers), int(random.integers(1, max(2, WINDOW - len(now)))))]
                    at = int(random.integers(0, len(around) + 1))
                    now = around[:at] + now + around[at:]
                units.append(now)
                labels.append(FAMILIES.index(family))
    return units, labels


def fragments(random: np.random.Generator, fillers: list[str], n: int = 12) -> list[list[str]]:
    """Word lists that hold a few words of a template among others, as prose does: these are no notices."""
    out = []
    for texts in TEMPLATES.values():
        for text in texts:
            words = [w for c in text.split() if (w := plain(c))]
            for _ in range(n if len(words) > 2 * SHINGLE and fillers else 0):
                size = int(random.integers(SHINGLE, SHINGLE + 3))
                at = int(random.integers(len(words) - size + 1))
                before, after = ([fillers[i] for i in random.integers(0, len(fillers), int(random.integers(3, 9)))] for _ in range(2))
                out.append(before + words[at : at + size] + after)
    return out


def fit(texts: list[str | None], seed: int = 5, epochs: int = 20) -> Model:
    """A model from the templates and the paragraphs of `texts`, which count as unknown unless they look like a template."""
    random = np.random.default_rng(seed)
    unknown: list[list[str]] = []
    for text in texts:
        for paragraph in _EMPTY_LINE.split(text or ""):
            words = [w for c in paragraph.split() if (w := plain(c))]
            unknown += [words[a : a + WINDOW] for a in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2)] if words else []
    unknown = [u for u in unknown if max(similarity(u, f) for f in TEMPLATES) < SIMILARITY / 2]
    fillers = [w for u in unknown[:2000] for w in u[:5]]
    known, labels = variants(random, fillers)
    unknown += [u[a : a + n] for u in unknown[::3] for n, _ in SIZES[:2] if len(u) > n for a in (int(random.integers(len(u) - n + 1)),)]
    unknown += fragments(random, fillers)
    units = [*known, *unknown]
    y = np.array([*labels, *[0] * len(unknown)])
    held = random.random(len(units)) < 0.25
    flat = np.array([word_hash(w) for u in units for w in u], np.uint64)
    lengths = np.array([len(u) for u in units], np.int64)
    buckets, begins = ngrams(flat, np.cumsum(lengths) - lengths, lengths)
    owner = np.repeat(np.arange(len(units)), lengths)
    model = Model(np.zeros((BUCKETS + 1, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32), 0.5, np.full(len(FAMILIES), 0.5))
    share = np.bincount(y[~held], minlength=len(FAMILIES))
    weight = np.where(held, 0, 1 / np.sqrt(np.maximum(share, 1))[y])
    weight /= weight.sum()
    seen = np.flatnonzero(~held[owner])
    square, b_square = np.full_like(model.weights, 1e-14), np.full_like(model.bias, 1e-14)
    for _ in range(epochs):
        error = model.probabilities(buckets, begins, lengths)
        error[np.arange(len(y)), y] -= 1
        error *= weight[:, None]
        gradient = np.zeros_like(model.weights)
        scaled = (error / np.sqrt(np.maximum(lengths, 1))[:, None]).astype(np.float32)
        for k in range(NGRAMS):
            np.add.at(gradient, buckets[seen, k], scaled[owner[seen]])
        gradient[BUCKETS] = 0
        square += gradient**2
        model.weights -= 0.3 * gradient / np.sqrt(square)
        b_square += error.sum(axis=0) ** 2
        model.bias -= 0.1 * (error.sum(axis=0) / np.sqrt(b_square)).astype(np.float32)
        model.weights[BUCKETS] = 0
    model.scale = min(np.geomspace(0.25, 4, 17), key=lambda scale: _loss(model, scale, buckets, begins, lengths, y, held))
    p, y = model.probabilities(buckets, begins, lengths)[held], y[held]
    best = 1 - p[:, 0]
    # Above nearly all unknown paragraphs, below nearly all notices; between them when that is possible.
    model.threshold = _between(best[y == 0], best[y > 0], 0.005)
    likeliest = p.argmax(axis=1)
    for f in range(1, len(FAMILIES)):
        model.least[f] = _between(p[(y != f) & (likeliest == f), f], p[(y == f) & (likeliest == f), f], 0.2)
    return model


def _loss(model: Model, scale: float, buckets, begins, lengths, y, held) -> float:
    model.scale = scale
    p = model.probabilities(buckets, begins, lengths)[held]
    return float(-np.log(np.maximum(p[np.arange(len(p)), y[held]], 1e-12)).mean()) if len(p) else 0.0


def _between(wrong: np.ndarray, right: np.ndarray, least: float) -> float:
    """A probability above nearly all wrong ones and below nearly all right ones, where that is possible."""
    high = np.quantile(wrong, 0.999) if len(wrong) else least
    low = np.quantile(right, 0.02) if len(right) else least
    return float(np.clip(min((high + low) / 2, low), least, 0.9))


class Scanner:
    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.codes = Codes(self._learn)
        self.hashes = np.empty(1 << 16, np.uint64)
        self.known = 0

    def _learn(self, words: list[str]) -> None:
        n = len(words)
        while self.known + n > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
        # Signs alone are no word.
        self.hashes[self.known : self.known + n] = [word_hash(w) if (w := plain(c)) else 1 << 40 for c in words]
        self.known += n

    def scan(self, texts) -> Iterator[list[tuple[str, float, float]]]:
        """(family, probability, similarity) of every confirmed notice of each text."""
        found: list[tuple[str, float, float]] = []
        carried = ""
        for group, more in groups(texts, PIECE):
            if self.codes.full:
                self._reset()
            if carried:
                group = [carried + group[0]]
            rows, carried = self._group(group, more)
            for one in rows:
                found += one
                if not more:
                    yield found
                    found = []

    def _group(self, texts: list[str], more: bool = False) -> tuple[list[list[tuple[str, float, float]]], str]:
        """Notices of each text, and what of the one text the next piece of it must see again if there is `more`.

        A notice that begins in the words to be seen again is left to the next piece.
        """
        paragraphs = [_EMPTY_LINE.split(t) for t in texts]
        flat = [x for ps in paragraphs for x in ps]
        out: list[list[tuple[str, float, float]]] = [[] for _ in texts]
        carried, left = "", None
        if more:
            ends = [m for m in _CHUNK.finditer(flat[-1]) if plain(m.group())]
            left = max(0, len(ends) - CARRY)
            carried = texts[0][len(texts[0]) - len(flat[-1]) + (ends[left].start() if ends else 0) :]
        words, which, last = chunks(flat)
        rows = self.codes.of(words)[which]
        hashes = self.hashes[rows]  # which learning may have replaced
        real = hashes < 1 << 40
        bounds = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], last])]
        hashes = hashes[real]
        owner, start, lengths = map(np.concatenate, zip(windows(np.diff(bounds)), covered(hashes, bounds)))
        if not len(owner):
            return out, carried
        order = np.lexsort((start, owner))
        owner, start, lengths = owner[order], start[order], lengths[order]
        p = self._probabilities(hashes, bounds[owner] + start, lengths)
        text_of = np.repeat(np.arange(len(texts)), [len(ps) for ps in paragraphs])
        likely = np.flatnonzero(1 - p[:, 0] >= self.model.threshold)
        for rows in np.split(likely, np.flatnonzero(np.diff(owner[likely])) + 1) if len(likely) else ():
            place = owner[rows[0]]
            n = int(bounds[place + 1] - bounds[place])
            regions: list[tuple[int, int]] = []
            for a, b in zip(start[rows].tolist(), (start[rows] + lengths[rows]).tolist()):
                # A notice may reach over the window's ends.
                wide = max(0, a - WINDOW), min(n, b + WINDOW)
                if regions and wide[0] <= regions[-1][1]:
                    regions[-1] = regions[-1][0], max(regions[-1][1], wide[1])
                else:
                    regions.append(wide)
            predicted = self._predicted(hashes, int(bounds[place]), regions)
            if not predicted:
                continue
            now = [w for c in _CHUNK.findall(flat[place]) if (w := plain(c))]
            for begin, family, chance, close in confirmed(now, regions, predicted):
                if left is None or place < len(flat) - 1 or begin < left:
                    out[text_of[place]].append((family, chance, close))
        return out, carried

    def _probabilities(self, hashes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        buckets, at = ngrams(hashes, begins, lengths)
        return self.model.probabilities(buckets, at, lengths)

    def _predicted(self, hashes: np.ndarray, begin: int, regions: list[tuple[int, int]]) -> list[tuple[int, int, str, float]]:
        """(begin, end, family, probability) of the windows in which the regression sees a family."""
        start, lengths = close_windows(regions)
        p = self._probabilities(hashes, begin + start, lengths)
        family = p.argmax(axis=1)
        chance = p[np.arange(len(p)), family]
        seen = np.flatnonzero((family > 0) & (chance >= self.model.least[family]))
        return [(int(start[i]), int(start[i] + lengths[i]), FAMILIES[family[i]], float(chance[i])) for i in seen]


def train(docs: DataFrame) -> Model:
    """Fits on the paragraphs of at most SAMPLE_DOCS documents, chosen by a hash of doc_id."""
    name = f"sample_{uuid.uuid4().hex[:8]}"
    ids = docs.select(F.col("doc_id").cast("long").alias(name)).where(F.col(name).isNotNull()).distinct()
    chosen = F.broadcast(ids.orderBy(F.xxhash64(name), name).limit(SAMPLE_DOCS))
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).join(chosen, docs["doc_id"].cast("long") == F.col(name), "left_semi")
    rows = texts.select(F.col("doc_id"), "text").orderBy("doc_id", "text").limit(2 * SAMPLE_DOCS)
    return fit([r["text"] for r in rows.collect()])


FOUND = "family string, probability double, similarity double, families string, n_notices long"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, its likeliest licence family (or unknown), that notice's probability and similarity,
    all its families in order, divided by commas, and the number of notices.

    Whole texts are read. Null and empty texts have no notice: unknown, 0, 0, "", 0. Repeated
    rows are scanned each, equal probabilities go by the family's name. Needs doc_id and text,
    ignores other columns; an empty table gives no rows.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    names = [c.split()[0] for c in FOUND.split(", ")]

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = held(("licences", key), lambda: Scanner(shared.value))
        for texts in batches:
            rows = []
            for found in scanner.scan(texts):
                family, chance, close = min(found, key=lambda x: (-x[1], x[0]), default=(UNKNOWN, 0.0, 0.0))
                rows.append((family, chance, close, ",".join(sorted({f for f, _, _ in found})), len(found)))
            yield pd.DataFrame(rows, columns=names)

    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run("text").alias("found"))
    return scanned.select("doc_id", "found.*")
