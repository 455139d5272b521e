"""Licence scans: a trained classifier names a family in windows of words, and comparison with the family's templates confirms it."""

from __future__ import annotations

import bisect
import functools
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .words import split_words, spread

# Notices and first sentences of well-known licences, by family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "proprietary": ("All rights reserved.", "This document is confidential and proprietary. Unauthorized copying is strictly prohibited."),
}
# Sentences with the same words that grant nothing.
UNRELATED = (
    "The driver showed a licence and the police let the car go.",
    "She asked for permission to leave the room before the work was done.",
    "The version of the story that the public heard was free of any copy.",
    "Software that people use at home is often released in the autumn.",
    "The general said that the terms of the agreement were reserved for later.",
    "A fishing license is needed on this lake, without warranty of a catch.",
    "Copyright law was debated in the second session of the parliament.",
    "He obtained a copy of the file and wrote a notice about the conditions.",
    "Rights of all kinds were discussed under the new international treaty.",
    "The foundation of the library is public and the source of its funds is private.",
    "Distribution of the goods is limited by law, as agreed in writing.",
    "An MIT professor and an Apache helicopter pilot met in a Mozilla office.",
    "Er geht mit der Familie und mit dem Hund in den Wald, mit allen anderen.",
    "The MIT students use the Apache server, BSD sockets and a GNU compiler.",
    "Creative people share what is common, by and by, in a public domain of ideas.",
    "See the file for details, or the terms of use, as this page is under construction.",
    "All of the rights that the authors have are listed in the book of the general.",
    "This work is released in the summer, free of charge, to the general public.",
    "The GNU Free Documentation License is a license for manuals.",
    "The Apache Software Foundation and the Mozilla Foundation met the MIT Press.",
    "Confidential talks were held, and the proprietary rights of the firm were reserved.",
    "The general public license to fish is needed, by law, in all public waters.",
    "Version 2.0 of the driver was released under the old name, version 3.0 under the new.",
    "The ratio was 1.0 in total, 2.0 in part and 4.0 at most, as in version 3 or 2.",
    "All rights reserved seats are free, all rights reserved by the museum are not.",
    "Creative Commons is a public organisation, and attribution is a common custom.",
)
# What licences are called.
NAMES = {
    "mit": ("MIT License", "MIT Licence", "MIT license terms", "X11 MIT License"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2 licence"),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-3-Clause"),
    "gpl": ("GNU General Public License", "GNU GPL version 3", "GPLv3", "GPL-2.0", "GPL"),
    "lgpl": ("GNU Lesser General Public License", "LGPL", "LGPL-2.1", "LGPLv3", "GNU LGPL"),
    "agpl": ("GNU Affero General Public License", "AGPL", "AGPLv3", "AGPL-3.0"),
    "mpl-2.0": ("Mozilla Public License 2.0", "MPL-2.0", "Mozilla Public License"),
    "isc": ("ISC License", "ISC licence"),
    "cc-by": ("Creative Commons Attribution 4.0", "CC BY 4.0", "CC-BY-3.0", "Creative Commons Attribution License"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0", "CC-BY-SA-3.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0", "CC-BY-NC-3.0"),
    "cc0": ("CC0 1.0", "CC0 public domain dedication", "CC0-1.0 Universal"),
    "unlicense": ("The Unlicense", "Unlicense"),
    "proprietary": ("proprietary and confidential", "proprietary license, all rights reserved", "confidential and proprietary"),
}
# Sentences that name a licence.
FRAMES = (
    "Licensed under {}", "Released under the {}", "Distributed under the terms of the {}", "This work is licensed under {}", "This program is available under {}",
    "The source code is subject to the {}", "You may use this software under the {}", "License: {}", "SPDX-License-Identifier: {}", "Use is governed by the {}",
    "{} applies to this text", "All content is under {}", "Made available by the authors under the {}", "See the {} for details", "A copy of the {} is included",
)
# Words that say nothing in any order.
LITTLE = ("the", "of", "to", "by", "and", "in", "under", "all", "a", "is", "this", "for", "with", "or", "as", "on", "it", "you", "may", "are", "be", "that", "an", "mit", "work", "see", "use", "0", "1", "2", "3", "4")
# Words that the names of licences have in common, so that they tell none from the others.
COMMON = ("license", "licence", "public", "general", "version", "terms", "the", "software", "international", "universal", "dedication", "domain", "clause", "all", "rights", "reserved", "and", "0", "1", "2", "3", "4")
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *TEMPLATES)
#: The share of a template's word pairs that a window must hold to be confirmed.
CONFIRM = 0.8
#: Lengths of the windows that are classified, in words, and the words that a confirmed window may have beyond its template's.
WINDOWS, _SLACK = (1, 2, 3, 4, 6, 8, 12, 16, 24), 6
#: Words more that can tell a longer name from one that it begins or ends with.
_MORE = 3
#: A template of fewer words confirms only as a line or a sentence of its own.
SHORT = 5
#: Characters of a text whose windows are weighed at once, and words that slices share: more than any window has.
_SLICE, _SHARED = 1 << 18, 48
#: Bytes from which on a text isn't looked at with others first.
_LONG = 4 << 20
_WORD, _GAP = re.compile(r"[a-z0-9]+"), re.compile(r"[^A-Za-z0-9]|$")
_BEFORE, _AFTER = re.compile(r"(?:^|[\n.!?:;,)])[ \t#*/>-]*$"), re.compile(r"[ \t]*(?:[.!?;)\r\n]|$)")
_WORD_OR_END = re.compile(r"[a-z0-9]+|\n")


def _lowered(text: str) -> str:
    """A-Z in lower case: places stay what they are."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str) -> list[str]:
    """Words of a text; one that follows itself says nothing new and is left out."""
    words = _WORD.findall(_lowered(text))
    return [w for k, w in enumerate(words) if not k or words[k - 1] != w]


def _grams(words: list[str]) -> set[tuple[str, ...]]:
    return {*zip(words, words[1:], strict=False)} or {tuple(words)}


class Model(NamedTuple):
    """The n-grams that are features: a number for each word, and for two words' numbers that of their pair (0 is none);
    weights and constants by family, the temperature that calibrates them, the probability above which one is named."""

    words: dict[str, int]
    pairs: np.ndarray
    weights: np.ndarray
    constants: np.ndarray
    temperature: float
    least: float

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))

    def positions(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of words, and of the pairs that end in them (the first's counts for nothing)."""
        pair = np.zeros_like(numbers)
        pair[1:] = self.pairs[numbers[:-1], numbers[1:]]
        return numbers, pair

    def margins(self, numbers: np.ndarray) -> np.ndarray:
        """A sparse product: every n-gram of a paragraph has the same share, of all together length 1."""
        word, pair = self.positions(numbers)
        total = self.weights[word].sum(axis=0) + self.weights[pair[1:]].sum(axis=0)
        return total / np.sqrt(max(1, 2 * len(numbers) - 1)) + self.constants


def _sentences() -> list[str]:
    names = [n for ns in NAMES.values() for n in ns]
    return [*(t for ts in TEMPLATES.values() for t in ts), *UNRELATED, *names, *(f.format(n) for f in FRAMES for n in names)]


def _features() -> tuple[dict[str, int], np.ndarray]:
    """A number for each word and each word pair of the fixed sentences. Other words are no features: they only dilute."""
    words = {w: k for k, w in enumerate(sorted({w for t in _sentences() for w in words_of(t)}), 1)}
    pairs = np.zeros((len(words) + 1, len(words) + 1), np.int64)
    grams = sorted({g for t in _sentences() for g in _grams(words_of(t)) if len(g) == 2})
    for k, (a, b) in enumerate(grams, len(words) + 1):
        pairs[words[a], words[b]] = k
    return words, pairs


def _examples(rng: np.random.Generator, rounds: int) -> list[tuple[list[str], int]]:
    """Variants of the templates (words lost) and of sentences that name licences, other words around them; the same sentences
    with licences that aren't known; parts of sentences that grant nothing, and of those that name no licence; known words
    alone and in no order, numbers of versions, and words of no language."""
    pool = sorted({w for s in UNRELATED for w in words_of(s)})
    # Words that name a family by themselves aren't dealt at random.
    known = sorted({w for ts in (*TEMPLATES.values(), *NAMES.values()) for t in ts for w in words_of(t)} - {"gpl", "gplv3", "lgpl", "lgplv3", "agpl", "agplv3", "unlicense", "cc0", "mpl"})
    strange = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(2, 12))))
    some = lambda n: [strange() if rng.random() < 0.7 else str(rng.choice(pool)) for _ in range(n)]
    kept = lambda words: [w for w in words if rng.random() > 0.06] or words
    out = []
    for _ in range(rounds):
        for k, family in enumerate(FAMILIES[1:], 1):
            texts = [kept(words_of(t)) for t in TEMPLATES[family]]
            for name in NAMES[family]:
                texts.append(words_of(name))
                for f in rng.choice(FRAMES, 3):
                    before, after = str(f).split("{}")
                    texts.append([*kept(words_of(before)), *words_of(name), *kept(words_of(after))])
                    if family != "proprietary":
                        other = [w if w in COMMON else strange() for w in words_of(name)]
                        if rng.random() < 0.5:
                            other = [*some(int(rng.integers(0, 2))), *other, *(str(w) for w in rng.choice(COMMON[:10], int(rng.integers(0, 3))))]
                        out.append(([*words_of(before), *other, *words_of(after)], 0))
                        out.append((other, 0))
            for words in texts:
                around = some(int(rng.integers(0, 5 if len(words) > 3 else 3)))
                cut = int(rng.integers(0, len(around) + 1))
                out.append(([*around[:cut], *words, *around[cut:]], k))
        for t in UNRELATED:
            words = words_of(t)
            for _ in range(4):
                a = int(rng.integers(0, len(words)))
                out.append((words[a : a + int(rng.integers(1, 16))], 0))
        for f in FRAMES:
            out.append((words_of(f.format(" ".join(some(2)))), 0))
        out += [([w], 0) for w in known]
        out += [(["the", w, *(str(x) for x in rng.choice(LITTLE, int(rng.integers(0, 3))))], 0) for w in known]
        for _ in range(30):
            numbers = [str(n) for n in rng.integers(0, 5, int(rng.integers(1, 4)))]
            around = [str(w) for w in rng.choice((*COMMON, *LITTLE), int(rng.integers(1, 7)))]
            cut = int(rng.integers(0, len(around) + 1))
            out.append(([*around[:cut], *numbers, *around[cut:]], 0))
        out += [([str(w) for w in rng.choice(known, rng.integers(1, 4))], 0) for _ in range(20)]
        out += [([*some(int(rng.integers(0, 4))), str(w), *some(int(rng.integers(0, 4)))], 0) for w in rng.choice(known, 60)]
        out += [([str(w) for w in rng.choice(LITTLE, rng.integers(1, 16))], 0) for _ in range(20)]
        out += [([str(w) for w in rng.choice(LITTLE, rng.integers(2, 4), replace=False)] * int(rng.integers(2, 9)), 0) for _ in range(20)]
        out += [(some(int(rng.integers(1, 20))), 0) for _ in range(40)]
    return out


def _softmax(margins: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((margins - margins.max(axis=-1, keepdims=True)) / temperature)
    return e / e.sum(axis=-1, keepdims=True)


@functools.cache
def train(seed: int = 42, rounds: int = 10, epochs: int = 4) -> Model:
    """Multinomial logistic regression by adaptive gradient steps on variants of templates and names.

    On a second set of variants the temperature of least log loss is chosen, and the probability that at most 1 in 1,000 of
    the paragraphs that name no licence reach for any family (0.95 at least). Training sees no input rows: its size is fixed.
    """
    rng, (names, pairs) = np.random.default_rng(seed), _features()
    size = (int(pairs.max()) + 1, len(FAMILIES))
    model = Model(names, pairs, np.zeros(size), np.zeros(len(FAMILIES)), 1.0, 1.0)
    rows = [(model.numbers(w), k) for w, k in _examples(rng, rounds)]
    held = [(model.numbers(w), k) for w, k in _examples(rng, max(1, rounds // 3))]
    squares, constant_squares = np.full(size, 1e-8), np.full(len(FAMILIES), 1e-8)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            numbers, k = rows[r]
            slope = _softmax(model.margins(numbers), 1.0)
            slope[k] -= 1
            word, pair = model.positions(numbers)
            at, n = np.unique(np.concatenate([word, pair[1:]]), return_counts=True)
            at, n = at[at > 0], n[at > 0]
            g = n[:, None] * slope / np.sqrt(max(1, 2 * len(numbers) - 1)) + 1e-5 * model.weights[at]
            squares[at] += g * g
            model.weights[at] -= 0.5 * g / np.sqrt(squares[at])
            constant_squares += slope * slope
            model.constants[:] -= 0.5 * slope / np.sqrt(constant_squares)
    margins, labels = np.array([model.margins(x) for x, _ in held]), np.array([k for _, k in held])
    loss = {t: -np.log(_softmax(margins, t)[np.arange(len(labels)), labels] + 1e-12).sum() for t in (0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    temperature = min(loss, key=loss.get)
    others = _softmax(margins, temperature)[labels == 0, 1:].max(axis=1)
    return model._replace(temperature=temperature, least=max(0.95, float(np.quantile(others, 0.999))))


class Found(NamedTuple):
    family: str
    start: int
    end: int
    probability: float
    confirmed: bool


@functools.cache
def _template_grams() -> dict[str, list[set]]:
    return {family: [_grams(words_of(t)) for t in ts] for family, ts in TEMPLATES.items()}


@functools.cache
def _template_words() -> dict[str, set[str]]:
    return {family: {w for t in ts for w in words_of(t)} for family, ts in TEMPLATES.items()}


@functools.cache
def _templates_by_pair() -> dict[tuple[str, ...], list[tuple[int, int, int]]]:
    """For each word pair the templates that have it: a number, the number of words and that of different pairs."""
    out, number = {}, 0
    for ts in TEMPLATES.values():
        for t in ts:
            number += 1
            grams = _grams(words_of(t))
            for g in grams:
                out.setdefault(g, []).append((number, len(words_of(t)), len(grams)))
    return out


def classify(model: Model, paragraph: str, alone: bool = True) -> tuple[str, float, bool]:
    """The family, its calibrated probability, and whether a template of the family is confirmed to be in the paragraph;
    `alone` says whether it's a line or sentence of its own, without which short templates confirm nothing."""
    words = words_of(paragraph)
    if not words:
        return UNKNOWN, 1.0, False
    p = _softmax(model.margins(model.numbers(words)), model.temperature)
    k = int(p.argmax())
    if k == 0 or p[k] < model.least:
        return UNKNOWN, float(p[0]), False
    held = _grams(words)
    share = max((len(t & held) / len(t) for t in _template_grams()[FAMILIES[k]] if alone or len(t) >= SHORT - 1), default=0.0)
    return FAMILIES[k], float(p[k]), share >= CONFIRM


def _bounds(model: Model, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each length of windows the first words of those in which a family may reach the probability that names it, judged by
    the most that each n-gram can add for any family: no window is passed over in which it does."""
    gain = np.maximum(0, (model.weights[:, 1:] - model.weights[:, :1]).max(axis=1))
    gain[0] = 0
    least = model.temperature * np.log(model.least / (1 - model.least)) - (model.constants[1:] - model.constants[0]).max()
    word, pair = (gain[x] for x in model.positions(numbers))
    upto = np.concatenate([[0.0], np.cumsum(word + pair)])
    for n in WINDOWS:
        if n <= len(numbers):
            # The pair that ends in the first word begins before the window.
            total = upto[n:] - upto[:-n] - pair[: len(pair) - n + 1]
            yield n, np.flatnonzero(total >= least * np.sqrt(2 * n - 1) - 1e-6)


def may_name(model: Model, texts: pa.Array) -> np.ndarray:
    """Whether a window of a text may name a family (see `_bounds`). Every window of every text is weighed."""
    found, words = np.zeros(len(texts), bool), split_words(texts)
    tokens = _WORD_OR_END.findall(_lowered(words.joined()))
    # Line ends end the distinct words and have the number -1; words that are no features have numbers below that.
    others = {t: -k for k, t in enumerate(set(tokens) - model.words.keys() - {"\n"}, 2)}
    numbers = np.fromiter(map(({"\n": -1} | model.words | others).__getitem__, tokens), np.int64, len(tokens))
    ends = numbers == -1
    numbers, per_word = numbers[~ends], np.bincount(np.cumsum(ends)[~ends], minlength=len(words.distinct))
    numbers = numbers[spread((np.cumsum(per_word) - per_word)[words.codes], per_word[words.codes])]
    counts = words.sums(per_word)
    text = np.repeat(np.arange(len(texts)), counts)
    fresh = np.ones(len(numbers), bool)
    fresh[1:] = (numbers[1:] != numbers[:-1]) | (text[1:] != text[:-1])
    numbers, text = np.maximum(numbers[fresh], 0), text[fresh]
    last = np.searchsorted(text, text, side="right")
    for n, at in _bounds(model, numbers):
        found[text[at[at + n <= last[at]]]] = True
    return found


def _named(model: Model, numbers: np.ndarray) -> list[tuple[int, int, int, float, float]]:
    """Windows that name a family: (first word, words, family, probability, log-odds against none)."""
    word, pair = (model.weights[x] for x in model.positions(numbers))
    upto, out = np.concatenate([np.zeros((1, word.shape[1])), np.cumsum(word + pair, axis=0)]), []
    for n, at in _bounds(model, numbers):
        margins = (upto[at + n] - upto[at] - pair[at]) / np.sqrt(2 * n - 1) + model.constants
        p = _softmax(margins, model.temperature)
        k = p.argmax(axis=1)
        rows = np.arange(len(p))
        best, odds = p[rows, k], (margins[rows, k] - margins[:, 0]) / model.temperature
        out += [(int(at[i]), n, int(k[i]), float(best[i]), float(odds[i])) for i in np.flatnonzero((k > 0) & (best >= model.least)).tolist()]
    return out


def _windows(words: list[str]) -> Iterator[tuple[int, int, int]]:
    """Runs of words (first, last, pairs held) that hold enough pairs of a template close to each other, wherever lines break."""
    places: dict[tuple[int, int, int], list[int]] = {}
    for k, pair in enumerate(zip(words, words[1:], strict=False)):
        for template in _templates_by_pair().get(pair, ()):
            places.setdefault(template, []).append(k)
    for (_, n, grams), at in places.items():
        if len(at) < CONFIRM * grams:
            continue
        seen, first = Counter(), 0
        for k in at:
            seen[words[k], words[k + 1]] += 1
            while k + 1 - at[first] >= n + _SLACK or seen[words[at[first]], words[at[first] + 1]] > 1:
                gone = words[at[first]], words[at[first] + 1]
                seen[gone] -= 1
                if not seen[gone]:
                    del seen[gone]
                first += 1
            if len(seen) >= CONFIRM * grams:
                yield at[first], k + 1, len(seen)


def _overlapping(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether [start, end) has something in common with one of the sorted spans, which have nothing in common."""
    at = bisect.bisect_left(spans, (end,))
    return at > 0 and spans[at - 1][1] > start


def _whole(windows: list[tuple[int, int, int, float, float]]) -> list[tuple[int, int, int, float, float]]:
    """The windows without those that a few more words make another family's, unless the rest names that family by itself: a
    part of a longer name goes, one of two names stays."""
    of, few = {w[:2]: w[2] for w in windows}, [n for n in WINDOWS if n <= _MORE]
    out = []
    for w in windows:
        first, end = w[0], w[0] + w[1]
        for n in WINDOWS:
            if w[1] < n <= w[1] + _MORE:
                for a in range(end - n, first + 1):
                    other = of.get((a, n))
                    if other is not None and other != w[2] and not any(of.get((b, m)) == other for m in few for b in (*range(a, first - m + 1), *range(end, a + n - m + 1))):
                        break
                else:
                    continue
                break
        else:
            out.append(w)
    return out


def _chosen(model: Model, windows: list[tuple[int, int, int, float, float]]) -> list[tuple[int, int, int, float, float]]:
    """Of windows that overlap those without common words whose log-odds add up to most, each less what one needs at least: so a window that holds two
    names loses against two windows, and a part of a name against the whole."""
    windows = sorted(_whole(windows), key=lambda w: (w[0] + w[1], w[0], w[2:]))
    ends, need = [w[0] + w[1] for w in windows], float(np.log(model.least / (1 - model.least)))
    best, taken, before = [0.0], [], []
    for k, w in enumerate(windows):
        before.append(bisect.bisect_right(ends, w[0], 0, k))
        value = best[before[k]] + w[4] - need + 1e-6
        taken.append(value > best[-1])
        best.append(max(value, best[-1]))
    out, k = [], len(windows)
    while k:
        if taken[k - 1]:
            out.append(windows[k - 1])
            k = before[k - 1]
        else:
            k -= 1
    return out


def _slices(text: str) -> Iterator[tuple[int, str]]:
    """Parts of a text, in lower case, that end between words, and where they begin."""
    at = 0
    while at < len(text):
        end = _GAP.search(text, min(len(text), at + _SLICE)).start()
        yield at, _lowered(text[at:end])
        at = end


class _Scan:
    """The words of a text that are still needed, with their places, and the windows in them that aren't decided yet."""

    def __init__(self, model: Model, text: str):
        self.model, self.text, self.first = model, text, 0  # first: the number of the first word that is kept
        self.words: list[str] = []
        self.places: list[tuple[int, int]] = []
        self.templates: set[tuple[int, int, int]] = set()
        self.named: list[tuple[int, int, int, float, float]] = []
        self.out: list[Found] = []

    def add(self, at: int, part: str) -> None:
        """Weigh all windows that end in a part of the text."""
        old = max(0, len(self.words) - _SHARED)
        shared = len(self.words) - old
        for t in _WORD.finditer(part):
            if not self.words or self.words[-1] != t[0]:
                self.words.append(t[0])
                self.places.append((at + t.start(), at + t.end()))
        words, base = self.words[old:], self.first + old
        self.templates |= {(base + a, base + b, n) for a, b, n in _windows(words) if b >= shared}
        self.named += [(base + i, *w) for i, *w in _named(self.model, self.model.numbers(words)) if i + w[0] > shared]

    def settle(self, upto: int) -> None:
        """Decide on groups of overlapping windows that no window from word `upto` on can join, and forget their words."""
        spans = sorted([(a, b + 1, 0, k) for k, (a, b, _) in enumerate(sorted(self.templates))] + [(w[0], w[0] + w[1], 1, k) for k, w in enumerate(self.named)])
        templates, group, end, open_ = sorted(self.templates), [], -1, []
        for span in [*spans, None]:
            if group and (span is None or span[0] >= end):
                if end <= upto:
                    self._decide([templates[k] for _, _, kind, k in group if kind == 0], [self.named[k] for _, _, kind, k in group if kind == 1])
                else:
                    open_ += group
                group, end = [], -1
            if span is not None:
                group.append(span)
                end = max(end, span[1])
        self.templates, self.named = {templates[k] for _, _, kind, k in open_ if kind == 0}, [self.named[k] for _, _, kind, k in open_ if kind == 1]
        keep = min([self.first + len(self.words) - _SHARED, *(s[0] for s in open_)])
        if keep > self.first:
            del self.words[: keep - self.first], self.places[: keep - self.first]
            self.first = keep

    def _decide(self, templates: list[tuple[int, int, int]], named: list[tuple[int, int, int, float, float]]) -> None:
        claimed: list[tuple[int, int]] = []

        def claim(first: int, last: int, family: str, p: float, confirmed: bool) -> None:
            bisect.insort(claimed, (first, last + 1))
            start, end = self.places[first - self.first][0], self.places[last - self.first][1]
            if "\n" not in self.text[start:end] and self.text[end : end + 1] in (".", "!", "?"):
                end += 1
            self.out.append(Found(family, start, end, round(p, 6), confirmed))

        whole = _whole(named) if templates else []
        for first, last, _ in sorted(templates, key=lambda w: (-w[2], w[1] - w[0], w)):
            if not _overlapping(claimed, first, last + 1):
                family, p, confirmed = self._confirmed(first, last)
                if confirmed and not any(first <= w[0] and w[0] + w[1] <= last + 1 and self._other(w, family) for w in whole):
                    claim(first, last, family, p, True)
        rest = [w for w in named if not _overlapping(claimed, w[0], w[0] + w[1])]
        for first, n, k, p, _ in _chosen(self.model, rest):
            claim(first, first + n - 1, FAMILIES[k], p, False)

    def _other(self, w: tuple[int, int, int, float, float], family: str) -> bool:
        """Whether a window names another family with words that this one's templates don't have."""
        own = _template_words()[family]
        return FAMILIES[w[2]] != family and any(x in self.model.words and x not in own for x in self.words[w[0] - self.first : w[0] + w[1] - self.first])

    def _confirmed(self, first: int, last: int) -> tuple[str, float, bool]:
        a, b = first - self.first, last - self.first
        start, end = self.places[a][0], self.places[b][1]
        alone = bool(_BEFORE.search(self.text[max(0, start - 40) : start]) if start else True) and bool(_AFTER.match(self.text[end : end + 40]))
        return classify(self.model, " ".join(self.words[a : b + 1]), alone)


def scan(model: Model, text: str | None) -> list[Found]:
    """Licences named in a text, by start: first the windows that hold a template of the family that the model names in them,
    those with most of it first; then of the windows that the model names besides those that together speak most for licences. No two
    have words in common. A span ends with its last word, or, in one line, with the mark that ends the sentence there.

    The text is weighed slice by slice, and groups of windows that overlap are decided as soon as they're complete, so what is
    kept doesn't grow with it but for the findings.
    """
    state = _Scan(model, text or "")
    for at, part in _slices(text or ""):
        state.add(at, part)
        state.settle(state.first + len(state.words) - _SHARED)
    state.settle(state.first + len(state.words) + 1)
    return sorted(state.out, key=lambda f: (f.start, f.end))


def scan_licenses(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, `families` (confirmed ones, sorted, comma-joined), n_confirmed, n_unconfirmed, `spans`
    (family:start:end of the confirmed, comma-joined; code points, end exclusive), `named` (the same of the unconfirmed).

    The model weighs every window of every text; there's no gate of keywords before it, and no limit to a paragraph. Texts
    with a window that may name a family are scanned window by window. Null and empty texts have no licence. Rows are
    independent: repeated rows and null ids stay, an empty table gives no row. Other columns aren't read.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        # A look at the whole batch at once tells which texts name nothing; a long text is scanned slice by slice as it is.
        long = pc.fill_null(pc.greater(pc.binary_length(b.column("text")), _LONG), False)
        may = (may_name(shared.value, pc.if_else(long, "", b.column("text"))) | long.to_numpy(zero_copy_only=False)).tolist()
        found = [scan(shared.value, t.as_py()) if m else [] for t, m in zip(b.column("text"), may, strict=True)]
        sure, rest = ([[f for f in fs if f.confirmed == c] for fs in found] for c in (True, False))
        said = lambda fs: ",".join(f"{f.family}:{f.start}:{f.end}" for f in fs)
        columns = [[",".join(sorted({f.family for f in fs})) for fs in sure], list(map(len, sure)), list(map(len, rest)), list(map(said, sure)), list(map(said, rest))]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch([b.column("id"), *map(pa.array, columns, kinds)], ["id", "families", "n_confirmed", "n_unconfirmed", "spans", "named"])

    kind = narrow.schema["id"].dataType.simpleString()
    return in_batches(narrow, each, f"id {kind}, families string, n_confirmed long, n_unconfirmed long, spans string, named string").withColumnRenamed("id", id_col)
