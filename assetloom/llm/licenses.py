"""Licence families of paragraphs: a trained classifier, confirmed against templates.

Paragraphs (lines, and blocks of lines) become sparse word n-grams; a multinomial logistic regression over the n-grams of the templates and
the share of words that no template knows gives a probability per family and for "unknown". A temperature calibrates
them on paragraphs that were not trained on, and a prediction stands only if a template of the family confirms it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public notices by licence family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "This project is available under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v2.0 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "CC": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Released under CC0 1.0 Universal.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "MPL": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "Proprietary": (
        "All rights reserved. No part of this work may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "This document is confidential and proprietary. Unauthorized copying, distribution or use is prohibited.",
    ),
}
FAMILIES = ("unknown", *TEMPLATES)
#: Paragraphs of the corpus that train and calibrate the unknown class; everything else covers all rows.
UNKNOWN_SAMPLE = 4000
#: Least calibrated probability, and least share of a template's word pairs found in the paragraph (or the reverse).
PROBABILITY, COVERAGE = 0.5, 0.6
#: Word pairs that a paragraph must have for the reverse: that it is a part of a template.
PART_PAIRS = 2
#: Least share of a line's word pairs in a family's templates for it to lie in a wrapped notice of that family.
WRAPPED = 0.5
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Words that name a family; n-grams alone cannot confirm one without such a word.
NAMES = {
    "MIT": {"mit", "hereby", "substantial"}, "Apache": {"apache", "apache-2.0"}, "GPL": {"gnu", "gpl", "gpl-3.0-or-later"},
    "CC": {"cc", "creative", "cc-by-4.0", "cc0", "by-nc", "by-sa"}, "BSD": {"bsd", "redistribution", "bsd-3-clause"},
    "MPL": {"mozilla", "mpl-2.0"}, "Proprietary": {"reserved", "confidential", "proprietary"},
}


def ngrams(words: list[str]) -> list[str]:
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


@dataclass
class Classifier:
    index: dict[str, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    temperature: float = 1.0
    words: frozenset[str] = frozenset()
    pairs: dict[str, list[frozenset[str]]] = field(default_factory=dict)

    def vector(self, words: list[str]) -> tuple[list[int], float]:
        """Features present, and the share of words that no template knows."""
        found = sorted({self.index[g] for g in ngrams(words) if g in self.index})
        return found, sum(w not in self.words for w in words) / max(1, len(words))

    def probabilities(self, words: list[str]) -> np.ndarray:
        found, strange = self.vector(words)
        z = (self.weight[found].sum(axis=0) / np.sqrt(max(1, len(found))) + strange * self.weight[-2] + self.weight[-1]) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def agreement(self, words: list[str], family: str) -> tuple[float, float]:
        """Best share of a template's word pairs that the paragraph has, and of the paragraph's that a template has."""
        mine = frozenset(zip(words, words[1:], strict=False))
        if not mine or NAMES[family].isdisjoint(words):
            return 0.0, 0.0
        shared = [(len(mine & t), len(t)) for t in self.pairs[family]]
        part = max((n / len(mine) for n, _ in shared), default=0.0) if len(mine) >= PART_PAIRS else 0.0
        return max((n / max(1, m) for n, m in shared), default=0.0), part

    def coverage(self, words: list[str], family: str) -> float:
        """Best agreement of the word pairs with a template: of the template's in the paragraph, or the reverse."""
        return max(self.agreement(words, family))

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """Family ("unknown" too), calibrated probability and coverage by a template of the family."""
        words = WORD.findall(paragraph.lower())
        if self.words.isdisjoint(words):
            return "unknown", 1.0, 0.0
        p = self.probabilities(words)
        k = int(p.argmax())
        if k == 0 or p[k] < PROBABILITY:
            return "unknown", float(p[0]), 0.0
        covered = self.coverage(words, FAMILIES[k])
        return (FAMILIES[k], float(p[k]), covered) if covered >= COVERAGE else ("unknown", float(p[0]), covered)


def _variants(text: str, rng: np.random.Generator) -> list[list[str]]:
    """A notice as it stands, with words lost, and amid foreign words."""
    words = WORD.findall(text.lower())
    out = [words]
    for _ in range(6):
        kept = [w for w in words if rng.random() > 0.12] or words
        noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(int(rng.integers(0, 6)))]
        out += [kept, noise[: len(noise) // 2] + kept + noise[len(noise) // 2:]]
    return out


def _parts(text: str, family: str, rng: np.random.Generator) -> list[list[str]]:
    """Parts of a notice that name the family: its sentences, and runs of words as wrapping leaves them."""
    whole = WORD.findall(text.lower())
    runs = [WORD.findall(x.lower()) for x in re.split(r"[.:;] ", text)]
    for _ in range(6):
        n = int(rng.integers(PART_PAIRS + 1, 16))
        at = int(rng.integers(0, max(1, len(whole) - n + 1)))
        runs.append(whole[at:at + n])
    return [w for w in runs if PART_PAIRS < len(w) < len(whole) and not NAMES[family].isdisjoint(w) for _ in range(3)]


def train(unknown: list[str], seed: int = 3, rounds: int = 300) -> Classifier:
    """Fit on variants and parts of the templates and on paragraphs of the corpus that name no licence."""
    rng = np.random.default_rng(seed)
    named = set().union(*NAMES.values()) | {"license", "licence", "licensed", "copyright"}
    rows: list[tuple[list[str], int]] = [(v, k) for k, f in enumerate(FAMILIES[1:], 1) for t in TEMPLATES[f] for v in [*_variants(t, rng), *_parts(t, f, rng)]]
    plain = [w for w in (WORD.findall(x.lower()) for x in unknown) if w and named.isdisjoint(w)]
    common = sorted({w for f in TEMPLATES.values() for t in f for w in WORD.findall(t.lower())} - named)
    plain += [list(rng.choice(common, int(rng.integers(1, 12)))) for _ in range(400)]  # ordinary words of notices, in no order
    rows += [(w, 0) for w in plain]
    rng.shuffle(rows)
    c = Classifier()
    grams = sorted({g for f in TEMPLATES.values() for t in f for g in ngrams(WORD.findall(t.lower()))})
    c.index = {g: i for i, g in enumerate(grams)}
    c.words = frozenset(g for g in grams if " " not in g)
    c.pairs = {f: [frozenset(zip(w, w[1:], strict=False)) for w in (WORD.findall(t.lower()) for t in ts)] for f, ts in TEMPLATES.items()}
    x = np.zeros((len(rows), len(grams) + 2), np.float32)
    for i, (words, _) in enumerate(rows):
        found, strange = c.vector(words)
        x[i, found] = 1.0 / np.sqrt(max(1, len(found)))
        x[i, -2:] = strange, 1.0
    y = np.eye(len(FAMILIES), dtype=np.float32)[[k for _, k in rows]]
    cut = len(rows) * 4 // 5
    w = np.zeros((x.shape[1], len(FAMILIES)), np.float32)
    scale = np.full_like(w, 1e-6)
    for _ in range(rounds):
        z = x[:cut] @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = x[:cut].T @ (p - y[:cut]) / cut + 1e-5 * w
        scale += grad ** 2
        w -= 0.5 * grad / np.sqrt(scale)
    c.weight = w.astype(float)
    z = x[cut:] @ w  # temperature by held-out likelihood
    best = (np.inf, 1.0)
    for t in np.geomspace(0.25, 4.0, 33):
        s = z / t
        loss = float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - (s * y[cut:]).sum(axis=1)).mean())
        best = min(best, (loss, float(t)))
    c.temperature = best[1]
    return c


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = UNKNOWN_SAMPLE) -> Classifier:
    """Train with at most ``sample`` paragraphs of the corpus (one per document, by hash) as examples of "unknown"."""
    order = F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.lit("licence"))
    share = min(1.0, 2.0 * sample / max(1, docs.count()))  # about twice the sample is hashed in, so few rows reach the driver
    drawn = (docs.select(order.alias("o"), F.col(f"`{text}`").alias("text")).where("text is not null and text <> ''")
             .where(F.pmod("o", F.lit(1_000_000)) < int(share * 1_000_000) + 1))
    lines = F.split("text", "\n")
    line = F.element_at(lines, (F.pmod(F.shiftright("o", 20), F.size(lines)) + 1).cast("int"))
    rows = drawn.select("o", line.alias("p")).orderBy("o", "p").limit(sample).collect()
    return train([r.p for r in rows])


def blocks(lines: list[list[str]], apart: set[int]) -> Iterator[range]:
    """Runs of two or more lines with words, between lines without a word and those set ``apart``."""
    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i] or i in apart:
            if i - start > 1:
                yield range(start, i)
            start = i + 1


def wrapped(lines: list[list[str]], block: range, pairs: set) -> Iterator[range]:
    """Runs of two or more lines of the block that agree with the pairs; pairs over a line break count for both lines."""
    start = block.start
    for i in range(block.start, block.stop + 1):
        near = False
        if i < block.stop:
            w = [*(lines[i - 1][-1:] if i > block.start else ()), *lines[i], *(lines[i + 1][:1] if i + 1 < block.stop else ())]
            near = sum(p in pairs for p in zip(w, w[1:], strict=False)) >= WRAPPED * (len(w) - 1)
        if not near:
            if i - start > 1:
                yield range(start, i)
            start = i + 1


def notices(c: Classifier, text: str, memo: dict | None = None) -> list[dict]:
    """Notices of a text: lines, and notices wrapped over several lines, by their first line.

    A line that holds a whole notice stands for itself. The other lines are read as blocks between blank lines: the runs
    that agree with a family's templates, and the block as it is. What is confirmed there takes in the lines of its
    family that hold only a part.
    """
    memo = {} if memo is None else memo
    lines = [WORD.findall(x) for x in text.lower().split("\n")]
    naming = {w: f for f, ws in NAMES.items() for w in ws}
    found: list[dict] = []
    apart: set[int] = set()
    for i, words in enumerate(lines):
        if naming.keys().isdisjoint(words):  # without a naming word no template confirms, whatever the classifier says
            continue
        key = " ".join(words)
        if key not in memo:
            if len(memo) > 50_000:
                memo.clear()
            family, p, covered = c.classify(key)
            memo[key] = family, p, covered, family != "unknown" and c.agreement(words, family)[0] >= COVERAGE
        family, p, covered, whole = memo[key]
        if family != "unknown":
            found.append({"paragraph": i, "family": family, "probability": p, "coverage": covered})
        if whole:
            apart.add(i)
    for block in blocks(lines, apart):
        named = {naming[w] for i in block for w in lines[i] if w in naming}
        runs = [(r, f) for f in FAMILIES[1:] if f in named for r in wrapped(lines, block, set().union(*c.pairs[f]))]
        for run, wanted in [*runs, (block, None)] if named else ():
            family, p, covered = c.classify(" ".join(w for i in run for w in lines[i]))
            if family == "unknown" or wanted not in (None, family):
                continue
            if wanted is None and any(x["family"] == family and x["paragraph"] in block for x in found):
                continue  # already found more closely
            found = [x for x in found if x["family"] != family or x["paragraph"] not in run or x["paragraph"] in apart]
            found.append({"paragraph": run.start, "family": family, "probability": p, "coverage": covered})
    return sorted(found, key=lambda x: (x["paragraph"], FAMILIES.index(x["family"])))


def _scanner(c: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, float, float, bool]] = {}
        known = re.compile("|".join(sorted(map(re.escape, set().union(*NAMES.values())), key=len, reverse=True)))
        for batch in batches:
            out: list[list[dict]] = []
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py() or ""
                out.append(notices(c, text, memo) if known.search(text.lower()) else [])
            kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("coverage", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], names=[*batch.schema.names[:-1], "licences"])
    return run


def scan(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """``row`` (all columns) and ``licences``: paragraph number, family, probability and coverage of every notice.

    One pass, no shuffle. A paragraph is a line, or a block of lines numbered by its first one. Null, empty and other texts without a notice have an empty list.
    Repeated rows get equal lists; texts are read whole, paragraph by paragraph.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = "array<struct<paragraph: int, family: string, probability: double, coverage: double>>"
    return rows.mapInArrow(_scanner(classifier), f"row {rows.schema['row'].dataType.simpleString()}, licences {kind}")
