"""Licence notices by a trained paragraph classifier, confirmed against templates.

A paragraph is a non-empty line.  Sparse counts of word one- and two-grams go through a softmax
over licence families and an unknown class.  It is trained on notices made from the templates
(cut, extended, with names filled in) and on corpus paragraphs and shuffled notice words as
unknown; a held-out part sets the temperature and the least probability that keeps unknown
paragraphs out.  A predicted family counts once the paragraph also shares enough two-grams
with a template of that family, one of them in no other family's templates.

A notice may be wrapped: where no line of a block of lines (up to WRAPPED characters each, none empty
between) is a notice, the lines are read as one paragraph too, a long block as overlapping stretches.

Scope: the families and notice texts of TEMPLATES; whole licence texts are known by the paragraphs
listed there.
"""

from __future__ import annotations

import json
import pickle
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import documents, windows

# fixed values: usual notice texts of each family
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
            "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "Released under the GNU GPL version 2 or later.", "Licensed under the GPL, version 3.", "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "You should have received a copy of the GNU Affero General Public License along with this program.", "Released under the AGPL version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Released under the LGPL version 2.1 or later.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "Proprietary": ["All rights reserved.", "Copyright (c) 2020 Example. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
FAMILIES = [*TEMPLATES, "unknown"]
UNKNOWN = len(TEMPLATES)
WORD = re.compile(r"[a-z0-9]+")
PARAGRAPH = re.compile(r"[^\n\r]+")
SAMPLE_ROWS = 2000                 # documents whose paragraphs train the unknown class, at most
SAMPLE_PARAGRAPHS = 4              # of each of them
WRAPPED = 120                      # characters of a line that may be part of a longer paragraph
BLOCK_WORDS = 400                  # of a wrapped paragraph, or of a stretch of a longer block
CONFIRM = 0.5                      # least share of a template's or the paragraph's two-grams in common
FALSE_RATE = 0.0005                # of held-out unknown paragraphs that may pass the threshold
FOUND = "doc_id long, paragraphs long, notices array<struct<family:string,start:long,end:long,probability:double>>"


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


VOCABULARY = {g: i for i, g in enumerate(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(WORD.findall(t.lower()))}))}
KNOWN_WORDS = {g for g in VOCABULARY if " " not in g}
OTHER, BIAS = len(VOCABULARY), len(VOCABULARY) + 1
TEMPLATE_PAIRS = {f: [set(zip(w, w[1:])) for w in (WORD.findall(t.lower()) for t in ts)] for f, ts in TEMPLATES.items()}
# what parts a family from its siblings: pairs that stand in its templates and in no other family's
OWN_PAIRS = {f: set().union(*ts) - set().union(*(t for g, us in TEMPLATE_PAIRS.items() if g != f for t in us)) for f, ts in TEMPLATE_PAIRS.items()}
# two words that stand side by side in no template make no feature, so a notice has a pair of these
PAIRS = {tuple(g.split(" ")) for g in VOCABULARY if " " in g}


def features(words: list[str]) -> dict[int, float]:
    """Sparse features: presence of template n-grams, the share of other words, a constant."""
    found = {VOCABULARY[g]: 1.0 for g in grams(words) if g in VOCABULARY}
    found[OTHER] = 3.0 * sum(w not in KNOWN_WORDS for w in words) / max(1, len(words))
    found[BIAS] = 1.0
    return found


@dataclass
class Classifier:
    weights: np.ndarray            # feature, family
    temperature: float = 1.0
    least: float = 0.5

    def probabilities(self, words: list[str]) -> np.ndarray:
        f = features(words)
        a = np.array(list(f.values())) @ self.weights[list(f)] / self.temperature
        e = np.exp(a - a.max())
        return e / e.sum()

    def family(self, paragraph: str) -> tuple[str, float] | None:
        """The confirmed family of a paragraph and its probability."""
        words = WORD.findall(paragraph.lower())
        pairs = set(zip(words, words[1:]))
        if not pairs & PAIRS:
            return None
        p = self.probabilities(words)
        best = int(p[:UNKNOWN].argmax())
        if p[best] < self.least:
            return None
        name = FAMILIES[best]
        if not pairs & OWN_PAIRS[name]:
            return None
        shares = (len(pairs & t) / min(len(pairs), len(t)) if len(pairs & t) > 1 or len(t) < 4 else 0.0 for t in TEMPLATE_PAIRS[name] if t)
        return (name, float(p[best])) if max(shares, default=0.0) >= CONFIRM else None


def _made(rng: random.Random, corpus: list[list[str]]) -> list[tuple[list[str], int]]:
    """Examples: notices of every family in variations, and unknown paragraphs."""
    out = []
    filler = [w for p in corpus for w in p] or ["lorem", "ipsum"]
    for k, (family, texts) in enumerate(TEMPLATES.items()):
        for text in texts:
            whole = WORD.findall(text.lower())
            out += [(whole, k)] * 3
            for _ in range(24):
                words = [w for w in whole if rng.random() > 0.05]
                cut = len(words) if len(words) < 12 else rng.randint(10, len(words))
                before = ["copyright", "c", str(rng.randint(1990, 2026)), rng.choice(filler)] if rng.random() < 0.2 and family != "Proprietary" else []
                out.append((before + words[:cut] + [rng.choice(filler) for _ in range(rng.choice([0, 0, 1, 3]))], k))
            for _ in range(12):     # the same words in disorder, or a few of them in other text, are no notice
                loose = rng.sample(whole, len(whole)) if rng.random() < 0.5 else rng.sample(whole, min(3, len(whole))) + [rng.choice(filler) for _ in range(10)]
                rng.shuffle(loose)
                out.append((loose, UNKNOWN))
    return out + [(p, UNKNOWN) for p in corpus]


def train(corpus: list[list[str]], steps: int = 300, rate: float = 0.2, decay: float = 1e-3) -> Classifier:
    """Fit on made notices and on unlabelled corpus paragraphs as unknown.

    Corpus paragraphs that share most of their two-grams with a template are left out of the unknown class.
    """
    rng = random.Random(11)
    known = [t for ts in TEMPLATE_PAIRS.values() for t in ts]
    plain = [w for w in corpus if w and not any(len(set(zip(w, w[1:])) & t) / max(1, min(len(w) - 1, len(t))) >= 0.3 for t in known)]
    examples = _made(rng, plain)
    rng.shuffle(examples)
    held, taught = examples[::5], [e for i, e in enumerate(examples) if i % 5]
    rows, columns, values = [], [], []
    for i, (words, _) in enumerate(taught):
        for c, v in features(words).items():
            rows.append(i), columns.append(c), values.append(v)
    rows, columns, values = np.array(rows), np.array(columns), np.array(values)
    gold = np.eye(len(FAMILIES))[[y for _, y in taught]]
    weight = 1 / gold.sum(0)[gold.argmax(1)]
    weight = (weight / weight.sum())[:, None]
    w, seen = np.zeros((BIAS + 1, len(FAMILIES))), np.full((BIAS + 1, len(FAMILIES)), 1e-8)
    for _ in range(steps):
        a = np.stack([np.bincount(rows, values * w[columns, k], len(taught)) for k in range(len(FAMILIES))], 1)
        e = np.exp(a - a.max(1, keepdims=True))
        d = (gold - e / e.sum(1, keepdims=True)) * weight
        g = np.stack([np.bincount(columns, values * d[rows, k], BIAS + 1) for k in range(len(FAMILIES))], 1) - decay / len(w) * w
        seen += g * g
        w += rate * g / np.sqrt(seen)
    model = Classifier(w)
    best = np.inf
    for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0):
        model.temperature = t
        loss = -np.mean([np.log(model.probabilities(x)[y] + 1e-12) for x, y in held])
        if loss < best:
            best, chosen = loss, t
    model.temperature = chosen
    wrong = sorted((model.probabilities(x)[:UNKNOWN].max() for x, y in held if y == UNKNOWN), reverse=True)
    model.least = max(0.5, wrong[int(FALSE_RATE * len(wrong))] + 1e-6) if wrong else 0.5
    model.least = min(model.least, 0.9)
    return model


def _paragraphs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for window in windows(batches):
        rows = []
        for text, seed in zip(window.column("text").to_pylist(), window.column("seed").to_pylist()):
            lines = PARAGRAPH.findall(text)
            for line in random.Random(seed).sample(lines, min(SAMPLE_PARAGRAPHS, len(lines))):
                rows.append(json.dumps(WORD.findall(line.lower())))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["words"])


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Classifier:
    """Train with paragraphs of the `rows` documents of smallest id hash as the unknown class."""
    docs, place = documents(docs), F.xxhash64("doc_id")
    last = docs.select(place.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return train([])
    found = docs.where(place <= last).limit(rows).select("text", place.alias("seed")).mapInArrow(_paragraphs, "words string").collect()
    return train(sorted(json.loads(r.words) for r in found))


def notices_of(text: str, classify) -> tuple[int, list[dict]]:
    """Number of lines that are not empty, and the notices of a text by place."""
    lines = list(PARAGRAPH.finditer(text))
    found: list[dict] = []
    block: list[re.Match] = []

    def add(start: int, end: int, got: tuple[str, float]) -> None:
        found.append({"family": got[0], "start": start, "end": end, "probability": got[1]})

    def close() -> None:
        """Lines that stand together and are no notices by themselves, as one paragraph; a longer block as
        stretches of BLOCK_WORDS words, each beginning half of that behind the last or where a notice ended."""
        n = [m[0].count(" ") + 1 for m in block]
        at = 0
        while len(block) - at > 1:
            end, words = at + 1, n[at]
            while end < len(block) and words + n[end] <= BLOCK_WORDS:
                words, end = words + n[end], end + 1
            got = classify(" ".join(m[0] for m in block[at:end])) if end - at > 1 else None
            if got is not None:
                add(block[at].start(), block[end - 1].end(), got)
            if end == len(block):
                break
            if got is not None:
                at = end
                continue
            at, passed = at + 1, n[at]
            while passed + n[at] <= BLOCK_WORDS // 2:
                at, passed = at + 1, passed + n[at]
        block.clear()

    for m in lines:
        got = classify(m[0])
        if block and (text.count("\n", block[-1].end(), m.start()) > 1 or got is not None):
            close()
        if got is not None:
            add(m.start(), m.end(), got)
        elif len(m[0]) <= WRAPPED and m[0].strip():
            block.append(m)
        else:
            close()
    close()
    return len(lines), found


def _scan(batches: Iterable[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    classify = pickle.loads(model).family
    kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
    for window in windows(batches):
        scanned = [notices_of(text, classify) for text in window.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([window.column("doc_id"), pa.array([n for n, _ in scanned], pa.int64()), pa.array([f for _, f in scanned], kind)], ["doc_id", "paragraphs", "notices"])


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, the number of paragraphs and all licence notices of each whole text, by place (code points).

    Null and empty texts have none; repeated rows are scanned each; further columns are left out.
    """
    return documents(docs).mapInArrow(partial(_scan, model=pickle.dumps(model)), FOUND)
