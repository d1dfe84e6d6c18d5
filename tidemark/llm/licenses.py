"""License scans: a trained paragraph classifier with template confirmation.

Sparse word 1- and 2-gram logistic regression over license families and an unknown class. It is trained
on spans of public license wording and on a bounded sample of the corpus' own paragraphs; a
temperature and a threshold set on held-out rows calibrate it. A prediction stands only if the
paragraph also shares enough word pairs with a template of that family, or, being short itself, holds a short notice of it whole.
A paragraph is a line, or a run of lines as short as wrapped text has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C

# Public license wording, by family.
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License 2.0",
        "License: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD License",
        "License: BSD",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "License: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under the Creative Commons BY-NC license: non-commercial use only, with attribution.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "License: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "License: CC-BY-SA-4.0",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPL version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU GPL",
        "GPLv2",
        "GPLv3",
        "License: GPL",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "GNU LGPL",
        "LGPLv3",
        "License: LGPL",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "License: MIT",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "MPL 2.0",
        "License: MPL",
    ],
}
UNKNOWN = "unknown"
WORD = re.compile(r"[a-z0-9]+")
#: Paragraphs of the corpus that the unknown class is learnt from, at most; half are held out to calibrate.
SAMPLE_PARAGRAPHS = 4_000
#: Least share of the shorter side's word pairs that a paragraph and a template of its family have in common.
CONFIRM = 0.6
#: Words of a template that counts as a short notice, and of a paragraph that such a notice confirms.
SHORT_NOTICE, SHORT_PARAGRAPH = 5, 8
#: Characters of a line up to which it may be one of a wrapped paragraph.
WRAPPED = 100
#: Share of held-out unknown paragraphs that may pass the threshold.
FALSE_RATE = 0.001


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass
class Model:
    families: list[str]
    index: dict[str, int]
    weights: np.ndarray  # a row for each gram, then the bias; a column for each family, then unknown
    temperature: float
    threshold: float
    pairs: dict[str, list[set[str]]]  # word pairs of each family's templates
    notices: dict[str, list[str]]  # each family's templates of SHORT_NOTICE words at most

    def probabilities(self, found: set[str]) -> np.ndarray:
        rows = [i for g in found if (i := self.index.get(g)) is not None]
        z = (self.weights[rows].sum(0) + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def classify(self, paragraph: str) -> tuple[str, float] | None:
        """Family and probability, or None for the unknown class and for what no template confirms."""
        words = WORD.findall(paragraph.lower())
        at = [i for i, w in enumerate(words) if w in self.index]
        if not at:  # no gram has a weight, as a pair has one only if both its words have
            return None
        p = self.probabilities({*(words[i] for i in at), *(f"{words[i]} {words[j]}" for i, j in zip(at, at[1:], strict=False) if j == i + 1)})
        best = int(p[:-1].argmax())
        if p[best] < self.threshold or p[best] < p[-1]:
            return None
        return (self.families[best], float(p[best])) if self.confirmed(words, self.families[best]) else None

    def confirmed(self, words: list[str], family: str) -> bool:
        own, line = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}, f" {' '.join(words)} "
        if len(words) <= SHORT_PARAGRAPH and any(f" {n} " in line for n in self.notices[family]):
            return True
        return any(len(own & t) >= CONFIRM * min(len(own), len(t)) and len(own & t) >= min(3, len(t)) for t in self.pairs[family])


def _rows(rng: np.random.Generator) -> list[tuple[set[str], int]]:
    """Training rows: every template, spans of it, and copies that lose or gain a few words."""
    out = []
    noise = [w for ts in TEMPLATES.values() for t in ts for w in WORD.findall(t.lower())]
    for k, templates in enumerate(TEMPLATES.values()):
        for t in templates:
            words = WORD.findall(t.lower())
            out += [(grams(words), k)] * 4
            for _ in range(12):
                n = int(rng.integers(max(1, min(len(words), 5)), len(words) + 1))
                a = int(rng.integers(0, len(words) - n + 1))
                kept = [w for w in words[a : a + n] if rng.random() > 0.1]
                extra = [noise[i] for i in rng.integers(0, len(noise), int(rng.integers(0, 2)))]
                if len(kept) * 2 >= len(words):  # shorter spans fit several families
                    out.append((grams(kept + extra), k))
    return out


def train(paragraphs: list[str], seed: int = 7) -> Model:
    """A model from TEMPLATES and sampled corpus paragraphs (those close to a template are left out)."""
    rng, families = np.random.default_rng(seed), list(TEMPLATES)
    cut = {f: [WORD.findall(t.lower()) for t in ts] for f, ts in TEMPLATES.items()}
    notices = {f: [" ".join(w) for w in ts if len(w) <= SHORT_NOTICE] for f, ts in cut.items()}
    pairs = {f: [{g for g in grams(w) if " " in g} for w in ts if len(w) > SHORT_NOTICE] for f, ts in cut.items()}
    every = set().union(*(t for ts in pairs.values() for t in ts))
    clean = [g for p in paragraphs if len((g := grams(WORD.findall(p.lower()))) & every) < 3]
    clean = [clean[i] for i in rng.permutation(len(clean))]  # the halves are alike
    half = len(clean) // 2
    data = _rows(rng) + [(g, len(families)) for g in clean[:half]] + [(set(), len(families))] * 20
    vocabulary = set().union(*(g for g, k in data if k < len(families)))
    index = {g: i for i, g in enumerate(sorted(vocabulary))}
    rows = [np.array([index[g] for g in found if g in index] + [len(index)], np.int64) for found, _ in data]
    labels = np.array([k for _, k in data])
    w, step = np.zeros((len(index) + 1, len(families) + 1)), np.full((len(index) + 1, 1), 1e-8)
    for _ in range(30):  # AdaGrad
        for i in rng.permutation(len(rows)):
            z = w[rows[i]].sum(0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step[rows[i], 0] += (p**2).sum()
            w[rows[i]] -= 0.3 * (p + 1e-4 * w[rows[i]]) / np.sqrt(step[rows[i]])
    model = Model(families, index, w, 1.0, 0.5, pairs, notices)
    held = _rows(np.random.default_rng(seed + 1)) + [(g, len(families)) for g in clean[half:]]  # spans and copies that training hasn't drawn

    def loss(t: float) -> float:
        model.temperature = t
        return -sum(np.log(model.probabilities(g)[k] + 1e-12) for g, k in held)

    model.temperature = min((0.5, 1.0, 2.0, 4.0), key=loss)
    scores = sorted(float(model.probabilities(g)[:-1].max()) for g in clean[half:])
    model.threshold = max(0.5, scores[int((1 - FALSE_RATE) * (len(scores) - 1))]) if scores else 0.5
    return model


def sample_paragraphs(docs: DataFrame, *, text_col: str = "text", limit: int = SAMPLE_PARAGRAPHS) -> list[str]:
    """About limit paragraphs, picked by their hashes; the bound is on what the classifier is trained on, not on what it scans.

    The share to pick comes from a count of all lines, so no task returns more than its share.
    """
    n = docs.agg(F.coalesce(F.sum(F.size(F.split(text_col, "\n"))), F.lit(0)).alias("n")).collect()[0]["n"]
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("p")).where(F.length(F.trim("p")) > 0)
    picked = lines.where(F.pmod(F.xxhash64("p"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, limit / max(1, n)))))
    return sorted(r["p"] for r in picked.groupBy("p").agg(F.count("*")).orderBy(F.xxhash64("p"), "p").limit(2 * limit).collect())


def scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_paragraphs, n_licensed (long), families, findings, max_score.

    Paragraphs are lines with a character that is no white space, numbered from 0 among all
    lines; runs of such lines of WRAPPED characters at most are also read as one, and found at their first line if no line of
    them is found alone. families are distinct and sorted, findings are line:family:score, both comma-joined.
    A null or empty text has none (max_score 0); repeated rows and null ids give a row each.
    """
    own = T._parse_datatype_string("n_paragraphs long, n_licensed long, families string, findings string, max_score double").fields
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *own])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(text: str | None) -> tuple:
        lines = [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip()]
        found = [(i, *c) for i, x in lines if (c := shared.value.classify(x))]
        alone, k = {i for i, *_ in found}, 0
        while k < len(lines):
            end = k
            while end < len(lines) and lines[end][0] == lines[k][0] + end - k and len(lines[end][1]) <= WRAPPED:
                end += 1
            if end - k > 1 and alone.isdisjoint(i for i, _ in lines[k:end]) and (c := shared.value.classify(" ".join(x for _, x in lines[k:end]))):
                found.append((lines[k][0], *c))
            k = max(end, k + 1)
        found.sort()
        return len(lines), len(found), ",".join(sorted({f for _, f, _ in found})), ",".join(f"{i}:{f}:{p:.3f}" for i, f, p in found), max((p for _, _, p in found), default=0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([one(t) for t in batch["__text"]], columns=[f.name for f in own])
            out.insert(0, id_col, batch[id_col].values)
            yield out

    C.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInPandas(run, schema)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return scan(docs, train(sample_paragraphs(docs)))
