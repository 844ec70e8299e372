"""Licence scans: a trained paragraph classifier whose predictions templates confirm.

A paragraph is the text between lines without words (blank ones, and those of comment marks or rules alone), line ends and comment marks being
white space, so that hard-wrapped notices are whole; a longer one is cut into windows of 48 words (half overlapping). The lines of a paragraph are scanned on their own too, so that short notices
on adjacent lines do not blur one another. Its words (lower case, without ASCII punctuation) give 1- to 3-grams; those that occur in licence templates are the features of a sparse
multinomial logistic regression over the licence families and a class `unknown`. It is trained here: positives
are the templates' notices with words dropped, replaced, cropped and set in other text, negatives are
paragraphs of the corpus (those of at most `sample` documents, smallest hashes first) and shuffled template
words. The probabilities are calibrated by a temperature fitted on paragraphs held out of training, and the
unknown class by the least threshold (0.5 at least) that lets at most one in MISTAKES of the held-out negatives pass. A prediction
counts only if the paragraph holds at least `confirm` of the word n-grams of one of that family's notices.

A window of several lines is left out if a line in it gives the same family with no smaller share.

Scoring is one pass over whole texts. A paragraph without any template n-gram has the bias's score, which is unknown.

Defined results: null or blank texts have no licence. Repeated rows are scored alike. An empty table trains on the
templates and shuffled words alone. Of equally likely families the alphabetically first is predicted. Texts of any length are scanned whole.
Columns besides the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hash_sample
from .hashing import shingles, word_hashes

HALF = 24
#: One in so many held-out negatives may pass the threshold.
MISTAKES = 200
#: The notices by which each family is recognised.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["GNU Affero General Public License", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the GNU Affero General Public License v3.0", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Use of this source code is governed by a BSD-style license", "Released under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Released under CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License", "Licensed under the Eclipse Public License 2.0"],
    "gpl": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "Licensed under the GNU General Public License v3.0", "Released under the GPL-3.0 license", "Licensed under GPL-3.0", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Licensed under the ISC License"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Licensed under the GNU Lesser General Public License v2.1", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher", "Copyright. All rights reserved", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
}
_PLAIN = bytes(32 if 32 < c < 127 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(_PLAIN)


def _grams(h: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([shingles(h, k) for k in (1, 2, 3) if len(h) >= k] or [h]))


class LicenceModel:
    def __init__(self) -> None:
        self.families = ["unknown", *sorted(TEMPLATES)]
        notices = [(f, t) for f in self.families[1:] for t in TEMPLATES[f]]
        self.words = [_plain(t).split() for _, t in notices]
        self.of = np.array([self.families.index(f) for f, _ in notices])
        grams = [_grams(word_hashes([b" ".join(w)])[0]) for w in self.words]
        self.features = np.unique(np.concatenate(grams))
        self.notice = np.zeros((len(notices), len(self.features)), np.float32)
        for i, g in enumerate(grams):
            self.notice[i, np.searchsorted(self.features, g)] = 1
        self.size = self.notice.sum(1)
        self.weight, self.bias = np.zeros((len(self.features), len(self.families)), np.float32), np.zeros(len(self.families), np.float32)
        self.temperature, self.threshold = 1.0, 0.5

    def lookup(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the n-grams are features, and which features these are."""
        at = np.minimum(np.searchsorted(self.features, grams), len(self.features) - 1)
        hit = np.flatnonzero(self.features[at] == grams)
        return hit, at[hit]

    def rows(self, passages: list[bytes]) -> np.ndarray:
        """Feature vectors of paragraphs."""
        x = np.zeros((len(passages), len(self.features)), np.float32)
        h, at = word_hashes(passages)
        for i in range(len(passages)):
            x[i, self.lookup(_grams(h[at[i] : at[i + 1]]))[1]] = 1
        return x

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        z = np.asarray(z, np.float64) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, negatives: list[bytes], copies: int = 24, epochs: int = 60, seed: int = 11) -> LicenceModel:
        r = np.random.default_rng(seed)
        filler = [w for p in negatives[:400] for w in p.split()] or [b"lorem", b"ipsum", b"dolor", b"sit"]
        every = [w for words in self.words for w in words]
        texts, labels = [], []
        for words, label in zip(self.words, self.of, strict=True):
            for c in range(copies):
                kept = [w for w in words if c == 0 or r.random() > 0.08]
                if c % 4 == 3 and len(kept) > 12:
                    cut = int(r.integers(0, len(kept) // 4 + 1))
                    kept = kept[cut:] if r.random() < 0.5 else kept[: len(kept) - cut]
                if c % 2:
                    pick = lambda: [filler[i] for i in r.integers(0, len(filler), int(r.integers(0, HALF + 1)))]
                    kept = pick() + kept + pick()
                texts.append(b" ".join(kept)), labels.append(label)
        shuffled = [b" ".join(every[i] for i in r.integers(0, len(every), int(r.integers(3, 40)))) for _ in range(600)]
        x = np.concatenate([self.rows(texts), self.rows(negatives + shuffled + [b""])])
        # A corpus paragraph that holds a notice is no negative.
        share = x[len(texts) :] @ self.notice.T / self.size
        keep = np.concatenate([np.ones(len(texts), bool), share.max(axis=1) < 0.6])
        x, y = x[keep], np.concatenate([np.array(labels), np.zeros(len(share), np.int64)])[keep]
        test = r.random(len(y)) < 0.2
        tx, ty = x[~test], y[~test]
        m, v, step = np.zeros_like(self.weight), np.zeros_like(self.weight), 0
        for _ in range(epochs):
            order = r.permutation(len(ty))
            for i in range(0, len(order), 256):
                take, step = order[i : i + 256], step + 1
                p = self.probabilities(tx[take] @ self.weight + self.bias)
                p[np.arange(len(take)), ty[take]] -= 1
                p = (p / len(take)).astype(np.float32)
                g = tx[take].T @ p + 1e-5 * self.weight
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                self.weight -= (0.05 * m / (np.sqrt(v) + 1e-6) / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)).astype(np.float32)
                self.bias -= 0.5 * p.sum(0)
        z = x[test] @ self.weight + self.bias
        best = np.inf
        for t in np.geomspace(0.5, 8, 25):
            self.temperature = float(t)
            loss = -np.log(self.probabilities(z)[np.arange(len(z)), y[test]] + 1e-12).mean()
            if loss < best:
                best, chosen = loss, self.temperature
        self.temperature = chosen
        wrong = 1 - self.probabilities(z)[y[test] == 0, 0]
        self.threshold = float(max(0.5, np.sort(wrong)[-1 - len(wrong) // MISTAKES] + 1e-9 if len(wrong) else 0.5))
        return self

    def scan(self, texts: list[str | None], confirm: float) -> list[list[tuple[str, float, float, int, int]]]:
        """For each text (family, probability, share of the notice, first word of the window, its words), in order."""
        lines, owner = [], []
        for i, t in enumerate(texts):
            if t:
                part = t.split("\n")
                lines += part
                owner += [i] * len(part)
        out: list[list] = [[] for _ in texts]
        if not lines:
            return out
        h, at = word_hashes([_plain(x) for x in lines])
        owner, n = np.array(owner), np.diff(at)
        hits = [(k, *self.lookup(shingles(h, k))) for k in (1, 2, 3) if len(h) >= k]
        base = np.concatenate([[0], np.cumsum(np.bincount(owner, n, minlength=len(texts)))]).astype(np.int64)
        opens = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]) | (n == 0))
        several = np.add.reduceat((n > 0).astype(np.int64), opens) > 1
        alone: dict[tuple[int, str], list[tuple[int, int, float]]] = {}
        for begin, words, family, prob, share in self._windows(hits, at, np.ones(len(n), bool), confirm):
            text = int(np.searchsorted(base, begin, side="right")) - 1
            out[text].append((family, prob, share, begin - int(base[text]), words))
            alone.setdefault((text, family), []).append((begin, words, share))
        for begin, words, family, prob, share in self._windows(hits, np.concatenate([at[opens], at[-1:]]), several, confirm):
            text = int(np.searchsorted(base, begin, side="right")) - 1
            near = alone.get((text, family), [])
            near = near[bisect_left(near, (begin,)) : bisect_left(near, (begin + words,))]
            if not any(a + w <= begin + words and s >= share for a, w, s in near):
                out[text].append((family, prob, share, begin - int(base[text]), words))
        return [sorted(x, key=lambda f: (f[3], f[4])) for x in out]

    def _windows(self, hits: list[tuple[int, np.ndarray, np.ndarray]], at: np.ndarray, taken: np.ndarray, confirm: float) -> Iterator[tuple[int, int, str, float, float]]:
        """(first word, words, family, probability, share) of the confirmed windows of the taken parts, which begin at the words `at`."""
        n = np.diff(at)
        of = np.repeat(np.arange(len(n)), n)
        windows = np.maximum(1, -(-n // HALF) - 1)  # of a part: window w covers its words from w * HALF
        first = np.concatenate([[0], np.cumsum(windows)])
        keys = []
        for k, hit, feature in hits:
            whole = (of[hit] == of[np.minimum(hit + k - 1, len(of) - 1)]) & taken[of[hit]]
            hit, feature = hit[whole], feature[whole]
            place = hit - at[of[hit]]
            for back in (0, 1):  # a word's own stride, and the one before it
                w = place // HALF - back
                inside = (w >= 0) & (w < windows[of[hit]]) & (place + k <= (w + 2) * HALF)
                keys.append((first[of[hit]] + w)[inside] * len(self.features) + feature[inside])
        keys = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        if not len(keys):
            return
        window, feature = keys // len(self.features), keys % len(self.features)
        starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        z = np.add.reduceat(self.weight[feature], starts, axis=0) + self.bias
        p = self.probabilities(z)
        label = p[:, 1:].argmax(axis=1) + 1
        prob = p[np.arange(len(p)), label]
        ends = np.concatenate([starts[1:], [len(keys)]])
        for i in np.flatnonzero((prob >= self.threshold) & (p[:, 0] < 1 - self.threshold)):
            mine = np.flatnonzero(self.of == label[i])
            share = float((self.notice[np.ix_(mine, feature[starts[i] : ends[i]])].sum(1) / self.size[mine]).max())
            if share >= confirm:
                w = int(window[starts[i]])
                part = int(np.searchsorted(first, w, side="right")) - 1
                begin = int(at[part] + (w - first[part]) * HALF)
                yield begin, int(min(2 * HALF, at[part + 1] - begin)), self.families[label[i]], float(prob[i]), share


def learn_licences(docs: DataFrame, text_col: str = "text", sample: int = 400, passages: int = 3000) -> LicenceModel:
    """Fit on the templates, with at most `passages` paragraphs of at most `sample` documents as negatives."""
    chosen = hash_sample(docs.select(F.col(text_col).cast("string").alias("text")).where("length(text) > 0"), [F.col("text")], sample, docs.count())
    lines = chosen.select(F.explode(F.array_union(F.split("text", "\n"), F.split("text", r"\n\s*\n"))).alias("line")).where("length(line) > 0").orderBy(F.xxhash64("line"), "line").limit(passages)
    parts = [b" ".join(words[i : i + 2 * HALF]) for r in lines.collect() for words in [_plain(r.line).split()] for i in range(0, len(words), 2 * HALF)]
    return LicenceModel().fit(parts[:passages])


def scan_licences(docs: DataFrame, model: LicenceModel, confirm: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, families (sorted, comma-joined), n_passages, probability, template_share, passages: one row per input row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # its size is that of the templates
    kind = docs.schema[id_col].dataType.simpleString()
    fields = pa.struct([("family", pa.string()), ("probability", pa.float64()), ("template_share", pa.float64()), ("first_word", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.scan(b.column(1).to_pylist(), confirm)
            cols = [
                pa.array([",".join(sorted({x[0] for x in f})) for f in found]), pa.array([len(f) for f in found], pa.int64()), pa.array([max((x[1] for x in f), default=0.0) for f in found]), pa.array([max((x[2] for x in f), default=0.0) for f in found]),
                pa.array([[dict(zip(("family", "probability", "template_share", "first_word", "words"), x, strict=True)) for x in f] for f in found], pa.list_(fields)),
            ]
            yield pa.record_batch([b.column(0), *cols], [id_col, "families", "n_passages", "probability", "template_share", "passages"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, families string, n_passages long, probability double, template_share double, passages array<struct<family:string,probability:double,template_share:double,first_word:long,words:long>>")
