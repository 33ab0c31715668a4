"""License scans: a trained paragraph classifier with an unknown class, confirmed by template comparison.

Paragraphs are the lines of a text, and the runs of consecutive non-blank lines as wholes (licence headers are wrapped). Those that are
too long to be judged as a whole are judged in overlapping windows of several sizes, and what overlapping windows find is merged. Hashed word
unigrams and bigrams enter a multinomial logistic regression over licence families, `unknown` (licences of no family here) and `none`.
Its probabilities are calibrated by a temperature fitted on held-out examples; a paragraph whose best family stays under `least`, or under
what the model gives to licences that it has never seen, is unknown. A family that is predicted is confirmed only if enough of the word
bigrams of one of its templates stand in the paragraph, no template of a like family stands there as well, and no word is put inside
the name (GNU Affero General, BY-ND 4.0); else it is unknown too. So a licence of another family is reported as unknown, or not at all.

Training examples are made by rule from the templates (cut, shuffled at the edges, with words dropped or put in) and from ordinary
prose that talks of licences; other examples can be passed in. Null and empty texts have no paragraphs, and an empty table gives an
empty result. Whole texts are read, of any length; memory is about 120 bytes a word of one text, and time grows with its words and
findings. Of families with the same probability the first listed counts; a probability or overlap at its bar is enough. Repeated rows
and paragraphs count each time. Columns besides id and text are not read.
"""

from __future__ import annotations

import itertools
import random
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import slices, utf8
from tickloom.llm.textvec import ngram_hashes, plain, word_hashes

#: Characteristic wording of the licence families, and their SPDX lines.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0"),
    "mit": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "This project is licensed under the terms of the MIT license", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "SPDX-License-Identifier: MIT"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "lgpl": ("This work is licensed under the GNU Lesser General Public License, version 3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Lesser General Public License along with this library.", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only"),
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Affero General Public License along with this program.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License", "SPDX-License-Identifier: ISC"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Released under the Unlicense", "SPDX-License-Identifier: Unlicense"),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "Licensed under the Eclipse Public License, version 2.0", "SPDX-License-Identifier: EPL-2.0"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"),
    "cc0": ("To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "reserved": ("All rights reserved", "Copyright (c) 2020 The Authors. All rights reserved.", "Unauthorized copying of this file, via any medium is strictly prohibited"),
}
#: Prose that is not a licence.
PROSE = ("the driver must carry a valid license at all times", "she got her fishing license last spring", "the terms of the agreement were never made public", "version 3 of the program was released in march", "the public library is open under new rules", "a copy of the file was obtained by the general", "all rights of way are shown on the map", "he reserved a table for four", "work on the foundation was free of charge", "the software is distributed in source and binary form", "permission to land was granted", "the university of berkeley and mit work together", "apache helicopters were seen over the valley", "creative minds share common ground", "commercial use of the land is permitted", "use of the source is governed by the state", "licensed doctors only", "and the of to in that was with for this are from which had on a an it is be by as at")
#: Licences of no family here. Those of odd places train the unknown class, the others set how sure the model has to be.
OTHERS = ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable", "Licensed under the Zlib license", "Licensed under the European Union Public Licence, version 1.2", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "Distributed under the Boost Software License, Version 1.0", "This Font Software is licensed under the SIL Open Font License, Version 1.1", "You can redistribute it and/or modify it under the terms of the Artistic License 2.0", "The contents of this file are subject to the Common Development and Distribution License", "Do what you want to public license, everyone is permitted to copy and distribute verbatim copies", "Licensed under the Python Software Foundation License, version 2", "Licensed under the Open Database License v1.0", "Use of this software is subject to the Business Source License 1.1", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: OFL-1.1", "SPDX-License-Identifier: EUPL-1.2", "This program is licensed under the Server Side Public License, version 1", "Licensed under the Microsoft Public License", "You may use this file under the terms of the Academic Free License version 3.0", "Released under the Common Public Attribution License", "Licensed under the Beerware License", "Licensed under the Elastic License 2.0", "This work is licensed under the Free Art License 1.3", "Licensed under the PostgreSQL License")
BUCKETS = 1 << 16
FAMILIES = ("none", "unknown", *TEMPLATES)


def _grams(words: np.ndarray) -> np.ndarray:
    return np.concatenate([words, ngram_hashes(words, 2)]) % np.uint64(BUCKETS)


def _words(text: str) -> np.ndarray:
    data, at = utf8(pa.array([text]))
    return word_hashes(plain(data), at)[0]


def examples(seed: int = 5, per_family: int = 120) -> list[tuple[str, str]]:
    """(family, paragraph) by rule."""
    rng = random.Random(seed)
    filler = " ".join(PROSE).split()
    noise = lambda k: [rng.choice(filler) if rng.random() < 0.7 else "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(k)]
    out = []
    for family, texts in TEMPLATES.items():
        for _ in range(per_family):
            words = rng.choice(texts).split()
            if len(words) > 12 and rng.random() < 0.5:
                lo = rng.randint(0, len(words) // 3)
                words = words[lo : lo + rng.randint(2 * len(words) // 3, len(words))]
            words = [w for w in words if rng.random() > 0.04]
            out.append((family, " ".join(noise(rng.choice([0, 0, 0, 3, 8])) + words + noise(rng.choice([0, 0, 0, 3, 8])))))
    for _ in range(2 * per_family):  # a licence by another name
        words = rng.choice(OTHERS[1::2]).split()
        if rng.random() < 0.5:
            words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))).title() if w[:1].isupper() and k and rng.random() < 0.7 and w not in ("License", "License,", "Public") else w for k, w in enumerate(words)]
        out.append(("unknown", " ".join(noise(rng.choice([0, 0, 0, 3, 8])) + words + noise(rng.choice([0, 0, 0, 3, 8])))))
    for _ in range(3 * per_family):
        out.append(("none", " ".join(rng.choice(PROSE).split()[rng.randint(0, 2) :] + noise(rng.randint(0, 40)))))
        out.append(("none", " ".join(noise(rng.randint(1, 60)))))
        texts = rng.choice(list(TEMPLATES.values()))
        bag = rng.choice(texts).split()
        rng.shuffle(bag)
        out.append(("none", " ".join(noise(rng.randint(2, 9)) + bag[: rng.randint(1, 3)] + noise(rng.randint(5, 30)))))
    rng.shuffle(out)
    return out


class LicenseModel:
    """Weights by bucket and family, a temperature, and the templates' bigrams."""

    def __init__(self, train: list[tuple[str, str]] | None = None, steps: int = 60, rate: float = 2.0, ridge: float = 1e-4):
        train = examples() if train is None else train
        rows = [np.unique(_grams(_words(t))).astype(np.int64) for _, t in train]
        y = np.array([FAMILIES.index(f) for f, _ in train])
        held = np.arange(len(rows)) % 5 == 0
        used = np.unique(np.concatenate([r for r, h in zip(rows, held, strict=True) if not h]))
        self.weights = np.zeros((BUCKETS, len(FAMILIES)), np.float32)
        self.bias = np.zeros(len(FAMILIES))
        at = [np.searchsorted(used, np.intersect1d(r, used)) for r in rows]
        w, b = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
        row = np.repeat(np.arange(len(at)), [len(a) for a in at])
        col = np.concatenate(at)
        scale = 1 / np.sqrt(np.maximum(1, np.array([len(a) for a in at])))
        learn = ~held[row]
        r1, c1 = row[learn], col[learn]
        target = np.eye(len(FAMILIES))[y]

        filled = np.flatnonzero([len(x) > 0 for x in at])
        row_at = np.concatenate([[0], np.cumsum([len(x) for x in at])])[filled]
        by_col = np.argsort(c1, kind="stable")
        r1, cols, col_at = r1[by_col], *np.unique(c1[by_col], return_index=True)

        def logits():
            z = np.zeros((len(at), len(FAMILIES)))
            z[filled] = np.add.reduceat(w[col], row_at)
            return z * scale[:, None] + b

        for _ in range(steps):
            z = logits()
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = (p - target) * (~held)[:, None] / (~held).sum()
            grad = ridge * w / 40
            grad[cols] += np.add.reduceat((err * scale[:, None])[r1], col_at)
            w = w - rate * 40 * grad
            b = b - rate * err.sum(0)
        self.weights[used] = w
        self.bias = b
        z, t = logits()[held], y[held]
        losses = []
        for temp in np.linspace(0.3, 3, 55):
            q = z / temp
            q = q - q.max(1, keepdims=True)
            losses.append((-(q[np.arange(len(t)), t] - np.log(np.exp(q).sum(1))).mean(), temp))
        self.temperature = float(min(losses)[1])
        self.words = {f: [_words(t) for t in texts] for f, texts in TEMPLATES.items()}
        self.bigrams = {f: [np.unique(ngram_hashes(w, 2)) for w in each] for f, each in self.words.items()}
        # templates of other families that share two fifths of a template's bigrams
        self.alike = {(f, k): [(g, j) for g, other in self.bigrams.items() if g != f for j, u in enumerate(other) if len(t) and np.isin(t, u).mean() >= 0.4] for f, each in self.bigrams.items() for k, t in enumerate(each)}
        # how sure the model is of a family where it sees none: licences that it wasn't trained on
        wrong = []
        for text in OTHERS[::2]:
            grams = _grams(_words(text)).astype(np.int64)
            wrong.append(float(self.probabilities(self.weights[grams].astype(float).sum(0)[None], np.array([len(grams)]))[0, 2:].max()))
        self.unsure = float(min(0.9, np.quantile(wrong, 0.9)))

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (sums / np.sqrt(np.maximum(1, counts))[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def confirmed(self, family: str, words: np.ndarray) -> tuple[float, bool]:
        """Best share, over the family's templates, of a template's bigrams that stand in the paragraph; and whether nothing speaks against it.

        Against it speaks a template of another family, alike but for a few words, of whose own words no less is there; and a word put between two that follow
        each other in the template, as in GNU (Affero) General or BY (ND) 4.0, where these two don't follow each other elsewhere."""
        there = np.unique(ngram_hashes(words, 2))
        shares = [float(np.isin(t, there).mean()) if len(t) else 0.0 for t in self.bigrams[family]]
        k = int(np.argmax(shares))
        mine = self.bigrams[family][k]
        told = lambda t, u: float(np.isin(d, there).mean()) if len(d := np.setdiff1d(t, u)) else 0.5  # noqa: E731  by what stands in the one template alone
        if any(told(other, mine) >= told(mine, other) for other in (self.bigrams[g][j] for g, j in self.alike[family, k])):
            return shares[k], False
        own = self.words[family][k]
        pairs = ngram_hashes(own, 2)
        apart = np.flatnonzero(~np.isin(pairs, there))
        put_between = _pairs(words[:-2], words[2:])
        return shares[k], not np.isin(_pairs(own[apart], own[apart + 1]), put_between).any()


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each two words."""
    return np.array([], np.uint64) if not len(a) else ngram_hashes(np.stack([a, b], 1).ravel(), 2)[::2]


def _paragraphs(data: np.ndarray, at: np.ndarray):
    """Byte spans of lines, and of runs of two or more non-blank lines, with their row: arrays start, end, row."""
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10), at[1:]]))
    starts = np.concatenate([[0], ends[:-1] + (data[np.minimum(ends[:-1], len(data) - 1)] == 10)]) if len(ends) else ends
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    row = np.searchsorted(at, starts, "right") - 1
    joined = np.zeros(len(starts), bool)
    joined[1:] = (starts[1:] == ends[:-1] + 1) & (row[1:] == row[:-1])
    first = np.flatnonzero(~joined)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    many = last > first
    return np.concatenate([starts, starts[first[many]]]), np.concatenate([ends, ends[last[many]]]), np.concatenate([row, row[first[many]]])


def _windows(lo: np.ndarray, hi: np.ndarray, most: int, least: int = 25):
    """Windows over words lo to hi of each long paragraph: paragraph, first word, word after the last, and scale (1 for the smallest).

    A window of a scale starts every half of its size, the last one at the end, so that every word, and every run of half a window, is whole in one."""
    sizes = [most]
    while sizes[0] // 2 >= least:
        sizes.insert(0, sizes[0] // 2)
    out = [np.zeros((4, 0), np.int64)]
    for k in range(len(lo)):
        for scale, size in enumerate(sizes, 1):
            a = np.append(np.arange(lo[k], hi[k] - size, max(1, size // 2)), hi[k] - size)
            out.append(np.stack([np.full(len(a), k), a, a + size, np.full(len(a), scale)]))
    return np.concatenate(out, axis=1)


def _merged(found: list[dict]) -> list[dict]:
    """Findings of a family that overlap, as one each."""
    out: dict[str, list] = {}
    for f in sorted(found, key=lambda f: (f["a"], f["b"])):
        of = out.setdefault(f["family"], [])
        if of and f["a"] < of[-1]["b"]:
            of[-1].update(b=max(of[-1]["b"], f["b"]), probability=max(of[-1]["probability"], f["probability"]), overlap=max(of[-1]["overlap"], f["overlap"]))
        else:
            of.append(dict(f))
    return [f for of in out.values() for f in of]


class _Cover:
    """The places that findings cover, as spans in order that do not touch."""

    def __init__(self, found: list[dict]):
        self.starts, self.ends = [], []
        for f in sorted(found, key=lambda f: f["a"]):
            if self.ends and f["a"] < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], f["b"])
            else:
                self.starts.append(f["a"])
                self.ends.append(f["b"])

    def meets(self, f: dict) -> bool:
        k = bisect_left(self.starts, f["b"])
        return k > 0 and self.ends[k - 1] > f["a"]


def _settled(found: list[dict]) -> list[dict]:
    """The findings of a text: a larger paragraph only where no smaller one in it is named already, and windows merged."""
    plain, scales = [f for f in found if not f["scale"]], sorted({f["scale"] for f in found} - {0})
    merged = [f for k in scales for f in _merged([f for f in found if f["scale"] == k])]
    named: list[dict] = []
    starts: list[tuple] = []  # of the named ones: start, end, whether unknown; in order
    for f in sorted([*plain, *merged], key=lambda f: (f["b"] - f["a"], f["a"])):
        k = bisect_left(starts, (f["a"],))
        inside = itertools.takewhile(lambda g: g[0] < f["b"], itertools.islice(starts, k, None))  # noqa: B023
        if not any(b <= f["b"] and (not unknown or f["family"] == "unknown") for _, b, unknown in inside):
            named.append(f)
            insort(starts, (f["a"], f["b"], f["family"] == "unknown"))
    plain, windows = [f for f in named if not f["scale"]], _merged([f for f in named if f["scale"]])
    sure = _Cover([f for f in [*plain, *windows] if f["family"] != "unknown"])
    of = {family: _Cover([f for f in plain if f["family"] == family]) for family in FAMILIES}
    windows = [f for f in windows if not (sure if f["family"] == "unknown" else of[f["family"]]).meets(f)]
    return [{k: v for k, v in f.items() if k != "scale"} for f in sorted([*plain, *windows], key=lambda f: (f["a"], f["b"]))]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenseModel | None = None, least: float = 0.6, overlap: float = 0.6, block_words: int = 400) -> DataFrame:
    """id, and findings (array of start, end, family, probability, overlap), for every row. A family is `unknown` where the model is unsure or no template confirms it.

    block_words: longest line or run of lines that is judged as a whole; longer ones are judged in overlapping windows of that size, and of its halves down to 25 words."""
    kind = docs.schema[id_col].dataType.simpleString()
    model = model or LicenseModel()
    found_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.float64())]))

    def work(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                out: list[list] = [[] for _ in range(batch.num_rows)]
                data, at = utf8(batch.column(1))
                words, _, (starts, stops) = word_hashes(plain(data), at)
                if len(words):
                    grams = ngram_hashes(words, 2)
                    single = model.weights[(words % np.uint64(BUCKETS)).astype(np.int64)]
                    total = np.zeros((len(words), len(FAMILIES)))  # before each word but the first: weights of the words and bigrams that start before it
                    total[1:] = single[:-1]
                    total[1:] += model.weights[(grams % np.uint64(BUCKETS)).astype(np.int64)]
                    np.cumsum(total, 0, out=total)
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    p0, p1, row = _paragraphs(data, at)
                    lo, hi = np.searchsorted(starts, p0), np.searchsorted(starts, p1)
                    size = hi - lo
                    keep, long = (size >= 2) & (size <= block_words), np.flatnonzero(size > block_words)
                    of, first, end, scale = _windows(lo[long], hi[long], block_words)
                    p0, p1 = np.concatenate([p0[keep], starts[first]]), np.concatenate([p1[keep], stops[end - 1]])
                    row, scale = np.concatenate([row[keep], row[long][of]]), np.concatenate([np.zeros(keep.sum(), np.int64), scale])
                    lo, hi = np.concatenate([lo[keep], first]), np.concatenate([hi[keep], end])
                    sums = total[hi - 1] - total[lo] + single[hi - 1]
                    best = model.probabilities(sums, 2 * (hi - lo) - 1)
                    for k in np.flatnonzero(best.argmax(1) > 0).tolist():
                        j = int(best[k].argmax())
                        share, clear = model.confirmed(FAMILIES[j], words[lo[k] : hi[k]]) if j > 1 else (0.0, False)
                        sure = best[k, j] >= max(least, model.unsure) and share >= overlap and clear
                        base = chars[at[row[k]]]
                        out[row[k]].append({"a": int(chars[p0[k]] - base), "b": int(chars[p1[k]] - base), "family": FAMILIES[j] if sure else "unknown", "probability": float(best[k, j]), "overlap": share, "scale": int(scale[k])})
                out = [_settled(o) for o in out]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, found_type)], names=[id_col, "findings"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, findings array<struct<a:int,b:int,family:string,probability:double,overlap:double>>")
