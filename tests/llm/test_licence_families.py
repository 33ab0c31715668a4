"""Licence families: each notice gets its own family or unknown, never another's; and the whole scan equals one paragraph at a time."""

import random
import re

import numpy as np
import pytest

from tickloom.llm import licenses

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NOTICES = {
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain.", "cc0": "To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0", "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0", "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0", "cc-by": "Licensed under CC BY 4.0", "cc-by-nc": "Licensed under CC BY-NC 4.0", "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "mit": "SPDX-License-Identifier: MIT", "apache-2.0": "SPDX-License-Identifier: Apache-2.0", "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}
STRANGE = [
    "Licensed under CC BY-XX 4.0", "This work is licensed under the GNU Verbatim General Public License, version 3", "SPDX-License-Identifier: NCSA", "Licensed under the Quux License, Version 2.0", "SPDX-License-Identifier: 0BSD",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Sleepy General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
]


@pytest.fixture(scope="module")
def model():
    return licenses.LicenseModel()


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def test_each_notice_is_its_own_family(spark, model):
    names = [*NOTICES]
    rows = licenses.scan_licenses(docs_of(spark, list(NOTICES.values())), model=model).collect()
    got = {names[r.doc_id]: {f.family for f in r.findings} for r in rows}
    assert all(found <= {name, "unknown"} for name, found in got.items()), got
    assert sum(got[name] == {name} for name in names) >= len(names) - 1, got


def test_other_licences_are_never_named(spark, model):
    texts = [*licenses.OTHERS, *STRANGE]
    for r in licenses.scan_licenses(docs_of(spark, texts), model=model).collect():
        assert {f.family for f in r.findings} <= {"unknown"}, (texts[r.doc_id], r.findings)


def test_wrapped_and_commented_notices(spark, model):
    words = NOTICES["agpl"].split()
    text = "x = 1\n\n" + "\n".join("# " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + "\n\ny = 2\n"
    found = licenses.scan_licenses(docs_of(spark, [text]), model=model).collect()[0].findings
    assert {f.family for f in found} <= {"agpl", "unknown"} and any(f.family == "agpl" for f in found)


def test_the_scan_equals_one_paragraph_at_a_time(spark, model):
    rng = random.Random(6)
    stock = [*NOTICES.values(), *STRANGE, *licenses.PROSE, "", "  ", "é über 東", "All rights reserved", "one"]
    texts = ["\n".join(rng.choice(stock) for _ in range(rng.randint(1, 9))) for _ in range(40)] + [None, "", "\n\n"]
    got = {r.doc_id: sorted((f.a, f.b, f.family, round(f.probability, 6), round(f.overlap, 6)) for f in r.findings) for r in licenses.scan_licenses(docs_of(spark, texts), model=model).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        lines = [m.span() for m in re.finditer(r"[^\n]+", text)]
        runs, start = [], 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or lines[k][0] != lines[k - 1][1] + 1:
                if k - start > 1:
                    runs.append((lines[start][0], lines[k - 1][1]))
                start = k
        found = []
        for a, b in lines + runs:
            words = licenses._words(text[a:b])
            if 2 <= len(words) <= 400:
                grams = licenses._grams(words).astype(np.int64)
                p = model.probabilities(model.weights[grams].astype(float).sum(0)[None], np.array([len(grams)]))[0]
                j = int(p.argmax())
                if j:
                    share, clear = model.confirmed(licenses.FAMILIES[j], words) if j > 1 else (0.0, False)
                    sure = p[j] >= max(0.6, model.unsure) and share >= 0.6 and clear
                    found.append({"a": a, "b": b, "family": licenses.FAMILIES[j] if sure else "unknown", "probability": float(p[j]), "overlap": share, "scale": 0})
        want = sorted((f["a"], f["b"], f["family"], round(f["probability"], 6), round(f["overlap"], 6)) for f in licenses._settled(found))
        assert [g[:3] for g in got[i]] == [w[:3] for w in want] and np.allclose([g[3:] for g in got[i]] or [0], [w[3:] for w in want] or [0], atol=1e-4)
