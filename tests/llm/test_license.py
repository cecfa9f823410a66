import math
import random
from collections import Counter

from keysieve.llm import license as lic


def test_cosine_against_dense_vectors():
    matcher = lic.Matcher(50, {"the": 40, "license": 5, "version": 3})
    line = "this file is licensed under the apache license version 2 0 ok"
    count = Counter(lic.terms(line))
    words = sorted(set(lic.vocabulary()) | set(count))
    weight = [matcher.weight.get(w, matcher.unknown) for w in words]

    def vector(c):
        v = [c.get(w, 0) * x for w, x in zip(words, weight)]
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    dense = max((sum(a * b for a, b in zip(vector(count), vector(Counter(lic.terms(t))))), name) for name, ts in lic.TEMPLATES.items() for t in ts)
    best = matcher.best(count, 0.1)
    assert best[1] == dense[1] == "Apache-2.0" and abs(best[0] - dense[0]) < 1e-9
    assert matcher.best(Counter(["nothing", "here"]), 0.1) is None


def test_inheritance(spark):
    mit, apache = "Released under the MIT License.", "# Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x.py", "print('hello world of many words')"), (3, "a/b/y.py", f"{apache}\n" + "code and code " * 200),
        (4, "a/b/LICENSE.txt", apache), (5, "z/x.py", "no notice"), (6, "top.txt", None), (7, None, mit), (8, "a/b/c/", ""),
        (2, "a/b/c/x.py", "print('hello world of many words')"), (9, "q/w.txt", "long " * 60000 + "\n" + mit),
    ]
    files = spark.createDataFrame(rows, "key long, path string, text string").selectExpr("*", "'x' AS license", "'y' AS dir")
    got = {(r.key, r.origin, r.license, r.from_path) for r in lic.scan(files).collect()}
    assert got == {
        (1, "notice", "MIT", "a/LICENSE"), (2, "inherited", "Apache-2.0", "a/b/LICENSE.txt"), (3, "notice", "Apache-2.0", "a/b/y.py"),
        (4, "notice", "Apache-2.0", "a/b/LICENSE.txt"), (5, "none", None, None), (6, "none", None, None), (7, "notice", "MIT", None),
        (8, "inherited", "Apache-2.0", "a/b/LICENSE.txt"), (9, "notice", "MIT", "q/w.txt"),
    }
    assert lic.scan(files.where("key < 0")).collect() == []


def test_planted_notices(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.key: r.license for r in lic.scan(lic.document_files(documents)).where("origin = 'notice'").collect()}
    for r in documents.select("doc_id", "text").collect():
        want = {name for name, texts in lic.TEMPLATES.items() if any(t in (r.text or "") for t in texts[:1])}
        assert (r.doc_id in got) == bool(want) and (not want or got[r.doc_id] in want)


HEADERS = {
    "MIT": """Copyright (c) 2024 Acme

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "Apache-2.0": """# Copyright 2024 Acme
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
} | {
    f"{kind}GPL-{version}": f"""This program is free software{sign} you can redistribute it and/or modify
it under the terms of the GNU {name}General Public License as published by
the Free Software Foundation{sign[0].replace(":", ",")} either version {version[0]} of the License, or
(at your option) any later version."""
    for kind, name, version, sign in (("", "", "3.0", ":"), ("", "", "2.0", ";"), ("L", "Lesser ", "3.0", ":"), ("A", "Affero ", "3.0", ":"))
}


def test_standard_notices_in_a_corpus_of_licenses(spark):
    """Common licenses, and words around a notice, do not hide it; siblings and full texts are told apart."""
    rng = random.Random(0)
    rows = [(n, f"f/{n}", " ".join(rng.choices([f"w{k}" for k in range(300)], k=30))) for n in range(300)]
    texts = [(name, text + "\n\nimport os\n") for name, text in HEADERS.items()] * 6
    texts += [("MIT", "Released under the MIT License by Acme Widgets Ltd.")]
    texts += [("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-4.0", "x. Licensed under CC BY 4.0. Words w1 w2 w3 w4 follow here")]
    full = {p.stem: p.read_text("utf-8") for p in lic.FULL_TEXTS.glob("*.txt")}
    texts += [(name, "Title of it\n\nCopyright (c) 2024 Acme Widgets\n\n" + text) for name, text in full.items()]
    rows += [(1000 + n, f"s/{n}/x", text) for n, (_, text) in enumerate(texts)]
    got = {r.key: r for r in lic.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    for n, (name, text) in enumerate(texts):
        assert got[1000 + n].license == name and got[1000 + n].origin == "notice", (name, got[1000 + n], text[:80])
    assert all(got[n].origin == "none" for n in range(300)) and len(got) == len(rows)


def test_runs_against_all_runs():
    """No run that is similar enough is left out, and the frequencies of other words count."""
    rng = random.Random(1)
    frequency = {t: rng.randint(0, 60) for t in lic.vocabulary()}
    others = {f"w{k}": rng.randint(1, 60) for k in range(5)}
    matcher = lic.Matcher(60, frequency)
    notices = [t for texts in lic.NOTICES.values() for t in texts]
    for _ in range(40):
        words = lic.terms(rng.choice(notices))
        words = [w for w in words if rng.random() < 0.9]
        text = " ".join([*rng.choices([*others], k=4), *words[:6], "w1\n", *words[6:], *rng.choices([*others, "the", "license"], k=5)])
        flat = lic.terms(text)
        best = 0.0
        for (_, vector), size in zip(matcher.templates, matcher.sizes):
            spans = [(i, i + min(size, len(flat))) for i in range(len(flat) - min(size, len(flat)) + 1)]
            first = len(lic.terms(text.split("\n")[0]))
            for a, b in [*spans, (0, first), (first, len(flat)), (0, len(flat))]:
                count = Counter(flat[a:b])
                weight = {w: matcher.weight.get(w) or matcher.weigh(others[w]) for w in count}
                length = math.sqrt(sum((n * weight[w]) ** 2 for w, n in count.items())) or 1.0
                best = max(best, sum(n * weight[w] * vector.get(w, 0.0) for w, n in count.items()) / length)
        runs = [dict(zip(("number", "first", "size", "lines", "words"), r)) for r in matcher.runs(text)[1]]
        found = matcher.choose(runs, others)
        assert (found is not None) == (best >= lic.LEAST_SIMILARITY)
        assert found is None or abs(found[1] - best) < 1e-9
