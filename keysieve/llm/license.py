"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Each line, each paragraph and each run of as many words as a template has is compared
with the license templates, notices and full texts, as a sparse vector of term counts,
weighted by how many of all files hold a term. Most files share no telling term with
any template and cost a set lookup. The frequencies of all words are counted by Spark
and joined to the words of runs that may be similar enough. A
file that opens with a notice which makes up a fair share of it, or that is called
like a license file, licenses its directory. A file without a notice of its own
takes over the license of the nearest directory above it: directories, which are
far fewer than files, are joined with their ancestors by path, and the files with
the outcome.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.functions.joins import salted_lookup
from keysieve.llm.common import broadcast_if_small, per_batch, valid_text, written

BATCH_ROWS = 512
LEAST_SIMILARITY = 0.75
FILE_SHARE = 0.05
#: A longer run that is at least so similar explains the shorter ones in it.
WHOLE_SIMILARITY = 0.9
#: Words that a task adds up at a time.
HELD_WORDS = 200_000
TERM = re.compile(r"[a-z0-9]+")
# Notices of well-known licenses, by SPDX identifier.
NOTICES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-ND-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "BSD-2-Clause": ("SPDX-License-Identifier: BSD-2-Clause",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1",),
}
# Base names of license files.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|copyright|notice)(\..*)?$"


FULL_TEXTS = Path(__file__).with_name("licenses")


def with_full_texts(templates: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """The templates and the full texts kept beside this module, one file for each identifier."""
    full = {p.stem: p.read_text("utf-8") for p in sorted(FULL_TEXTS.glob("*.txt"))}
    return {name: templates.get(name, ()) + ((full[name],) if name in full else ()) for name in sorted({*templates, *full})}


TEMPLATES = with_full_texts(NOTICES)


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def vocabulary() -> list[str]:
    return sorted({t for texts in TEMPLATES.values() for text in texts for t in terms(text)})


def word_counts(files: DataFrame) -> DataFrame:
    """``(term, n)``: for each word of the files the number of files that hold it, and their number for the empty word.

    A task adds up the words of its files, and hands them on when they are too many to hold.
    """

    def rows(count: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    def work(batches):
        count = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count[""] += 1
                count.update(set(terms(text or "")))
                if len(count) > HELD_WORDS:
                    yield rows(count)
                    count = Counter()
        yield rows(count)

    return files.select(valid_text("text").alias("text")).mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def document_frequencies(words: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of files, and for each term of a template the number of files that hold it."""
    counts = {r["term"]: r["n"] for r in words.where(F.col("term").isin(["", *vocabulary()])).collect()}
    return counts.pop("", 0), counts


class Matcher:
    """Templates as unit vectors; a term that is not in ``frequency`` weighs as much as one that no file holds.

    ``telling`` has the rarest terms of each template: a run without any of them
    cannot reach the least similarity, as the other terms are too small a part of it.
    """

    def __init__(self, files: int, frequency: dict[str, int], least: float = LEAST_SIMILARITY):
        self.files, self.least = files, least
        self.weight = {t: self.weigh(frequency.get(t, 0)) for t in vocabulary()}
        self.unknown = self.weigh(0)
        self.templates: list[tuple[str, dict[str, float]]] = []
        self.sizes: list[int] = []
        for name in sorted(TEMPLATES):
            for text in TEMPLATES[name]:
                self.templates.append((name, self.unit(Counter(terms(text)))))
                self.sizes.append(len(terms(text)))
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        self.telling: dict[str, list[int]] = {}
        for number, (_, vector) in enumerate(self.templates):
            rest = 1.0
            for term, value in sorted(vector.items(), key=lambda e: (-self.weight[e[0]], e[0])):
                self.by_term.setdefault(term, []).append((number, value))
                if rest >= least * least - 1e-9:
                    self.telling.setdefault(term, []).append(number)
                rest -= value * value

    def weigh(self, frequency: int) -> float:
        return math.log((1 + self.files) / (1 + frequency)) + 1

    def length(self, count: Counter) -> float:
        return math.sqrt(sum((n * self.weight.get(t, self.unknown)) ** 2 for t, n in count.items()))

    def unit(self, count: Counter) -> dict[str, float]:
        length = self.length(count)
        return {t: n * self.weight[t] / length for t, n in count.items()}

    def best(self, count: Counter, least: float) -> tuple[float, str] | None:
        """The most similar template's license, ties to the first name."""
        scores: dict[int, float] = {}
        for term, n in count.items():
            for number, value in self.by_term.get(term, ()):
                scores[number] = scores.get(number, 0.0) + n * self.weight[term] * value
        if not scores:
            return None
        number = min(scores, key=lambda i: (-scores[i], self.templates[i][0]))
        similarity = scores[number] / self.length(count)
        return (similarity, self.templates[number][0]) if similarity >= least else None

    def slide(self, number: int, words: list[str], first: int, last: int, size: int, others: dict[str, float], default: float):
        """``(start, similarity)`` to a template of the runs of ``size`` words that start from ``first`` to ``last``."""
        vector, count, weight = self.templates[number][1], {}, self.weight
        dot = square = 0.0
        for place in range(first, last + size):
            if place >= first + size:
                word = words[place - size]
                w = weight.get(word) or others.get(word, default)
                n = count[word] = count[word] - 1
                dot -= w * vector.get(word, 0.0)
                square -= (2 * n + 1) * w * w
            word = words[place]
            w = weight.get(word) or others.get(word, default)
            n = count.get(word, 0)
            count[word] = n + 1
            dot += w * vector.get(word, 0.0)
            square += (2 * n + 1) * w * w
            if place >= first + size - 1:
                yield place - size + 1, min(dot / math.sqrt(square), 1.0) if square > 0 else 0.0

    def runs(self, text: str | None) -> tuple[int, list[tuple[int, int, int, list[int], list[str]]]]:
        """The number of words of a file, and the runs that may be similar enough: template, first start, words of a run, lines of the starts, words.

        Runs are lines, paragraphs and, wherever they begin, as many words as the
        template has. Words of no template weigh at least 1, which bounds the similarity.
        """
        words, line_of, units, paragraph = [], [], [], 0
        for place, line in enumerate([*(text or "").lower().split("\n"), ""]):
            found = TERM.findall(line)
            if found:
                units.append((len(words), len(words) + len(found)))
                words += found
                line_of += [place] * len(found)
            else:
                if len(words) > paragraph:
                    units.append((paragraph, len(words)))
                paragraph = len(words)
        held = set(words)
        if held.isdisjoint(self.telling):
            return len(words), []
        places: dict[int, list[int]] = {}
        for place, word in enumerate(words):
            for number in self.telling.get(word, ()):
                places.setdefault(number, []).append(place)
        out = []
        for number, at in places.items():
            if sum(v * v for t, v in self.templates[number][1].items() if t in held) < self.least**2 - 1e-9:
                continue
            size = min(self.sizes[number], len(words))
            spans: list[list[int]] = []
            for place in at:
                first, last = max(0, place - size + 1), min(place, len(words) - size)
                if spans and first <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], last)
                else:
                    spans.append([first, last])
            tries = [(first, last, size) for first, last in spans]
            k = 0
            for start, end in sorted(set(units)):
                while k < len(at) and at[k] < start:
                    k += 1
                if k < len(at) and at[k] < end:
                    tries.append((start, start, end - start))
            for first, last, length in tries:
                begun = None
                for start, similarity in [*self.slide(number, words, first, last, length, {}, 1.0), (last + 1, -1.0)]:
                    if similarity >= self.least - 1e-6:
                        begun = start if begun is None else begun
                    elif begun is not None:
                        out.append((number, begun, length, line_of[begun:start], words[begun : start - 1 + length]))
                        begun = None
        return len(words), out

    def choose(self, runs: list[dict], frequency: dict[str, int]) -> tuple[str, float, int, int] | None:
        """License, similarity, line from 0 and number of words of the best notice, the earliest of equals.

        A notice within a much longer and very similar one of another license is a part of that.
        """
        others = {t: self.weigh(n) for t, n in frequency.items()}
        found: dict[int, tuple] = {}
        for run in runs:
            number, size, words = run["number"], run["size"], run["words"]
            best = found.get(number)
            for start, similarity in self.slide(number, words, 0, len(words) - size, size, others, self.unknown):
                at = run["first"] + start
                if similarity >= self.least - 1e-9 and (best is None or (-round(similarity, 9), at) < (-round(best[0], 9), best[1])):
                    best = (similarity, at, size, run["lines"][start], self.templates[number][0])
            if best:
                found[number] = best
        alone = [
            a for a in found.values()
            if not any(b[4] != a[4] and b[2] >= 2 * a[2] and b[0] >= WHOLE_SIMILARITY and b[1] <= a[1] and a[1] + a[2] <= b[1] + b[2]
                       for b in found.values())
        ]
        if not alone:
            return None
        best = min(alone, key=lambda a: (-round(a[0], 9), a[1], -a[2], a[4]))
        return best[4], round(best[0], 12), best[3], best[2]


RUN = T.StructType(
    [T.StructField("number", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("size", T.IntegerType()),
     T.StructField("lines", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(T.StringType()))]
)


def own_notices(files: DataFrame, least: float) -> DataFrame:
    """``(key, path, license, similarity, line, share)``: the best notice in each file itself.

    Runs of words that may be notices are found first; only their words are joined
    with the document frequencies of all words.
    """
    counts = written(word_counts(files), "license-words")
    matcher = Matcher(*document_frequencies(counts), least)
    kept = files.schema.fields[:2]
    schema = T.StructType(
        [*kept, T.StructField("total", T.IntegerType()), T.StructField("runs", T.ArrayType(RUN)),
         T.StructField("others", T.ArrayType(T.StringType()))]
    )
    arrow = pa.list_(pa.struct([("number", pa.int32()), ("first", pa.int32()), ("size", pa.int32()),
                                ("lines", pa.list_(pa.int32())), ("words", pa.list_(pa.string()))]))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        totals, runs, others = [], [], []
        for text in batch.column(2).to_pylist():
            total, found = matcher.runs(text)
            totals.append(total)
            runs.append([dict(zip(("number", "first", "size", "lines", "words"), r)) for r in found])
            others.append(sorted({w for r in found for w in r[4]} - matcher.weight.keys()))
        columns = [pa.array(totals, pa.int32()), pa.array(runs, arrow), pa.array(others, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], schema.names)

    found = files.mapInArrow(per_batch(find, BATCH_ROWS), schema).withColumn("row", F.monotonically_increasing_id())
    found = written(found, "license-runs")
    met = found.select("row", F.explode("others").alias("term"))
    known = broadcast_if_small(written(counts.join(met.select("term").distinct(), "term"), "license-met"), ["term"])
    weighed = met.join(known, "term").groupBy("row").agg(
        F.collect_list("term").alias("terms"), F.collect_list("n").alias("ns")
    )
    open_ = found.where(F.size("runs") > 0).join(weighed, "row", "left").select("key", "path", "total", "runs", "terms", "ns")
    result = T.StructType(
        [*kept, T.StructField("license", T.StringType()), T.StructField("similarity", T.DoubleType()),
         T.StructField("line", T.IntegerType()), T.StructField("share", T.DoubleType())]
    )

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for total, runs, words, ns in zip(*(c.to_pylist() for c in batch.columns[2:])):
            best = matcher.choose(runs, dict(zip(words or (), ns or ())))
            rows.append((*best[:3], best[3] / total) if best else (None, None, None, None))
        kinds = (pa.string(), pa.float64(), pa.int32(), pa.float64())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], result.names)

    rest = found.where(F.size("runs") == 0).select("key", "path", *(F.lit(None).cast(f.dataType).alias(f.name) for f in result.fields[2:]))
    return written(open_.mapInArrow(per_batch(settle, BATCH_ROWS), result).unionByName(rest), "license-own")


def scan(files: DataFrame, least: float = LEAST_SIMILARITY, file_share: float = FILE_SHARE) -> DataFrame:
    """``(key, path, license, similarity, line, origin, from_path)`` of files ``(key, path, text)``.

    ``origin`` is ``notice`` for a notice in the file itself, ``inherited`` for the
    license of the nearest directory above that has one, ``none`` otherwise, with a
    null license. Of several license files in a directory the most similar counts,
    then the first path. A null or empty text has no notice; a null path is in no
    directory. Rows that repeat are kept; an empty table gives no rows.
    """
    own = own_notices(files.select("key", "path", "text"), least)
    own = own.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    inherited = salted_lookup(own, nearest(own, file_share), ["dir"], ["key", "path"])  # a directory may hold most files
    missing = F.col("license").isNull()
    return inherited.select(
        "key",
        "path",
        F.coalesce("license", "dir_license").alias("license"),
        "similarity",
        "line",
        F.when(~missing, "notice").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~missing, F.col("path")).otherwise(F.col("dir_path")).alias("from_path"),
    )


def nearest(own: DataFrame, file_share: float) -> DataFrame:
    """``(dir, dir_license, dir_path)``: for each directory, the license file of the nearest one at or above it."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    is_file = F.col("license").isNotNull() & (name.rlike(FILE_NAMES) | ((F.col("line") == 0) & (F.col("share") >= file_share)))
    licensed = own.where(is_file).groupBy("dir").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("best")
    )
    licensed = licensed.select(F.col("dir").alias("above"), "best.license", "best.path")
    dirs = own.where(F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))).alias("depth"))
    above = above.select("dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("above"))
    met = above.join(licensed, "above").groupBy("dir").agg(F.max(F.struct("depth", "license", "path")).alias("n"))
    return met.select("dir", F.col("n.license").alias("dir_license"), F.col("n.path").alias("dir_path"))


def document_files(documents: DataFrame) -> DataFrame:
    """Documents as files: a directory per source, in it one per thousand ids."""
    number = F.col("doc_id").cast("long")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(number / 1000), number)
    return documents.select(number.alias("key"), path.alias("path"), "text")
