"""Language identification in two steps: the family, then the language within it.

A text is a vector of hashed letter pairs and triples over its whole length. A
linear support vector machine per family separates it from the other families;
within a family, one machine per pair of languages votes, which tells closely
related languages apart better than machines that also have to look at distant
ones. The machines are fitted on a bounded sample of labelled rows; prediction
is one narrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.llm.common import held_out, per_batch, worker_memory, written

SAMPLE_PER_LANGUAGE = 600
BUCKETS_LOG2 = 12
BATCH_ROWS = 256
UNDETERMINED = "und"
# Families of languages by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
}


def family_of(language: str) -> str:
    code = language.lower().split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), f"language {language}")


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    known = worker_memory()
    if "letters" not in known:
        known["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return known["letters"]


def vector(text: str | None) -> np.ndarray | None:
    """Hashed counts of letter pairs and triples, damped and of unit length; None without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    points = np.where(is_letter, points, 32).astype(np.uint32)
    points = np.concatenate(([32], points[(points != 32) | np.concatenate(([False], points[:-1] != 32))], [32, 32])).astype(np.uint32)
    pairs = points[:-1] * np.uint32(0x85EBCA6B) + points[1:] * np.uint32(0xC2B2AE35)
    triples = pairs[:-1] * np.uint32(0x27D4EB2F) + points[2:] * np.uint32(0x165667B1)
    shift = np.uint32(32 - BUCKETS_LOG2)
    count = np.bincount(np.concatenate((pairs >> shift, triples >> shift)), minlength=1 << BUCKETS_LOG2)
    x = np.sqrt(count)
    return (x / np.linalg.norm(x)).astype(np.float32)


def separate(x: np.ndarray, positive: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, bias last.

    Coordinate descent on the dual problem, examples in a fixed shuffled order;
    both classes weigh the same in total.
    """
    x = np.hstack((x, np.ones((len(x), 1), dtype=x.dtype))).astype(np.float64)
    sign = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)) * len(x)
    soft = 1.0 / (2.0 * cost * share)
    diagonal = np.square(x).sum(axis=1) + soft
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(0)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(x)):
            gradient = sign[i] * (x[i] @ w) - 1.0 + soft[i] * alpha[i]
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x[i]
                largest = max(largest, abs(new - alpha[i]))
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


@dataclass(frozen=True)
class Hierarchy:
    """Family machines, and for each family its languages and the machines of their pairs."""

    families: list[str]
    family_weights: np.ndarray
    languages: list[list[str]]
    pair_weights: list[dict[tuple[int, int], np.ndarray]]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return UNDETERMINED, 0.0
        x = np.append(x, np.float32(1))
        margins = self.family_weights @ x
        best = int(np.argmax(margins))
        odds = np.exp(np.clip(3 * (margins - margins[best]), -60, 0))
        score = float(odds[best] / odds.sum())
        names = self.languages[best]
        votes, strength = np.zeros(len(names)), np.zeros(len(names))
        for (a, b), w in self.pair_weights[best].items():
            margin = float(w @ x)
            votes[a if margin >= 0 else b] += 1
            strength[a] += margin
            strength[b] -= margin
        chosen = max(range(len(names)), key=lambda i: (votes[i], strength[i], -i))
        for (a, b), w in self.pair_weights[best].items():
            if chosen in (a, b):
                margin = float(w @ x) * (1 if chosen == a else -1)
                score *= 1.0 / (1.0 + np.exp(np.clip(-3 * margin, -60, 60)))
        return names[chosen], float(score)


def fit_hierarchy(x: np.ndarray, language: list[str]) -> Hierarchy:
    """The machines from vectors and their languages, in a fixed order of rows."""
    names = sorted(set(language))
    families = sorted({family_of(n) for n in names})
    of = np.array([families.index(family_of(n)) for n in language])
    if len(families) > 1:
        weights = np.array([separate(x, of == f) for f in range(len(families))])
    else:
        weights = np.zeros((len(families), x.shape[1] + 1))
    members, pairs = [], []
    spoken = np.array(language)
    for family in families:
        own = [n for n in names if family_of(n) == family]
        members.append(own)
        pairs.append({})
        for a, b in combinations(range(len(own)), 2):
            chosen = (spoken == own[a]) | (spoken == own[b])
            pairs[-1][a, b] = separate(x[chosen], spoken[chosen] == own[a])
    return Hierarchy(families, weights, members, pairs)


def largest_hashes(hashes: DataFrame, per_language: int) -> dict[str, int]:
    """For each language of ``(lang, h)``, the hash of rank ``per_language`` from the smallest, or the last one if there are fewer.

    ``hashes`` has no repeated rows. The driver gets little more than
    ``per_language`` hashes of each: as hashes are evenly spread, those under a bound
    that the number of texts sets; the bound is doubled where that is too few.
    """
    counts = {r["lang"]: r["n"] for r in hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {name: (per_language + 6 * per_language**0.5 + 30) / n for name, n in counts.items()}
    found: dict[str, int] = {}
    while wanted:
        bounds = {name: min(-(1 << 63) + int(min(share, 1.0) * (1 << 64)), (1 << 63) - 1) for name, share in wanted.items()}
        near: dict[str, list[int]] = {name: [] for name in wanted}
        for r in hashes.where(F.col("h") <= per_name(bounds)).collect():
            near[r["lang"]].append(r["h"])
        for name, own in near.items():
            rank = min(per_language, counts[name])
            if len(own) >= rank:
                found[name] = sorted(own)[rank - 1]
        wanted = {name: 2 * share for name, share in wanted.items() if name not in found}
    return found


def per_name(values: dict[str, int]) -> Column:
    """The number of a row's language, null for others."""
    entries = [F.lit(x) for name, value in sorted(values.items()) for x in (name, value)]
    return F.try_element_at(F.create_map(*entries).cast("map<string,bigint>"), F.col("lang"))


def training_rows(documents: DataFrame, per_language: int) -> DataFrame:
    """``(language, x)`` of a sample, vectors packed as 32-bit floats: ``per_language`` distinct texts of each language, or all.

    The texts are those with the smallest hashes. How many copies a text has does not
    matter, neither for whether it is in the sample nor for its weight.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~F.coalesce(held_out("doc_id"), F.lit(False)))
    known = known.select("lang", "text", F.xxhash64("text").alias("h"))
    cuts = largest_hashes(written(known.select("lang", "h").distinct(), "language-hashes"), per_language)
    chosen = known.where(F.col("h") <= per_name(cuts)) if cuts else known.limit(0)
    chosen = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))
    schema = "language string, x binary"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(n, v.tobytes()) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                if (v := vector(t)) is not None]
        columns = [pa.array([n for n, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["language", "x"])

    return chosen.select("lang", "text").mapInArrow(per_batch(work, BATCH_ROWS), schema)


def fit(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Hierarchy:
    """The hierarchy from ``doc_id``, ``text`` and ``lang`` of rows that are not held out.

    ``per_language`` bounds the sample, and with it what the driver gathers, whatever
    the number of copies. Rows without a language or a letter teach nothing.
    """
    rows = training_rows(documents, per_language).collect()
    rows.sort(key=lambda r: (r["language"], bytes(r["x"])))
    if not rows:
        return Hierarchy([], np.zeros((0, (1 << BUCKETS_LOG2) + 1)), [], [])
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in rows])
    return fit_hierarchy(x, [r["language"] for r in rows])


def identify(documents: DataFrame, model: Hierarchy) -> DataFrame:
    """``(doc_id, lang_pred, score)``, one row per row, from the whole texts alone.

    A text that is null or has no letter is ``und`` with score 0, as is every text
    if nothing was learned. Equal votes go to the larger margin, then to the first
    code. An empty table gives no rows; further columns are not looked at.
    """
    source = documents.select("doc_id", "text")
    schema = T.StructType(
        [
            T.StructField("doc_id", source.schema["doc_id"].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column(1).to_pylist():
            x = vector(text)
            found.append((UNDETERMINED, 0.0) if x is None else model.predict(x))
        names, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
        return pa.RecordBatch.from_arrays([batch.column(0), names, scores], ["doc_id", "lang_pred", "score"])

    return source.mapInArrow(per_batch(work, BATCH_ROWS), schema)
