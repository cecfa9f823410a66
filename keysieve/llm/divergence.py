"""How far the word use of a source is from the other sources of its language.

One pass over the texts: ``bytes.translate`` lowers letters and blanks everything
that separates terms, ``bytes.split`` cuts, and a Counter per document gives the
frequencies. A task adds the counters up by language, source and term, so a term
leaves it once per source and not once per document; what it holds in between is
bounded and given out when full. Everything after that works on sparse counts.

Terms are kept per language if enough documents hold them. A group is a source
within a language; its share of a term is smoothed and scaled to an integer, and a
term that it lacks has the group's floor share. Groups are compared with the
language term by term, and with each other in blocks of terms: a block sets up one
small matrix of shares, terms by sources, and gives one partial sum per pair of
sources, never a row per term and pair. Sums are added up in Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keysieve.llm.common import valid_text, written

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
SMOOTHING = 2
#: Entries that a task holds before it gives them out.
HELD_TERMS = 300_000
#: Shares in the matrix of one block.
BLOCK_CELLS = 1 << 16

#: Letters are lowered, all other ASCII becomes blank, and bytes beyond ASCII stay.
TABLE = bytes(b if b >= 128 else b | 32 if chr(b).isalpha() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Tally:
    """Counts of a task by group: occurrences of each term, and documents that hold it."""

    def __init__(self):
        self.counts: dict[tuple[str, str], Counter] = {}
        self.documents: dict[tuple[str, str], Counter] = {}

    def add(self, lang: str, source: str, text: bytes) -> int:
        """Adds a document; the number of entries this has made."""
        group = (lang, source)
        if group not in self.counts:
            self.counts[group], self.documents[group] = Counter(), Counter()
        counts, before = self.counts[group], len(self.counts[group])
        frequencies = Counter(terms(text))
        for term, n in frequencies.items():
            counts[term] += n
        self.documents[group].update(frequencies.keys())
        return len(counts) - before

    def batches(self) -> Iterator[pa.RecordBatch]:
        """All entries; each group has one with an empty term besides, so that none is lost."""
        for (lang, source), counts in self.counts.items():
            held = self.documents[lang, source]
            columns = [[lang] * (len(counts) + 1), [source] * (len(counts) + 1), [b"", *counts],
                       [0, *counts.values()], [0, *map(held.__getitem__, counts)]]
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally, held = Tally(), 0
    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
            held += tally.add(lang, source, text)
            if held >= HELD_TERMS:
                yield from tally.batches()
                tally, held = Tally(), 0
    yield from tally.batches()


def clean(name: str) -> Column:
    """The column as valid text, empty if null."""
    return F.coalesce(valid_text(name), F.lit(""))


def term_counts(frame: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)`` over all rows; ``term`` is empty once per group.

    Nulls count as empty strings. Bytes that are not UTF-8 are replaced by U+FFFD,
    which belongs to terms like every character beyond ASCII.
    """
    rows = frame.select(clean(lang), clean(source), clean(text).cast("binary")).toDF("lang", "source", "text")
    parts = rows.mapInArrow(tallied, "lang string, source string, term binary, n long, docs long")
    parts = parts.repartition("lang", "term")  # what counts documents per language needs, too: one shuffle for both
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``(lang, source, term, n, lang_n, first)``: terms that enough documents of the language hold, and one empty term per group.

    ``first`` marks one of a term's rows within its language.
    """
    of_term = W.partitionBy("lang", "term")
    rows = counts.select(
        "lang", "source", F.col("term").cast("string").alias("term"), "n",
        F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("lang_docs"),
        (F.col("source") == F.min("source").over(of_term)).alias("first"),
    )
    return rows.where((F.col("term") == "") | (F.col("lang_docs") >= least)).drop("lang_docs")


def share(n: Column, total: Column, vocabulary: Column) -> Column:
    """The smoothed share in billionths, at least 1; exact for any count. Null without a vocabulary."""
    wide = "decimal(38,0)"
    above = (n + SMOOTHING).cast(wide) * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(vocabulary > 0, 1 + F.call_function("div", above.cast(wide), (total + SMOOTHING * vocabulary).cast(wide)))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def block_sums(key, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """One partial sum per pair of sources, over the terms of a block."""
    sized = sorted(zip(groups["source"].to_pylist(), groups["floor"].to_pylist()))
    names = [name for name, _ in sized]
    places = {name: i for i, name in enumerate(names)}
    rows = cells["term"].combine_chunks().dictionary_encode()
    if cells.num_rows:  # an empty block belongs to a language without kept terms, which has no floors
        shares = np.tile(np.array([floor for _, floor in sized], dtype=np.int64), (len(rows.dictionary), 1))
        at = [places[name] for name in cells["source"].to_pylist()]
        shares[rows.indices.to_numpy(), at] = cells["p"].to_numpy()
    else:
        shares = np.zeros((0, len(names)), dtype=np.int64)
    one, other, parts = [], [], []
    for i, name in enumerate(names[:-1]):
        p, q = shares[:, i : i + 1], shares[:, i + 1 :]
        parts.append(((p - q) ** 2 // (p + q)).sum(axis=0))
        one += [name] * (len(names) - 1 - i)
        other += names[i + 1 :]
    sums = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    arrays = [pa.array([key[0].as_py()] * len(one), pa.string()), pa.array(one, pa.string()), pa.array(other, pa.string()), pa.array(sums, pa.int64())]
    return pa.Table.from_arrays(arrays, ["lang", "one", "other", "part"])


def pairs(cells: DataFrame, groups: DataFrame, langs: DataFrame, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """``(lang, source, item, q, value)`` for each two sources of a language, in both directions.

    A block has so many terms that its matrix has about ``block_cells`` shares; a
    language without kept terms has one empty block, and its values are 0.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("vocabulary") * F.col("sources") / block_cells)).cast("long")
    sized = langs.select("lang", blocks.alias("blocks"))
    dealt = cells.join(sized, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", "source", "p"
    )
    repeated = groups.join(sized, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "floor"
    )
    parts = (
        dealt.groupBy("lang", "block")
        .cogroup(repeated.groupBy("lang", "block"))
        .applyInArrow(block_sums, "lang string, one string, other string, part long")
    )
    sums = parts.groupBy("lang", "one", "other").agg(F.sum("part").alias("value"))
    both = F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")),
                   F.struct(F.col("other").alias("source"), F.col("one").alias("item")))
    return sums.select("lang", F.explode(both).alias("pair"), "value").select("lang", "pair.source", "pair.item", "value")


def audit(
    frame: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS,
    top: int = TOP_TERMS, block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair``: the divergence of a source from each other source of its language,
    greatest first. Part ``term``: the terms that set a source apart from its
    language, the ``top`` ones. Equal values are ordered by item as UTF-8.

    Null texts, languages and sources count as empty ones, and such groups are
    groups like any other; so are groups without any term. A language with one source has no
    pairs. Without kept terms the values of pairs are 0 and there are no terms.
    Repeated rows count as often as they occur. Texts are read whole. Other columns
    are not looked at. An empty frame gives no rows.
    """
    kept = written(kept_counts(term_counts(frame, text, lang, source), least), "terms")
    is_term = F.col("term") != ""
    langs = kept.groupBy("lang").agg(
        F.sum((is_term & F.col("first")).cast("long")).alias("vocabulary"),
        F.sum("n").alias("lang_total"),
        F.sum((~is_term).cast("long")).alias("sources"),
    )
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = totals.join(langs, "lang").withColumn("floor", share(F.lit(0), F.col("total"), F.col("vocabulary")))
    groups = written(groups, "groups")
    cells = (
        kept.where(is_term)
        .join(groups, ["lang", "source"])
        .select(
            "lang", "source", "term",
            share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"),
            share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary")).alias("q"),
        )
    )
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = cells.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")
    )
    telling = telling.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    sized = groups.select("lang", "vocabulary", "sources").distinct()
    compared = pairs(cells, groups.select("lang", "source", "floor"), sized, block_cells)
    compared = compared.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    compared = compared.withColumn("rank", F.row_number().over(ranked))
    return compared.unionByName(telling)
