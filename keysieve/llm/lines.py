"""Line deduplication with levelled sorted runs of line hashes.

A key is a line without outer white space and with A-Z in lower case. Of all lines
with the same key, those in the document with the smallest id stay. Documents are
taken in batches of ascending ids. The keys of a batch are merge-anti-joined with
the runs, sorted tables of keys that earlier batches have added; what is left is
new, and is written as a run of its own, with the smallest id of the batch that
holds it. Whenever a level has collected ``FANOUT`` runs, they are merged into one
run of the next level, so a key is rewritten once per level, and a batch meets a
number of runs that grows with the logarithm of the batches. Because ids ascend
from batch to batch, a run's owner of a key is the smallest id of all.

Only DataFrame operations. A key is two independent 64-bit hashes. Keys are reduced
before they are shuffled; the join that finds lines to drop may split a key that
many documents hold. Texts are shuffled once, to meet the places to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import LOWER, UPPER, fresh, written

BLANKS = " \t\n\x0b\x0c\r"
LEAST_LENGTH = 10
BATCHES = 4
FANOUT = 2
LAST_ID = (1 << 63) - 1


def line_keys(text: Column) -> Column:
    """The key of every line of a text, in order; a null text is one empty line."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))


def identity(doc_id: Column, text: Column) -> list[Column]:
    """A document's id, a null one last, and a hash that tells apart texts under one id."""
    return [F.coalesce(doc_id.cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("version")]


def keyed_lines(documents: DataFrame, least: int) -> DataFrame:
    """``(id, version, place, h1, h2)`` of every line whose key is long enough."""
    text = F.col("text")
    lines = documents.select(*identity(F.col("doc_id"), text), F.posexplode(line_keys(text)).alias("place", "key"))
    lines = lines.where(F.char_length("key") >= least)
    return lines.select("id", "version", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class Runs:
    """Sorted runs of ``(h1, h2, owner)`` by level; no key is in two of them."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def every(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, run: DataFrame, level: int = 0) -> None:
        """Writes a run sorted by key; a full level becomes one run of the next."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(written(run.sortWithinPartitions("h1", "h2"), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = full[0]
            for other in full[1:]:
                merged = merged.unionByName(other)
            self.add(merged.repartition("h1", "h2"), level + 1)

    def unknown(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds, by merge joins."""
        for run in self.every():
            keys = keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def all_keys(self) -> DataFrame:
        runs = self.every()
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        return merged


def bounds(documents: DataFrame, batches: int) -> list[int]:
    """Ids that part the documents into batches of about equal size."""
    shares = [(i + 1) / batches for i in range(batches - 1)]
    row = documents.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*map(F.lit, shares)), 1000).alias("at")).first()
    return sorted(set(row["at"] or [])) if shares else []


def lines_to_drop(documents: DataFrame, least: int = LEAST_LENGTH, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``(id, version, dropped)``: the places of lines that an earlier document holds too, ascending."""
    documents = documents.select("doc_id", "text")
    borders = bounds(documents, batches)
    batch = F.lit(0)
    for border in borders:
        batch = batch + (F.col("id") > border).cast("int")
    path = written_by_batch(keyed_lines(documents, least).withColumn("batch", batch))
    runs = Runs(fanout)
    for number in range(len(borders) + 1):
        keys = path.where(F.col("batch") == number).groupBy("h1", "h2").agg(F.min("id").alias("owner"))
        runs.add(runs.unknown(keys))
    owners = runs.all_keys()
    repeated = path.select("id", "version", "place", "h1", "h2").join(owners.hint("merge"), ["h1", "h2"]).where("id <> owner")
    return repeated.groupBy("id", "version").agg(F.sort_array(F.collect_set("place")).alias("dropped"))


def written_by_batch(lines: DataFrame) -> DataFrame:
    """The lines as a table with a folder per batch, so that a batch reads its own."""
    from keysieve.sources.scratch import scratch_path

    path = scratch_path(lines.sparkSession, "keyed-lines")
    lines.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    return lines.sparkSession.read.schema(lines.schema).parquet(path)


def deduplicated(documents: DataFrame, least: int = LEAST_LENGTH, batches: int = BATCHES, fanout: int = FANOUT,
                 counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents with their other columns, ``text`` without repeated lines, and two counts of lines.

    The counts, of lines before and of lines dropped, are called as ``counts`` says.

    A key of at least ``least`` code points that two documents hold keeps its lines
    in the document with the smallest id only, all of them. A null or empty text is
    one empty line and becomes the empty text. Rows that share an id are one
    document: they do not take lines from each other. A null id counts as the
    largest. An empty table gives no rows. Columns that are called like the
    counts are replaced by them.
    """
    dropped = lines_to_drop(documents, least, batches, fanout)
    names = [fresh(documents, n) for n in ("_id", "_version", "_dropped")]
    dropped = dropped.toDF(*names)
    id_, version, places = names
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = documents.withColumns(dict(zip((id_, version), identity(F.col("doc_id"), F.col("text")), strict=True)))
    joined = joined.join(dropped, [id_, version], "left")
    n_lines = F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1
    # All places in order, each with whether it is dropped: sorted, not looked up, so long texts stay cheap.
    every = F.sequence(F.lit(0), F.size(F.split(text, "\n", -1)) - 1)
    flags = F.concat(
        F.transform(F.array_except(every, F.col(places)), lambda i: F.struct(i.alias("i"), F.lit(True).alias("kept"))),
        F.transform(F.col(places), lambda i: F.struct(i.alias("i"), F.lit(False).alias("kept"))),
    )
    paired = F.zip_with(
        F.split(text, "\n", -1), F.array_sort(flags), lambda line, flag: F.struct(line.alias("line"), flag["kept"].alias("kept"))
    )
    kept = F.transform(F.filter(paired, lambda p: p["kept"]), lambda p: p["line"])
    result = joined.withColumns(
        {
            counts[0]: n_lines.cast("long"),
            counts[1]: F.coalesce(F.size(F.when(F.col(places).isNotNull(), F.col(places))), F.lit(0)).cast("long"),
            "text": F.when(F.col(places).isNull(), text).otherwise(F.array_join(kept, "\n")),
        }
    )
    return result.drop(*names)


def digests(deduped: DataFrame) -> DataFrame:
    """Counts and a hash of the kept text."""
    return deduped.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
