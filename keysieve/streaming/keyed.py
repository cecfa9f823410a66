"""Streams that run for ever: state that expires, tables that are merged as they grow.

Deduplication keeps a small state for each fingerprint, no more than what decides
whether a new occurrence matters, and drops it when the fingerprint has not been
seen for a while. That loses nothing: what leaves the operator are parts of an
aggregation, and the table they are merged into is the lasting state. A commit that
arrives late, or a secret that returns after its state has expired, is one more
part. The states of the fingerprints that share a bucket are kept in one row: the
operator is called once per bucket, which costs as much as hundreds of fingerprints.
Every so many batches the parts are merged into one row per fingerprint, once they
weigh as much as what was merged before, and what has been merged is deleted.

A baseline that grows is a table of keys with a version per addition; every
micro-batch is compared with the newest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keysieve.functions.text import content_key
from keysieve.operators.dedup import merged, occurrences, rows_of
from keysieve.operators.suppress import REPO, new_findings

BATCH, UPTO, VERSION = "batch_id", "upto", "version"
PARTS = ("seen", "shown", "placed", "place")
COMPACT_EVERY = 16
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
STATE = "known string"
#: Rows of state, each for the fingerprints that share it; fixed for the life of a checkpoint.
BUCKETS = 1 << 14
#: Parts that weigh less than what was merged before are merged after so many times the usual number of batches.
PATIENCE = 16


def ordered(value):
    """A value read from JSON so that it compares as the struct it was made of: field by field, nulls first."""
    if isinstance(value, dict):
        return (1, *(ordered(v) for v in value.values()))
    return (0,) if value is None else (1, value)


def _better(order: str, best: str | None) -> bool:
    return best is None or (order != best and ordered(json.loads(order)) < ordered(json.loads(best)))


def _changes(idle_ms: int, names: list[str]):
    """The function of the stateful operator: for a bucket, one part per batch and key that changed anything.

    The state holds ``[seen, placed, time]`` of each key of the bucket that was seen within ``idle_ms``.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        stored = json.loads(state.get[0]) if state.exists else []
        known = {tuple(k): best for k, best in stored if now - best[2] < idle_ms}
        parts: dict[tuple, list] = {}
        for rows in batches:
            keys = zip(*(rows[n].tolist() for n in names))
            for each, *found, hits in zip(keys, *(rows[n].tolist() for n in (*PARTS, "hits"))):
                seen, shown, placed, place = found
                best, part = known.setdefault(each, [None, None, now]), parts.setdefault(each, [None, None, None, None, 0])
                if _better(seen, best[0]):
                    best[0], part[0], part[1] = seen, seen, shown
                if _better(placed, best[1]):
                    best[1], part[2], part[3] = placed, placed, place
                best[2] = now
                part[4] += int(hits)
        state.update((json.dumps(list(known.items())),))
        state.setTimeoutDuration(idle_ms)
        changed = [(*each, *part) for each, part in parts.items() if part[0] is not None or part[2] is not None or part[4]]
        if changed:
            yield pd.DataFrame(changed, columns=[*names, *PARTS, "hits"])

    return update


def stream_parts(findings: DataFrame, *, idle_ms: int, buckets: int = BUCKETS, **options) -> DataFrame:
    """Streamed findings as the parts that change their fingerprint's row, for :func:`write_merged`.

    The state of a fingerprint expires after so many milliseconds without an
    occurrence; it is dropped when its bucket is next used, or with the bucket if
    none of its fingerprints is seen for as long. A batch rewrites the buckets it
    uses. Takes the options of :func:`keysieve.operators.dedup.keep_earliest`.
    """
    each = occurrences(findings, **options)
    names = [c for c in (REPO, "fingerprint") if c in each.columns]
    kinds = {name: each.schema[name].dataType for name in PARTS}
    as_text = [F.to_json(name, {"ignoreNullFields": "false"}).alias(name) for name in PARTS]
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in (*names, *PARTS)), T.StructField("hits", T.LongType())])
    changed = (
        each.select(F.pmod(F.xxhash64(*names), F.lit(buckets)).alias("bucket"), *names, *as_text, "hits")
        .groupBy("bucket")
        .applyInPandasWithState(_changes(idle_ms, names), schema, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    )
    return changed.select(*names, *(F.from_json(n, kinds[n]).alias(n) for n in PARTS), "hits")


class Folder:
    """Numbered tables below a folder, ``<name>=<number>``, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name
        gateway = spark.sparkContext._jvm
        self.place = gateway.org.apache.hadoop.fs.Path
        self.system = self.place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, number: int) -> str:
        return f"{self.path}/{self.name}={number}"

    def numbers(self) -> list[int]:
        """The tables that were written to their end, in ascending order."""
        try:
            found = [s.getPath() for s in self.system.listStatus(self.place(self.path))]
        except Py4JJavaError as problem:
            if "FileNotFoundException" in str(problem.java_exception):
                return []
            raise
        done = [p for p in found if p.getName().startswith(f"{self.name}=") and self.system.exists(self.place(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def size(self, numbers: list[int]) -> int:
        """Bytes of these tables."""
        return sum(self.system.getContentSummary(self.place(self.at(n))).getLength() for n in numbers)

    def drop(self, numbers: list[int]) -> None:
        for number in numbers:
            self.system.delete(self.place(self.at(number)), True)

    def read(self, numbers: list[int]) -> DataFrame:
        return self.spark.read.parquet(*(self.at(n) for n in numbers))


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[int], list[int]]:
    """The newest merged table with the changes since; the numbers of merged tables, and of all changes."""
    done, changes = Folder(spark, f"{path}/merged", UPTO), Folder(spark, f"{path}/changes", BATCH)
    upto, batches = done.numbers(), changes.numbers()
    since = [b for b in batches if not upto or b > upto[-1]]
    frames = ([done.read(upto[-1:])] if upto else []) + ([changes.read(since)] if since else [])
    whole = frames[0].unionByName(frames[1]) if len(frames) == 2 else frames[0] if frames else None
    return whole, upto, batches


def write_merged(parts: DataFrame, path: str, checkpoint: str, *, every: int = COMPACT_EVERY, **trigger) -> StreamingQuery:
    """Keep the parts of each micro-batch below ``path``, and merge them every so many batches.

    Parts that are less than what was merged before wait for more of them, so that a
    table is not written again for every few batches: the work of all merges is in
    proportion to the parts, not to their square. They wait ``PATIENCE`` times as
    many batches at most, which bounds the number of folders.

    A batch that is repeated after a failure overwrites its own folder. A merged
    table counts once it is complete; what it replaces is deleted one merge later,
    so that a reader who has just listed the folders still finds its files.
    """

    def put(changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        changes.write.mode("overwrite").parquet(f"{path}/changes/{BATCH}={batch}")
        if (batch + 1) % every:
            return
        whole, upto, batches = _parts(spark, path)
        if upto and upto[-1] >= batch:  # a repeated batch: its parts are merged already
            return
        since = [b for b in batches if not upto or b > upto[-1]]
        if upto and len(since) < every * PATIENCE:
            weight = Folder(spark, f"{path}/changes", BATCH).size(since)
            if weight < Folder(spark, f"{path}/merged", UPTO).size(upto[-1:]):
                return
        merged(whole).write.mode("overwrite").parquet(f"{path}/merged/{UPTO}={batch}")
        if upto:
            Folder(spark, f"{path}/changes", BATCH).drop([b for b in batches if b <= upto[-1]])
            Folder(spark, f"{path}/merged", UPTO).drop(upto[:-1])

    # states expire in batches that bring data; otherwise a query that expires states would run empty batches for ever
    settings = parts.sparkSession.conf
    before = settings.get(EMPTY_BATCHES, "true")
    settings.set(EMPTY_BATCHES, "false")
    try:
        writer = parts.writeStream.outputMode("append").foreachBatch(put)
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        settings.set(EMPTY_BATCHES, before)


def merged_rows(spark: SparkSession, path: str, **options) -> DataFrame | None:
    """The current row of each fingerprint; None before the first batch."""
    whole, _, _ = _parts(spark, path)
    return None if whole is None else rows_of(merged(whole), **options)


def add_known(findings: DataFrame, path: str) -> int:
    """Adds the keys of findings to a growing baseline; the number of its new version.

    One writer at a time; readers see a version once it is complete.
    """
    folder = Folder(findings.sparkSession, path, VERSION)
    versions = folder.numbers()
    version = versions[-1] + 1 if versions else 0
    keys = findings.filter(F.col("fingerprint") != "")
    repo = [c for c in (REPO,) if c in findings.columns]
    keys.select(*repo, "fingerprint").dropDuplicates([*repo, "fingerprint"]).write.mode("overwrite").parquet(folder.at(version))
    return version


def known_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The keys of a growing baseline up to a version, the newest without one; None if it is empty."""
    folder = Folder(spark, path, VERSION)
    versions = [v for v in folder.numbers() if version is None or v <= version]
    return folder.read(versions) if versions else None


def merge_known(spark: SparkSession, path: str) -> None:
    """All keys of a growing baseline as one version; older ones are deleted."""
    folder = Folder(spark, path, VERSION)
    versions = folder.numbers()
    if len(versions) > 1:
        keys = folder.read(versions)
        names = [c for c in (REPO,) if c in keys.columns]
        one = keys.withColumn("_key", content_key(F.col("fingerprint"))).dropDuplicates([*names, "_key"]).drop("_key")
        one.write.mode("overwrite").parquet(folder.at(versions[-1] + 1))
        folder.drop(versions)


def write_new(findings: DataFrame, baseline: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the streamed findings that the growing baseline does not know when their batch is run.

    The newest version is looked up for every micro-batch. A batch that is repeated
    after a failure overwrites its own folder, with the keys known by then.
    """

    def put(batch_findings: DataFrame, batch: int) -> None:
        known = known_at(batch_findings.sparkSession, baseline)
        fresh = batch_findings if known is None else new_findings(batch_findings, known)
        fresh.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")

    writer = findings.writeStream.outputMode("append").foreachBatch(put)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


