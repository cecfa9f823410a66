"""Scanning what is new: the batch operators on Structured Streaming.

Detection is a narrow pass and runs on a stream as it is. Deduplication is an
aggregation by fingerprint, so Spark reduces each micro-batch before the
shuffle and keeps one row of state per fingerprint; an earlier commit that
arrives late updates the row. The state is kept in RocksDB, on the disks of the
executors, unless the session names another state store: a row holds a whole
finding, and a history has more of them than the executors have memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from keysieve.operators.dedup import keep_earliest
from keysieve.operators.detect import FINDING_COLUMNS, detect, detect_texts
from keysieve.operators.suppress import REPO, new_findings
from keysieve.sources.rulesets import RuleSet
from keysieve.sources.scratch import materialized

BATCH = "batch_id"
#: What tells the lines of a batch apart, as far as it is known.
LINE_KEY = ("path", "line_no", "line", "commit_sha")
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = {
    STATE_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def spread_lines(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """The lines of each micro-batch over so many tasks, as many as there are cores without a number.

    A batch of a few files is read by as many tasks, whatever the files weigh, and
    what follows would run in these alone.
    """
    key = [c for c in LINE_KEY if c in lines.columns]
    return lines.repartition(tasks or lines.sparkSession.sparkContext.defaultParallelism, *key)


def stream_findings(lines: DataFrame, ruleset: RuleSet, *, spread: bool = True, **options) -> DataFrame:
    """Findings of newly landed lines, which are spread over all cores first.

    Without ``spread`` they are found where they are read, without a shuffle: for
    sources whose batches have a split per core anyway.
    """
    return detect(spread_lines(lines) if spread else lines, ruleset, **options)


def stream_text_findings(texts: DataFrame, ruleset: RuleSet, **options) -> DataFrame:
    """Findings of newly landed texts."""
    return detect_texts(texts, ruleset, **options)


def stream_new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Streamed findings that the (static) baseline does not know.

    The keys of the baseline are written once; a micro-batch reads the table
    instead of making the baseline again.
    """
    known = materialized(baseline.select("fingerprint", *(c for c in (REPO,) if c in baseline.columns)).distinct(), "baseline")
    return new_findings(findings, known)


def stream_earliest(findings: DataFrame, **options) -> DataFrame:
    """One row per fingerprint, updated as earlier occurrences arrive."""
    return keep_earliest(findings, **options)


def write_appended(findings: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append findings to a parquet folder, exactly once."""
    writer = findings.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start(path)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started meanwhile keep their state in RocksDB, unless the session has chosen a state store.

    A query that goes on from a checkpoint keeps the state store it began with.
    """
    before = {name: spark.conf.get(name, None) for name in ON_DISK}
    if before[STATE_STORE] is None:
        for name, value in ON_DISK.items():
            spark.conf.set(name, before[name] or value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)


def write_changes(earliest: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the changes of each micro-batch below ``path``.

    A batch that is repeated after a failure overwrites its own folder. The state
    of the query is kept on disk, see :func:`state_on_disk`.
    """

    def put(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")

    writer = earliest.writeStream.outputMode("update").foreachBatch(put)
    with state_on_disk(earliest.sparkSession):
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _newest(changes: DataFrame) -> DataFrame:
    """The last change of each fingerprint, per repository if there are several."""
    key = [c for c in (REPO, "fingerprint") if c in changes.columns]
    columns = [c for c in changes.columns if c not in (BATCH, *key)]
    newest = F.max_by(F.struct(*columns), F.col(BATCH)).alias("row")
    return changes.groupBy(*key).agg(newest).select(*key, "row.*")


def latest_rows(spark: SparkSession, path: str) -> DataFrame:
    """The current row of each fingerprint from the changes written so far."""
    rows = _newest(spark.read.parquet(path))
    return rows.select(*FINDING_COLUMNS, *(c for c in (REPO,) if c in rows.columns))


def compact_changes(spark: SparkSession, path: str, into: str) -> None:
    """The current rows as a single folder below ``into``, with the number of the last batch.

    Every batch adds a folder, so a long-running stream should be moved now and
    then: stop it, compact, and go on writing and reading below ``into`` with the
    same checkpoint. What is read then is one row per fingerprint, and the changes
    since.
    """
    changes = spark.read.parquet(path)
    last = changes.agg(F.max(BATCH).alias("last")).first()["last"]
    if last is not None:
        _newest(changes).write.parquet(f"{into}/{BATCH}={last}")
