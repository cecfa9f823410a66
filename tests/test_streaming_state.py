from pyspark.sql import functions as F

from keysieve.operators.dedup import keep_earliest
from keysieve.operators.detect import detect
from keysieve.streaming import incremental as I

from test_streaming import SCHEMA, row, same


def written(spark, path, count=400):
    rows = [row(n, n, "2024-01-01", f"AKIAFAKEKEYABC{'ABCDEFGHIJ'[n % 10]}{'KLMNOPQRST'[n // 10 % 10]}{'UVWX'[n // 100]}345") for n in range(count)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def test_lines_of_one_file_are_detected_by_several_tasks(spark, rules, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    table = written(spark, source)
    for spread, tasks in ((True, 4), (False, 1)):
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        found = I.stream_findings(stream, rules, spread=spread).withColumn("task", F.spark_partition_id())
        here = f"{out}-{spread}"
        I.write_appended(found, here, here + "-progress", availableNow=True).awaitTermination()
        rows = spark.read.schema(found.schema).parquet(here)
        assert rows.select("task").distinct().count() >= tasks
        assert spread or rows.select("task").distinct().count() == 1
        assert same(rows, detect(table, rules))


def test_state_is_kept_on_disk_unless_the_session_says_otherwise(spark, rules, tmp_path):
    source = str(tmp_path / "in")
    batch = keep_earliest(detect(written(spark, source), rules, keep=("seq",)))
    chosen = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    for name in ("default", "chosen"):
        out = str(tmp_path / name)
        if name == "chosen":
            spark.conf.set(I.STATE_STORE, chosen)
        try:
            earliest = I.stream_earliest(I.stream_findings(spark.readStream.schema(SCHEMA).parquet(source), rules, keep=("seq",)))
            query = I.write_changes(earliest, out, out + "-progress", availableNow=True)
            query.awaitTermination()
            assert spark.conf.get(I.STATE_STORE, None) == (chosen if name == "chosen" else None)
        finally:
            spark.conf.unset(I.STATE_STORE)
        metrics = [m for p in query.recentProgress for s in p["stateOperators"] for m in s["customMetrics"]]
        assert any(m.startswith("rocksdb") for m in metrics) == (name == "default")
        assert same(I.latest_rows(spark, out), batch)
