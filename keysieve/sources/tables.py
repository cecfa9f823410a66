"""Tables as input: any table with a path and a text, or lines ready made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(frame: DataFrame) -> DataFrame:
    """Rows over at least as many tasks as there are cores.

    For frames read straight from files. A table in one or two large row groups
    would be scanned by one or two tasks; only such a narrow table is shuffled.
    One with enough splits, as any large table has, is returned as it is.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores)


def texts_from(frame: DataFrame, path: Column | str, text: Column | str) -> DataFrame:
    """``(path, text)`` from any table or stream."""

    def named(value: Column | str, name: str) -> Column:
        return (F.col(value) if isinstance(value, str) else value).alias(name)

    return frame.select(named(path, "path"), named(text, "text"))


def read_texts(spark: SparkSession, location: str, path: str, text: str) -> DataFrame:
    """``(path, text)`` from a parquet table; ``path`` and ``text`` are SQL expressions."""
    return spread(texts_from(spark.read.parquet(location), F.expr(path), F.expr(text)))
