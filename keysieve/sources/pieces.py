"""Text files of any size as ordered pieces, and what one block hands on to the next.

Spark cuts a file into blocks and a block into pieces at a separator, so a file
is read by many tasks whatever it holds. A piece has a place: its file, the start
of its block, and a row number that ascends within the block. What depends on
everything before a piece is computed in two steps: within the block, by a window
over the block's pieces, and across blocks, by a window over one row per block.
No task holds more than a block, and the second window has a row per block of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

FILE, BLOCK, ROW = "_file", "_block", "_row"
PLACE = (FILE, BLOCK, ROW)


def read_pieces(spark: SparkSession, location: str, separator: str) -> DataFrame:
    """``(value, _file, _block, _row, _file_name, _file_size)`` and the partition columns of the folder.

    ``value`` is what stands before each separator, without it; bytes are kept as they are.
    """
    rows = spark.read.option("lineSep", separator).text(location)
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(ROW),
        F.col("_metadata.file_name").alias("_file_name"),
        F.col("_metadata.file_size").alias("_file_size"),
    )


def within() -> WindowSpec:
    """The pieces of a block in their order."""
    return Window.partitionBy(FILE, BLOCK).orderBy(ROW)


def so_far() -> WindowSpec:
    """From the start of the block to the piece itself."""
    return within().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def blocks_before() -> WindowSpec:
    """For one row per block: the blocks of the file before it."""
    return Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def sum_before(value: Column) -> Column:
    """The sum over the blocks before, 0 for the first."""
    return F.coalesce(F.sum(value).over(blocks_before()), F.lit(0).cast("long"))


def last_before(value: Column) -> Column:
    """The last value that is not null in the blocks before."""
    return F.last(value, ignorenulls=True).over(blocks_before())


def handed_on(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pieces with the columns that their block was handed."""
    return pieces.join(blocks, [FILE, BLOCK])
