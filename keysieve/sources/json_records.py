"""The objects of one array in a JSON document, in any layout, read by many tasks.

The document is cut at closing braces. Whether a cut lies inside a string follows
from the number of quotation marks before it, and how deep it lies from the
brackets outside strings; both are sums over what stands before, so blocks add up
their own part twice, as if they began outside a string and as if inside, and the
sums of the blocks before tell which holds. An object of the array ends where the
depth comes back to that of the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysieve.sources.pieces import BLOCK, FILE, ROW, handed_on, read_pieces, so_far, sum_before
from keysieve.sources.scratch import materialized

ARRAY_DEPTH = 2  # a member of the document's object


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _opened(text: Column) -> Column:
    """Brackets that text outside strings opens, less those it closes; it holds no closing brace."""
    bare = F.regexp_replace(text, '"[^"]*("|$)', "")
    return (_count(bare, "{") + _count(bare, "[") - _count(bare, "]")).cast("long")


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, number, text, last)``: each file of the path is one document.

    ``text`` reaches from the end of the object before to the closing brace of this
    one: the first holds the start of the document as well, and the row marked
    ``last`` is what follows the array's last object. Rows are written once.
    """
    pieces = read_pieces(spark, path, "}")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = pieces.withColumns({"_marks": _count(bare, '"').cast("long"), "_outside": _opened(bare), "_inside": _opened(F.concat(F.lit('"'), bare))})
    marks_before = F.col("_marks_so_far") - F.col("_marks")
    steps = pieces.withColumn("_marks_so_far", F.sum("_marks").over(so_far()))

    def step(start: int) -> Column:
        """The change of depth up to and with the closing brace, if the block starts outside (0) or inside a string."""
        inside = (marks_before + start) % 2 == 1
        ends_outside = (F.col("_marks_so_far") + start) % 2 == 0
        return F.when(inside, F.col("_inside")).otherwise(F.col("_outside")) - ends_outside.cast("long")

    steps = steps.withColumns({"_step0": step(0), "_step1": step(1)})
    placed = steps.select(
        FILE, BLOCK, ROW, "value", "_file_size", "_marks", "_marks_so_far", "_step0", "_step1",
        *(F.sum(f"_step{s}").over(so_far()).alias(f"_depth{s}") for s in (0, 1)),
    )
    placed = materialized(placed, "json-pieces")
    totals = placed.groupBy(FILE, BLOCK).agg(
        F.sum("_marks").alias("_marks_all"), F.sum("_step0").alias("_step0_all"), F.sum("_step1").alias("_step1_all"),
        F.sum(F.octet_length("value") + 1).alias("_bytes"), F.first("_file_size").alias("_size"),
    )
    started = totals.withColumn("_inside", sum_before(F.col("_marks_all")) % 2 == 1)
    own = F.when(F.col("_inside"), F.col("_step1_all")).otherwise(F.col("_step0_all"))
    whole = Window.partitionBy(FILE)
    started = started.select(
        FILE, BLOCK, "_inside", sum_before(own).alias("_depth"),
        (F.sum("_bytes").over(whole) > F.col("_size")).alias("_open_end"),
    )
    resolved = handed_on(placed, started)
    after = F.col("_depth") + F.when(F.col("_inside"), F.col("_depth1")).otherwise(F.col("_depth0"))
    outside = (F.col("_marks_so_far") + F.col("_inside").cast("int")) % 2 == 0
    ends = resolved.select(
        FILE, BLOCK, ROW, "value", "_open_end", (outside & (after == ARRAY_DEPTH)).cast("long").alias("_ends")
    )
    counted = ends.withColumn("_ended", F.sum("_ends").over(so_far()) - F.col("_ends"))
    before = counted.groupBy(FILE, BLOCK).agg(F.sum("_ends").alias("_all")).select(FILE, BLOCK, sum_before(F.col("_all")).alias("_earlier"))
    records = (
        handed_on(counted, before)
        .withColumn("number", F.col("_earlier") + F.col("_ended"))
        .groupBy(F.col(FILE).alias("file"), "number")
        .agg(
            F.array_sort(F.collect_list(F.struct(BLOCK, ROW, "value"))).alias("_parts"),
            (F.max("_ends") == 0).alias("last"),
            F.first("_open_end").alias("_open_end"),
        )
    )
    text = F.array_join(F.transform("_parts", lambda part: part["value"]), "}")
    brace = F.when(F.col("last") & F.col("_open_end"), "").otherwise("}")
    return materialized(records.select("file", "number", F.concat(text, brace).alias("text"), "last"), "json-records")
