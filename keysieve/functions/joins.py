"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: A key is hot if it owns this share of the rows or more, so there are at most as many as its inverse.
HOT_SHARE = 0.01
SKETCH_ITEMS = 10_000


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def hot_keys(frame: DataFrame, keys: list[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of the keys that own at least this share of the rows: a frequent-items sketch, merged from all tasks.

    The sketch never misses a key above its error, which is far below the share;
    what it gives are at most ``1 / share`` hashes, whatever the size of the frame.
    """
    most = max(1, int(1 / share))
    counted = frame.select(key_hash(keys).alias("_key")).agg(
        F.expr(f"approx_top_k(_key, {2 * most}, {max(SKETCH_ITEMS, 8 * most)})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    row = counted.first()
    return sorted(item["item"] for item in row["top"] or () if item["count"] >= share * row["n"])


def salted_lookup(
    frame: DataFrame, lookup: DataFrame, keys: list[str], spread_by: list[str], salts: int = SALTS, hot: list[int] | None = None
) -> DataFrame:
    """Left join with a table that has one row per key.

    The rows of a hot key go to ``salts`` partitions, chosen by the ``spread_by``
    columns, and its row of the lookup is repeated once per salt. ``hot`` lists the
    hashes of such keys, from :func:`hot_keys`; without it, every key counts as hot.
    With ``hot``, adaptive execution broadcasts the lookup if it measures small. Without,
    both sides are shuffled: the planner's estimate does not count the repetition, and
    a lookup of a few megabytes would be sent to the driver ``salts`` times over.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is not None:
        is_hot = key_hash(keys).isin(hot) if hot else F.lit(False)
        salt = F.when(is_hot, salt).otherwise(F.lit(0))
        every = F.when(is_hot, every).otherwise(F.array(F.lit(0)))
    repeated = lookup.withColumn("_salt", F.explode(every))
    if hot is None:
        repeated = repeated.hint("merge")
    return frame.withColumn("_salt", salt).join(repeated, [*keys, "_salt"], "left").drop("_salt")
