"""Array helpers built from higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def _starts(values: str, first: str) -> str:
    return f"""aggregate({values},
        struct(cast({first} AS bigint) AS at, cast(array() AS array<bigint>) AS out),
        (s, v) -> struct(s.at + v AS at, concat(s.out, array(s.at)) AS out),
        s -> s.out)"""


def running_starts(values: str) -> Column:
    """Sum of all earlier elements, for each element of a column of bigint arrays.

    Appending to an array copies it, so long arrays are summed block by block:
    a minified line with half a million matches stays far from quadratic.
    """
    blocks = f"""transform(sequence(0, cast(floor((size({values}) - 1) / {BLOCK}) AS int)),
        b -> slice({values}, b * {BLOCK} + 1, {BLOCK}))"""
    sums = f"transform({blocks}, b -> aggregate(b, 0L, (a, v) -> a + v))"
    return F.expr(
        f"""CASE WHEN size({values}) <= {BLOCK} THEN {_starts(values, '0')}
        ELSE flatten(zip_with({blocks}, {_starts(sums, '0')}, (b, first) -> {_starts('b', 'first')}))
        END"""
    )
