"""Ranges that overlap within a key, by bins: a hot file's ranges are spread over as many tasks as it has bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines in a bin.
WIDTH = 64


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """Pairs of rows with equal ``on`` whose inclusive ranges overlap, each once.

    A range is filed under every bin it touches.  Two ranges that overlap share a bin, and their first common one is the
    later of their first bins: only there are they paired.  Rows with a null bound, or whose end lies before their start,
    overlap nothing.
    """
    bin_of = lambda c: F.floor(F.col(c) / width)

    def filed(rows: DataFrame, bounds: tuple[str, str], first: str) -> DataFrame:
        some = rows.where(F.col(bounds[0]) <= F.col(bounds[1]))
        return some.withColumn(first, bin_of(bounds[0])).withColumn("_bin", F.explode(F.sequence(bin_of(bounds[0]), bin_of(bounds[1]))))

    meet: Column = (F.col(left_range[0]) <= F.col(right_range[1])) & (F.col(right_range[0]) <= F.col(left_range[1]))
    pairs = filed(left, left_range, "_first_left").join(filed(right, right_range, "_first_right"), [*on, "_bin"])
    return pairs.where(meet & (F.col("_bin") == F.greatest("_first_left", "_first_right"))).drop("_bin", "_first_left", "_first_right")
