"""Exact comparison of 64-bit fingerprints within groups, tile pair by tile pair.

A group's rows form cells: one cell if the group is small, else a cell for each pair of its tiles.  Tiles hold about
``tile`` rows in order of population count, so tile pairs whose counts differ beyond the radius are never formed, and a
large group is spread over as many tasks as it has tile pairs.  Within a cell numpy compares by exclusive-or and bit counts,
block by block, and skips blocks whose population counts differ beyond the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Rows of a tile, about.
TILE = 4096
#: Cells of up to so many rows are compared together, row by row at each distance.
SMALL = 32


def cells(members: DataFrame, by: list[str], radius: int, tile: int = TILE) -> DataFrame:
    """``members``: fp, the columns ``by`` of its group, others.  Rows by cell: cell, side (0: one tile; 1, 2: tile pair), fp, others."""
    rest = [c for c in members.columns if c not in by]
    large = materialize(members.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select(*by), "tiles-large")
    whole = lambda df: df.select(F.xxhash64(*by).alias("cell"), F.lit(0).alias("side"), *rest)
    if not large.limit(1).count():
        return whole(members)
    inside = members.join(large, by).withColumn("_pop", F.bit_count("fp").cast("int"))
    ahead = Window.partitionBy(*by).orderBy("_pop").rowsBetween(Window.unboundedPreceding, -1)
    places = inside.groupBy(*by, "_pop").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    number = F.floor((F.col("_ahead") + F.pmod(F.xxhash64("fp"), F.col("_n"))) / tile).cast("int")
    tiled = inside.join(places, [*by, "_pop"]).select(*by, *rest, "_pop", number.alias("tile"))
    spans = materialize(tiled.groupBy(*by, "tile").agg(F.min("_pop").alias("lo"), F.max("_pop").alias("hi")), "tiles-spans")
    left = spans.select(*by, F.col("tile").alias("i"), F.col("hi").alias("end"))
    right = spans.select(*by, F.col("tile").alias("j"), F.col("lo").alias("begin"))
    meet = left.join(right, by).where((F.col("i") <= F.col("j")) & (F.col("begin") - F.col("end") <= radius)).select(*by, "i", "j")
    sides = meet.select(*by, "i", "j", F.col("i").alias("tile"), F.when(F.col("i") == F.col("j"), 0).otherwise(1).alias("side"))
    sides = sides.unionByName(meet.where("i < j").select(*by, "i", "j", F.col("j").alias("tile"), F.lit(2).alias("side")))
    cut = tiled.join(sides, [*by, "tile"]).select(F.xxhash64(*by, "i", "j").alias("cell"), "side", *rest)
    return whole(members.join(large, by, "left_anti")).unionByName(cut)


def _whole_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by cell, cut so that none ends inside a cell."""
    kept: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        cell = f["cell"].to_numpy()
        first = int(np.searchsorted(cell, cell[-1]))
        if first == 0 and (not kept or kept[-1]["cell"].iloc[-1] == cell[0]):
            kept.append(f)
            continue
        yield pd.concat([*kept, f.iloc[:first]])
        kept = [f.iloc[first:]]
    if kept:
        yield pd.concat(kept)


def map_cells(rows: DataFrame, find: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``find`` on runs of whole cells."""

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_cells(frames):
            yield find(f)

    return rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(batch, schema)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, block: int = 512) -> Iterator[np.ndarray]:
    """Index pairs (2 x n) of a and b, uint64 sorted by population count, that differ in at most ``radius`` bits."""
    pa, pb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    for i in range(0, len(a), block):
        x, lo, hi = a[i : i + block], pa[i], pa[min(i + block, len(a)) - 1]
        start, stop = np.searchsorted(pb, [lo - radius, hi + radius + 1])
        for j in range(start, stop, block):
            y = b[j : min(j + block, stop)]
            near = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            if len(near[0]):
                yield np.stack([near[0] + i, near[1] + j])


def cell_pairs(f: pd.DataFrame, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers of whole cells (columns cell, side, fp) that are within the radius, each pair once."""
    cell, side, fp = f["cell"].to_numpy(), f["side"].to_numpy(), f["fp"].to_numpy().view(np.uint64)
    edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True]) if len(cell) else np.zeros(1, dtype=int)
    sizes = np.diff(edges)
    at = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    c, s, x = cell[at], side[at], fp[at]
    for d in range(1, SMALL):
        k = np.flatnonzero(c[d:] == c[:-d])
        if not len(k):
            break
        k = k[(np.bitwise_count(x[k] ^ x[k + d]) <= radius) & ((s[k] + s[k + d] == 3) | (s[k] + s[k + d] == 0))]
        if len(k):
            yield at[k], at[k + d]
    for k in np.flatnonzero(sizes > SMALL).tolist():
        rows = np.arange(edges[k], edges[k + 1])
        rows = rows[np.argsort(np.bitwise_count(fp[rows]), kind="stable")]
        own, left, right = (rows[side[rows] == v] for v in (0, 1, 2))
        for p in close_pairs(fp[own], fp[own], radius):
            p = p[:, p[0] < p[1]]
            yield own[p[0]], own[p[1]]
        for p in close_pairs(fp[left], fp[right], radius):
            yield left[p[0]], right[p[1]]


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each item's least known partner, flat) after joining the items a and b pairwise."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
