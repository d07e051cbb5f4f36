"""SimHash near-dedup: 64-bit fingerprints of word shingles, compared exactly in tiles.

Fingerprints are taken in Arrow batches where the texts are read; from there on only (doc_id, fingerprint) moves.
Equal fingerprints collapse to one row first, so a group of copies costs one comparison.

Two fingerprints within RADIUS bits agree on at least SEGMENTS - RADIUS of SEGMENTS bit segments, so comparing within
groups that agree on such a choice of segments loses no pair; with 5 segments and radius 3 there are ten choices of about
25 bits.  Groups are compared tile pair by tile pair (``tiles``), and a cell reports a spanning forest of its links, not
the links, so a large group of near copies makes rows in proportion to its size.

Defined cases: a null text counts as empty; a text without words has fingerprint 0 and links like any other; one or two
words are one shingle; a null ``doc_id`` links like any other and is never a component's id unless all its ids are null;
rows that repeat a ``doc_id`` each give a row; a very long text is fingerprinted whole, ``_CHUNK`` shingles at a time; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_documents, materialize, table
from .components import components
from .tiles import TILE, cell_pairs, cells, map_cells, union

RADIUS = 3
SEGMENTS = 5
SHINGLE = 3
#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both act on ASCII only
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=">u8", count=len(grams)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, big-endian 64-bit integers."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = np.array([fingerprint(t, shingle) for t in f["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": f["doc_id"], "fp": fp})

    return map_documents(docs, ["text"], batch, "fp bigint")


def segment_masks(segments: int = SEGMENTS, radius: int = RADIUS) -> list[int]:
    """A bit mask for each choice of segments - radius segments; any pair within the radius agrees under one of them."""
    edges = [round(64 * k / segments) for k in range(segments + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(choice) for choice in combinations(parts, segments - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, radius: int = RADIUS, segments: int | None = None, tile: int = TILE) -> DataFrame:
    """``fps``: distinct ``fp``.  Returns links (a, b) between fingerprints whose components are those of all close pairs."""
    segments = segments or (SEGMENTS if radius == RADIUS else radius + 2)
    masks = F.array(*[F.struct(F.lit(k).alias("choice"), F.lit(_signed(m)).alias("mask")) for k, m in enumerate(segment_masks(segments, radius))])
    keyed = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("m.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))

    def forest(f: pd.DataFrame) -> pd.DataFrame:
        fp, label = f["fp"].to_numpy(), np.arange(len(f))
        for a, b in cell_pairs(f, radius):
            label = union(label, a, b)
        linked = np.flatnonzero(label != np.arange(len(f)))
        return pd.DataFrame({"a": fp[linked], "b": fp[label[linked]]})

    return map_cells(cells(keyed, ["choice", "key"], radius, tile), forest, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links reach."""
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    links = materialize(near_links(groups.select("fp"), radius).distinct(), "simhash-links")
    joined = components(links)
    member = groups.join(joined, groups.fp == joined.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("least_fp"))
    member = materialize(member, "simhash-members")
    least = materialize(member.groupBy("least_fp").agg(F.min("first").alias("component_id")), "simhash-components")
    named = materialize(member.join(least, "least_fp").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
