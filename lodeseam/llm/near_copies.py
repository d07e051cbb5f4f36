"""Near copies: SimHash tiles find candidates, exact similarity of five-word shingle sets confirms them.

Two texts are near copies if their sets of lower-cased five-word shingles (64-bit hashes) have a Jaccard similarity of 0.8
or more.  A set has a 64-bit SimHash and MINS minimum hashes.  Sets that share the value of a minimum hash form a group,
whose SimHashes are compared exactly in tiles.  A pair within RADIUS bits, of sizes that permit the similarity and with at
least AGREE of the SKETCH and WIDE_AGREE of the WIDE minimum hashes in common is a candidate, and candidates are confirmed on
the full sets.

What can be lost is a pair the filters miss; at a similarity of exactly 0.8 that is 0.2^6 (no shared group), about 0.001
(RADIUS), 0.0003 (AGREE) and 0.002 (WIDE_AGREE), less above it.  Nothing below the bound is ever linked.

Equal sets collapse to one row first.  A first pass over the groups only marks rows that have a candidate there; the sets of
those rows then join their groups, and a second pass confirms candidates where they meet.  It skips pairs that links
already join and reports a spanning forest, so however large a group of near copies is, rows are in proportion to its size.

Defined cases: a null text counts as empty; texts without words are copies of each other; fewer than five words are one
shingle; ``key`` is unique and never null; a very long text is taken whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .simhash import majority
from .tiles import cell_pairs, cells, map_cells, union

SHINGLE = 5
RADIUS = 18
#: Minimum hashes that form groups, minimum hashes of the sketch in a group, and how many of those a candidate shares.
MINS, SKETCH, AGREE = 6, 16, 7
#: Minimum hashes of the wide sketch, and how many of those a candidate shares before its sets are read.
WIDE, WIDE_AGREE = 64, 42
#: Odd multipliers without small ratios: each orders the shingle hashes anew.
_TURNS = np.array([xxhash.xxh64_intdigest(bytes([k])) | 1 for k in range(WIDE)], dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both act on ASCII only
    if not words:
        return np.empty(0, dtype=np.uint64)
    grams = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64))


def similar(overlap, a, b):
    """Whether sets of sizes a and b with that overlap have a similarity of 0.8: overlap / (a + b - overlap) >= 4 / 5."""
    return 9 * overlap >= 4 * (a + b)


def prints(docs: DataFrame, key: str) -> DataFrame:
    """key, digest of the set, n, fp, groups (minimum hashes), and mins, sketch and wide: the same and 16 bits of more, packed."""

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, text in zip(f["key"], f["text"], strict=True):
                s = shingles(text)
                least = np.array([(s * t).min() for t in _TURNS], dtype=np.uint64) if len(s) else np.empty(0, dtype=np.uint64)
                fp = np.uint64(majority(s.astype(">u8"))).astype(np.int64)
                short = least.astype(np.uint16)
                rows.append((k, xxhash.xxh3_128_hexdigest(s.tobytes()), len(s), fp, least[:MINS].view(np.int64), least[:MINS].tobytes(), short[:SKETCH].tobytes(), short.tobytes()))
            yield pd.DataFrame(rows, columns=["key", "digest", "n", "fp", "groups", "mins", "sketch", "wide"])

    schema = "key bigint, digest string, n int, fp bigint, groups array<bigint>, mins binary, sketch binary, wide binary"
    return docs.select(F.col(key).alias("key"), "text").mapInPandas(batch, schema)


def _likely(f: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs in a cell that pass the filters on sizes, fingerprints and sketches."""
    n, sketch = f["n"].to_numpy(), np.frombuffer(b"".join(f["sketch"]), dtype=np.uint16).reshape(-1, SKETCH)
    for a, b in cell_pairs(f, RADIUS):
        may = 5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])
        a, b = a[may], b[may]
        may = (sketch[a] == sketch[b]).sum(axis=1) >= AGREE
        if may.any():
            yield a[may], b[may]


def _marked(f: pd.DataFrame) -> pd.DataFrame:
    """The rows of cells that have a candidate."""
    met = np.zeros(len(f), dtype=bool)
    for a, b in _likely(f):
        met[a] = met[b] = True
    return f.loc[met, ["key", "cell", "side", "turn"]]


def _linked(f: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the similar pairs of cells.  A pair is looked at in the first group that it shares only."""
    key, n, turn = f["key"].to_numpy(), f["n"].to_numpy(), f["turn"].to_numpy()
    mins, wide = (np.stack([np.frombuffer(x, dtype=t) for x in f[c]]) for c, t in (("mins", np.int64), ("wide", np.uint16)))
    sets = [np.frombuffer(x, dtype=np.uint64) for x in f["hashes"]]
    label, out = np.arange(len(f)), [np.empty((2, 0), dtype=np.int64)]
    for a, b in _likely(f):
        earlier = ((mins[a] == mins[b]) & (np.arange(MINS)[None, :] < turn[a][:, None])).any(axis=1)
        fit = ~earlier & ((wide[a] == wide[b]).sum(axis=1) >= WIDE_AGREE)
        a, b = a[fit], b[fit]
        while len(a):
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            first = np.unique(b, return_index=True)[1]  # one pair of each row at a time: most rows are linked by it
            overlap = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True)], dtype=np.int64)
            good = first[similar(overlap, n[a[first]], n[b[first]])]
            label = union(label, a[good], b[good])
            out.append(np.stack([key[a[good]], key[b[good]]]))
            rest = np.ones(len(a), dtype=bool)
            rest[first] = False
            a, b = a[rest], b[rest]
    found = np.concatenate(out, axis=1)
    return pd.DataFrame({"a": found[0], "b": found[1]})


def near_copies(docs: DataFrame, key: str) -> DataFrame:
    """(key, component): the least key that links of similarity 0.8 reach, for every row."""

    def hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "hashes": [shingles(t).tobytes() for t in f["text"]]})

    found = materialize(prints(docs, key), "copies-prints")
    groups = materialize(found.groupBy("digest").agg(F.min("key").alias("first")), "copies-digests")
    reps = found.join(groups.select(F.col("first").alias("key")), "key", "left_semi")
    members = reps.select("key", "n", "fp", "sketch", F.posexplode("groups").alias("turn", "least"))
    placed = cells(members.select("*", F.col("turn").alias("_t")), ["_t", "least"], RADIUS)
    marked = materialize(map_cells(placed, _marked, "key bigint, cell bigint, side int, turn int"), "copies-marked")
    needed = materialize(marked.select("key").distinct(), "copies-needed")
    named = docs.select(F.col(key).alias("key"), "text").join(needed, "key", "left_semi")
    sets = materialize(named.mapInPandas(hashes, "key bigint, hashes binary"), "copies-sets")
    rows = marked.join(reps.select("key", "n", "fp", "sketch", "mins", "wide"), "key").join(sets, "key")
    links = materialize(map_cells(rows, _linked, "a bigint, b bigint").distinct(), "copies-links")
    joined = components(links)
    least = groups.join(joined, F.col("first") == F.col("node"), "left").select("digest", F.coalesce("component", "first").alias("component"))
    return found.join(least, "digest").select(F.col("key").alias(key), "component")
