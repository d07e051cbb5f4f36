"""The prefix trie against dictionaries of prefixes."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodeseam.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _brute(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda z: z[:2])] for c, v in turns.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = turns.get(base, [])[:h] + v[h:]
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids, leaves, saved = ({k: 0 for k in nodes} for _ in range(3))
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, m in nodes.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += kids[k] == 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        ((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], digest(c for c in m if len(built[c]) == len(k))) for k, m in nodes.items()),
        key=str,
    )


def _rows(found):
    ends = F.sha2(F.array_join(F.col("ends").cast("array<string>"), ",").cast("binary"), 256)
    return sorted((tuple(r) for r in found.withColumn("ends_sha256", ends).select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize(("cells", "shards"), [(40, 1), (40, 7), (10**6, 1), (10**6, 7)])
def test_nodes_equal_brute_force(spark, cells, shards):
    rnd = random.Random(cells + shards)
    rows = []
    for c in range(-3, 160):
        if rnd.random() < 0.9:
            for t in range(rnd.choice([1, 2, 3, 4, 9, 30] if rnd.random() < 0.3 else [1, 2, 3])):
                role = rnd.choice(["u", "a", None]) if rnd.random() < 0.1 else "ua"[t % 2]
                rows.append((c, None if rnd.random() < 0.02 and t == 0 else t, role, rnd.choice(["hi", "yo there", None, ""]) if rnd.random() < 0.6 else "same"))
    df = spark.createDataFrame([*rows, (None, 1, "u", "x")], SCHEMA).withColumn("strip", F.lit(3)).withColumn("key", F.lit("k"))
    found = prefix_trie.build_trie(prefix_trie.rebuild(prefix_trie.sequences(df)), shards, cells)
    assert _rows(found) == _brute(rows)


def test_copies_fill_several_shards(spark):
    """A third of all conversations are one, whose nodes lie in many shards and strips."""
    rows = [(c, t, "u", "same words here") for c in range(0, 900, 20) for t in range(4)] + [(c, t, "u", f"{c % 7} {t}") for c in range(901, 960) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = prefix_trie.build_trie(prefix_trie.sequences(df), 9, 12)
    nodes = {(r["depth"], r["n_convs"]): r for r in found.collect()}
    hot = nodes[(4, 45)]
    assert (hot["conv_id"], hot["n_children"], hot["n_leaves"], hot["saved_tokens"]) == (0, 0, 1, 44 * 3)
    assert hot["ends"] == list(range(0, 900, 20)) and nodes[(0, 104)]["n_children"] == 8


def test_edges(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    long = [(1, t, "u", "w " * (t % 3)) for t in range(300)] + [(2, t, "u", "w " * (t % 3)) for t in range(290)]
    rows = [*long, (20, None, None, None), (20, None, None, None), (21, 0, "u", "x" * 100_000)]
    assert _rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))[:50] == _brute(rows)[:50]


def test_generated_table(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    try:
        df = spark.read.parquet(path)
    except Exception:
        pytest.skip("no tables here")
    assert _rows(prefix_trie.prefix_trie(df)) == _brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
