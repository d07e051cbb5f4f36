"""Removed repeats against a set of all windows seen so far."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodeseam.llm import repeats

SCHEMA = "doc_id bigint, text string"
SMALL = {"block_size": 3000, "strip": 1 << 10, "part_size": 20_000, "members_size": 50}


def _brute(docs, length=100):
    seen, rows = set(), []
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone, done = bytearray(len(raw) + 1), 0
        for s in range(len(raw) - length + 1):
            window = raw[s : s + length]
            if window in seen:
                for k in range(max(s, done), s + length):
                    gone[k] = 1
                done = s + length
            seen.add(window)
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        rows.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=str)


def _rows(found):
    found = found.select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256))
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_passages_over_many_blocks(spark, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(["ab", "c", "d é", "ef ", "gh", "ij日"]) for _ in range(rnd.randrange(200))) for _ in range(12)]
    docs = []
    for _ in range(90):
        text = "".join(rnd.choice(base)[rnd.randrange(60) : rnd.randrange(60, 500)] for _ in range(rnd.randrange(5)))
        if rnd.random() < 0.1:
            text = rnd.choice(["a", "abcde ", "日"]) * rnd.randrange(300)
        docs.append((rnd.choice([None, 7, 7]) if rnd.random() < 0.1 else rnd.randrange(1000), None if rnd.random() < 0.05 else text))
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA + ", unit int, bytes string").coalesce(1)
    assert _rows(repeats.remove_repeats(df, **SMALL)) == _brute(docs)
    assert _rows(repeats.remove_repeats(df, length=60, gram=9, **SMALL)) == _brute(docs, 60)


def test_common_passage_with_other_surroundings(spark):
    """A passage that every text holds, at another place and between other words each time."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    passage = " ".join(word() for _ in range(25))
    docs = [(k, " ".join([*(word() for _ in range(rnd.randrange(40))), passage[: rnd.randrange(95, 200)], *(word() for _ in range(20))])) for k in range(150)]
    df = spark.createDataFrame(docs, SCHEMA).coalesce(1)
    assert _rows(repeats.remove_repeats(df, **SMALL)) == _brute(docs)


def test_edges(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = [(1, None), (2, ""), (3, "x" * 99), (4, "y" * 100), (5, "y" * 101), (6, "0123456789" * 30_000), (None, "0123456789" * 30), (6, "short")]
    assert _rows(repeats.remove_repeats(spark.createDataFrame(docs, SCHEMA).coalesce(1))) == _brute(docs)


def test_sample(spark, sample):
    assert _rows(repeats.remove_repeats(sample, block_size=50_000)) == _brute([(r["doc_id"], r["text"]) for r in sample.collect()])
