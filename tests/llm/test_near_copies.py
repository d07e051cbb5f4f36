"""Near copies against all pairs of five-word sets."""

import random
import re

import corpus_pipeline
from lodeseam.llm import near_copies, tiles

SCHEMA = "doc_id bigint, text string, lang string, source string"


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _components(rows):
    sets, root = {k: _shingles(t) for k, t in rows}, {k: k for k, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            either = len(sets[a] | sets[b])
            if a < b and (not either or 5 * len(sets[a] & sets[b]) >= 4 * either):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root}


def _families(groups, each):
    rng = random.Random(3)
    shared = [f"common{i}" for i in range(40)]
    texts = []
    for g in range(groups):
        words = shared + [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 60, 400]))]
        for c in range(each):
            copy = list(words)
            for _ in range(c * len(words) // 200):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    return texts


def test_links_of_brute_force_are_found(spark, sample):
    """Links are exact; one in a thousand may be missed, so these 500 texts miss none."""
    found = [r["text"] for r in sample.select("text").collect()]
    texts = found + _families(12, 8) + [None, "", " \n", "x", "X", "one two three four", "a b c d e", "A b\tc d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row_key bigint, text string").repartition(3)
    got = {r["row_key"]: r["component"] for r in near_copies.near_copies(docs, "row_key").collect()}
    assert got == _components(list(enumerate(texts)))
    assert len(set(got.values())) < len(texts) - 20


def test_recall_over_all_pairs(spark):
    """Pairs just above the bound: at least 99 of 100 are candidates, and none below it is linked."""
    rng, rows, pairs = random.Random(11), [], []
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 120, 400]))]
        copy = list(words)
        for _ in range(max(1, round(len(words) * rng.uniform(0.01, 0.03)))):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        a, b = _shingles(" ".join(words)), _shingles(" ".join(copy))
        pairs.append(5 * len(a & b) >= 4 * len(a | b))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "row_key bigint, text string").repartition(3)
    got = {r["row_key"]: r["component"] for r in near_copies.near_copies(docs, "row_key").collect()}
    linked = [got[2 * k] == got[2 * k + 1] for k in range(300)]
    assert not any(x and not y for x, y in zip(linked, pairs, strict=True))
    assert 50 < sum(pairs) < 290 and sum(linked) >= 0.99 * sum(pairs)


def test_large_group_makes_few_candidates(spark, monkeypatch):
    seen = {}

    def note(df, name, real=near_copies.materialize):
        out = real(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(near_copies, "materialize", note)
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(k, " ".join(words[:k] + ["new"] + words[k + 1 :])) for k in range(200)], "row_key bigint, text string")
    assert {r["component"] for r in near_copies.near_copies(docs, "row_key").collect()} == {0}
    assert seen["copies-marked"] <= 1200 and seen["copies-links"] < 1200


def test_large_group_below_the_bound_makes_few_rows(spark, monkeypatch):
    """Copies of one text that are not similar among themselves: no row for a pair that is refuted."""
    seen = {}

    def note(df, name, real=near_copies.materialize):
        out = real(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(near_copies, "materialize", note)
    rng, words = random.Random(4), [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(150):
        copy = list(words)
        for i in rng.sample(range(200), 4):
            copy[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "row_key bigint, text string")
    got = {r["row_key"]: r["component"] for r in near_copies.near_copies(docs, "row_key").collect()}
    assert got == _components(list(enumerate(texts)))
    assert seen["copies-marked"] <= 6 * 150 and seen["copies-links"] <= 6 * 150


def test_hot_groups_are_cut_into_tile_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "cells", lambda rows, by, radius: tiles.cells(rows, by, radius, tile=40))
    texts = _families(3, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "row_key bigint, text string").repartition(3)
    assert {r["row_key"]: r["component"] for r in near_copies.near_copies(docs, "row_key").collect()} == _components(list(enumerate(texts)))


def test_near_stage_takes_similar_texts_only(spark):
    """The first two are similar, though their three-word fingerprints lie further apart than three bits."""
    words = [f"w{i}" for i in range(120)]
    changed = words[:60] + ["new"] + words[61:100] + ["other"] + words[101:]
    half = words[:60] + [f"v{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "a"), (2, " ".join(changed), "en", "a"), (3, " ".join(half), "en", "a")], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()) == [1, 3]


def test_near_stage_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(None, a), (None, a + " more"), (None, "alone"), (7, b), (7, b + " more"), (7, "other text"), (9, b + " and"), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], SCHEMA).repartition(2)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, docs, "").collect()]
    assert sorted(i is None for i, _ in got) == [False, False, True, True] and {i for i, _ in got} == {None, 7}
    assert (None, "alone") in got and (7, "other text") in got
