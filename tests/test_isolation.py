"""Snapshots do not see each other: lexical and semantic ranks, fusion, gate, expansion."""

import numpy as np
from pyspark.sql import functions as F

from lodeseam.operators import fusion, lexical, semantic


def _chunks(spark):
    rows = [("a", k, f"alpha beta {'gamma ' * (k % 3)}{k}", f"p{k}") for k in range(12)] + [("b", k, f"alpha {k}", f"p{k}") for k in range(9)]
    return spark.createDataFrame(rows, "snapshot_id string, chunk_id int, content string, path string")


def _top(spark, asked, monkeypatch=None):
    scored = lexical.bm25_top(asked, _chunks(spark), 5).join(_chunks(spark).select("snapshot_id", "chunk_id", "path"), ["snapshot_id", "chunk_id"])
    return sorted((r["snapshot_id"], r["query_id"], r["rank"], r["chunk_id"], r["total"]) for r in lexical.two_stage_top_k(scored, F.lit(0.0), 3).collect())


def test_each_snapshot_has_its_own_ranks(spark, monkeypatch):
    asked = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["gamma"])], "query_id int, terms array<string>")
    found = _top(spark, asked)
    assert {(s, q) for s, q, *_ in found} == {("a", 1), ("b", 1), ("a", 2)}
    assert all(sum(x[:2] == k for x in found) == 3 for k in {("a", 1), ("b", 1), ("a", 2)})
    # as if the other snapshot were not there
    alone = lexical.bm25(asked, _chunks(spark).where("snapshot_id = 'b'")).collect()
    scores = {(r["query_id"], r["chunk_id"]): r["score"] for r in alone}
    assert all(scores[q, c] == t for s, q, _, c, t in found if s == "b")
    monkeypatch.setattr(lexical, "MATRIX_CELLS", 0)
    assert _top(spark, asked) == found


def test_a_query_of_one_snapshot(spark, monkeypatch):
    asked = spark.createDataFrame([("b", 1, ["alpha"]), ("a", 2, ["alpha"])], "snapshot_id string, query_id int, terms array<string>")
    found = _top(spark, asked)
    assert {(s, q) for s, q, *_ in found} == {("b", 1), ("a", 2)}
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 1)
    assert _top(spark, asked) == found
    monkeypatch.setattr(lexical, "MATRIX_CELLS", 0)
    assert _top(spark, asked) == found


def test_vectors_of_a_snapshot_and_the_grid(spark):
    rng = np.random.default_rng(3)
    vectors = [("ab"[k % 2], k, [float(x) for x in rng.normal(size=4)]) for k in range(60)]
    asked = [("ab"[k % 2], k, [float(x) for x in rng.normal(size=4)]) for k in range(20)]
    frame = lambda rows, n: spark.createDataFrame(rows, f"snapshot_id string, {n} long, vector array<double>").repartition(4)
    found = semantic.cosine_top_k(frame(asked, "query_id"), frame(vectors, "vec_id"), 3).collect()
    cos = lambda x, y: round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6)
    expected = []
    for s, q, x in asked:
        best = sorted((-cos(x, v), i) for t, i, v in vectors if t == s)
        expected += [(s, q, i, -c) for c, i in best[:3] if c < 0]
    rows = lambda f: sorted((r["snapshot_id"], r["query_id"], r["vec_id"], r["score"]) for r in f)
    assert rows(found) == sorted(expected)
    small = semantic.cosine_top_k(frame(asked, "query_id"), frame(vectors, "vec_id"), 3, query_block=4, vector_block=4, broadcast_bytes=200)
    assert rows(small.collect()) == sorted(expected)


def test_fusion_and_expansion_stay_inside(spark):
    lexical_ = spark.createDataFrame([("a", 1, 1, 10, "x", 50.0), ("b", 1, 1, 10, "x", 50.0), ("b", 1, 2, 11, "y", 40.0)], "snapshot_id string, query_id int, rank int, chunk_id int, path string, score double")
    semantic_ = spark.createDataFrame([("a", 1, 1, 11, "y", 0.9)], lexical_.schema)
    relations = spark.createDataFrame([("a", "r1", "calls", 10, 12), ("b", "r2", "calls", 10, 13)], "snapshot_id string, relation_id string, kind string, source int, target int")
    paths = spark.createDataFrame([(s, c, f"{s}{c}") for s in "ab" for c in (10, 11, 12, 13)], "snapshot_id string, chunk_id int, path string")
    rows, audit = fusion.hybrid(lexical_, semantic_, relations, paths, 5)
    got = sorted((r["snapshot_id"], r["position"], r["chunk_id"], r["signals"]) for r in rows.collect())
    assert got == [("a", 1, 10, "lexical"), ("a", 2, 11, "semantic"), ("a", 3, 12, "structural"), ("b", 1, 10, "lexical"), ("b", 2, 11, "lexical"), ("b", 3, 13, "structural")]
    assert sorted((r["snapshot_id"], r["lexical"], r["returned"]) for r in audit.collect()) == [("a", 1, 3), ("b", 2, 3)]
