"""Publishing, phrases and range bins."""

import random

import pytest

from lodeseam.operators import phrases, ranges
from lodeseam.sources import publish


def _facts(spark, k):
    return {"units": spark.createDataFrame([(k, f"u{k}")], "unit_id int, text string"), "relations": spark.createDataFrame([(k, k + 1)], "source int, target int")}


def _state(spark, root):
    return {n: sorted(tuple(r) for r in publish.read_published(spark, root, n).collect()) for n in ("units", "relations")}


def test_a_failure_between_tables_leaves_the_old_snapshot(spark, tmp_path):
    root = str(tmp_path / "store")
    publish.publish(spark, _facts(spark, 1), root, "a")
    publish.publish(spark, _facts(spark, 5), root, "b")
    before = _state(spark, root)
    assert before["units"] == [(1, "u1", "a"), (5, "u5", "b")]
    broken = _facts(spark, 2)
    broken["relations"] = broken["relations"].selectExpr("source", "assert_true(source > 9) as target")
    with pytest.raises(Exception, match="source > 9|ASSERT"):
        publish.publish(spark, broken, root, "a")
    assert _state(spark, root) == before
    number = publish.publish(spark, _facts(spark, 2), root, "a")
    assert _state(spark, root)["relations"] == [(2, 3, "a"), (5, 6, "b")]
    assert sorted(publish.read_published(spark, root, "units", number=number - 1).collect())[0]["text"] == "u1"
    assert [r["unit_id"] for r in publish.read_published(spark, root, "units", ["b"]).collect()] == [5]
    assert publish.vacuum(spark, root) >= 2
    assert _state(spark, root)["units"] == [(2, "u2", "a"), (5, "u5", "b")]


def test_two_writers_of_one_number(spark, tmp_path):
    root = str(tmp_path / "store")
    publish.publish(spark, _facts(spark, 1), root, "a")
    with pytest.raises(FileExistsError):
        publish.commit(spark, root, 1, {})
    assert _state(spark, root)["units"] == [(1, "u1", "a")]
    with pytest.raises(LookupError):
        publish.read_published(spark, root, "nothing")


def test_cjk_phrases_are_not_their_characters(spark):
    texts = ["数据库连接失败", "失败的数据连接库", "库数据", "数据库 数据库", None, "x 数 据 库 y"]
    chunks = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "snapshot_id string, chunk_id int, content string")
    asked = spark.createDataFrame([(1, "数据库"), (2, "数据库连接"), (3, "!!"), (4, "败的"), (5, "没有数据")], "query_id int, query string")
    held = phrases.positions(chunks)
    found = sorted(tuple(r) for r in phrases.phrase_hits(asked, held).select("query_id", "chunk_id", "hits", "first").collect())
    assert found == [(1, 0, 1, 0), (1, 3, 2, 0), (1, 5, 1, 1), (2, 0, 1, 0), (4, 1, 1, 1)]
    single = {r["chunk_id"] for r in held.where("term = '数'").collect()}
    assert single == {0, 1, 2, 3, 5} != {c for q, c, _, _ in found if q == 1}


def test_phrases_equal_a_scan(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("aab b c d e".split()) for _ in range(rnd.randrange(40))) for _ in range(40)]
    chunks = spark.createDataFrame([("st"[k % 2], k, t) for k, t in enumerate(texts)], "snapshot_id string, chunk_id int, content string")
    asked = [(k, "st"[k % 3 % 2], " ".join(rnd.choice("aab b c d e".split()) for _ in range(rnd.randrange(1, 4)))) for k in range(25)]
    found = sorted((r["query_id"], r["chunk_id"], r["hits"]) for r in phrases.phrase_hits(spark.createDataFrame(asked, "query_id int, snapshot_id string, query string"), phrases.positions(chunks)).collect())
    expected = []
    for q, s, p in asked:
        p = p.split()
        for c, t in enumerate(texts):
            t = t.split()
            n = sum(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1))
            if n and "st"[c % 2] == s:
                expected.append((q, c, n))
    assert found == sorted(expected)


def test_tokens_that_begin_no_phrase_do_not_shuffle(spark):
    chunks = spark.createDataFrame([("s", k, "the cat sat on the mat " * 9) for k in range(6)], "snapshot_id string, chunk_id int, content string")
    asked = spark.createDataFrame([(1, "the cat"), (2, "the cat"), (3, "mat the"), (4, "on"), (5, "cat the"), (6, "the cat sat on the mat")], "query_id int, query string")
    short = phrases.phrase_hits(asked.where("query_id < 6"), phrases.positions(chunks))
    assert "hashpartitioning(term" not in short._jdf.queryExecution().toString()
    found = phrases.phrase_hits(asked, phrases.positions(chunks))
    rows = sorted((r["query_id"], r["chunk_id"], r["hits"], r["first"]) for r in found.collect())
    assert rows == [(q, c, n, at) for q, n, at in ((1, 9, 0), (2, 9, 0), (3, 8, 5), (4, 9, 3), (6, 9, 0)) for c in range(6)]


def test_each_overlap_once(spark):
    rnd = random.Random(6)
    make = lambda n: [(rnd.choice("ab"), k, *(lambda s: (s, s + rnd.choice([-1, 0, 3, 200])))(rnd.randrange(-100, 400))) for k in range(n)]
    left, right = [*make(80), ("a", 900, None, 4)], make(70)
    frame = lambda rows, n: spark.createDataFrame(rows, f"key string, {n} int, {n}_from int, {n}_to int")
    found = ranges.overlapping(frame(left, "l"), frame(right, "r"), ["key"], ("l_from", "l_to"), ("r_from", "r_to"), 10)
    expected = [(a[1], b[1]) for a in left for b in right if a[0] == b[0] and None not in a and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3]]
    assert sorted((r["l"], r["r"]) for r in found.collect()) == sorted(expected)
