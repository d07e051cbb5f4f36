"""An index updated for changed files equals one built afresh."""

import random

from pyspark.sql import functions as F

from lodeseam.operators import lexical, segments
from lodeseam.sources import publish


def test_updates_equal_a_fresh_index(spark, tmp_path):
    rnd = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta".split()
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 12)))
    held = {("s", k): text() for k in range(20)} | {("t", k): text() for k in range(6)}
    frame = lambda rows: spark.createDataFrame([(s, k, v) for (s, k), v in rows.items()], "snapshot_id string, chunk_id int, content string")
    root = str(tmp_path / "index")
    asked = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["zeta"]), (3, ["nothing"])], "query_id int, terms array<string>")
    same = lambda: sorted(tuple(r) for r in segments.search(asked, root).collect()) == sorted(tuple(r) for r in lexical.bm25(asked, frame(held)).collect())
    segments.update(spark, root, frame(held))
    assert same()
    for step in range(2):
        changed = {("s", rnd.randrange(24)): text() for _ in range(5)} | {("t", step): text()}
        gone = [k for k in held if k not in changed and rnd.random() < 0.2]
        segments.update(spark, root, frame(changed), spark.createDataFrame([(*k, "x") for k in gone] or [("none", 0, "x")], "snapshot_id string, chunk_id int, why string"))
        held = {k: v for k, v in held.items() if k not in gone} | changed
        assert same()
    segments.merge(spark, root)
    assert same() and publish.vacuum(spark, root) == 3 and same()
    changed = {("s", 1): "alpha alpha", ("u", 1): "zeta"}
    segments.update(spark, root, frame(changed))
    held |= changed
    assert same()


def test_postings_are_counted_without_a_shuffle(spark):
    texts = [" ".join(f"w{(k * j) % 7}" for j in range(k % 9)) for k in range(700)]
    chunks = spark.createDataFrame([("st"[k % 2], k, "en", t) for k, t in enumerate(texts)], "snapshot_id string, chunk_id int, language string, content string")
    found = lexical.postings(chunks)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    weights = {(r["chunk_id"], r["term"]): (r["weight"], r["length"]) for r in found.collect()}
    expected = {(k, w): (4.0 * t.split().count(w) + (w == "en"), len(t.split()) + 1) for k, t in enumerate(texts) for w in {*t.split(), "en"}}
    assert weights == expected


def test_the_best_of_an_index_are_those_of_all_scores(spark, tmp_path):
    texts = [" ".join(f"w{(k * j) % 11}" for j in range(1, k % 13)) for k in range(1500)]
    chunks = spark.createDataFrame([("st"[k % 3 % 2], k, t) for k, t in enumerate(texts)], "snapshot_id string, chunk_id long, content string")
    lexical.build_index(chunks, str(tmp_path / "index"))
    for asked in ([(k, [f"w{k}", f"w{k * 3 % 11}", "none"], "st"[k % 2]) for k in range(11)], [(1, [], "s")]):
        queries = spark.createDataFrame(asked, "query_id long, terms array<string>, snapshot_id string")
        for rows in (queries, queries.drop("snapshot_id")):
            every = lexical.bm25_indexed(rows.withColumn("terms", F.array_distinct("terms")), str(tmp_path / "index")).drop("matched")
            best = lexical._head(every, 7)
            found = lexical.bm25_indexed_top(rows, str(tmp_path / "index"), 7)
            assert sorted(map(tuple, found.select(*best.columns).collect())) == sorted(map(tuple, best.collect()))
            assert sorted(map(tuple, lexical.bm25_top(rows, chunks, 7).select(*best.columns).collect())) == sorted(map(tuple, best.collect()))


def test_scores_of_a_search_do_not_shuffle_postings(spark, monkeypatch):
    texts = [" ".join(f"w{(k * j) % 11}" for j in range(1, k % 13)) for k in range(1500)]
    chunks = spark.createDataFrame([("st"[k % 3 % 2], k, t) for k, t in enumerate(texts)], "snapshot_id string, chunk_id long, content string")
    queries = spark.createDataFrame([(k, [f"w{j}" for j in range(k % 7 + 1)]) for k in range(30)], "query_id long, terms array<string>")
    joined = []
    monkeypatch.setattr(lexical, "_worth", lambda held, own=lexical._worth: joined.append(1) or own(held))
    for least in (1, 4):
        monkeypatch.setattr(lexical, "IDF_CELLS", 1_000_000)
        found = sorted(map(tuple, lexical.bm25_top(queries, chunks, 7, least_terms=least).collect()))
        assert found and not joined
        monkeypatch.setattr(lexical, "SUMS", 50)  # a few chunks at a time
        monkeypatch.setattr(lexical, "IDF_CELLS", 1)
        assert found == sorted(map(tuple, lexical.bm25_top(queries, chunks, 7, least_terms=least).collect())) and joined.pop()
