"""Long hosts, clashing key columns and interleaved runs."""

import time

import corpus_pipeline
from lodeseam.llm import mixing, url_filter

SCHEMA = "doc_id bigint, text string, lang string, source string"


def test_host_of_many_labels(spark):
    deep = "a." * 100_000
    urls = [f"http://{deep}org/x", f"http://{deep}spam.example/", "http://" + "b" * 300_000 + "/", f"http://{deep}de/", "http://org/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    began = time.time()
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    assert found == {0: ("org/", "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: ("org/", "allow")} and time.time() - began < 60
    rules = spark.createDataFrame([(h + p, v) for v, h, p in url_filter.RULES], "rule string, verdict string")
    lengths = sorted({len(p) for _, _, p in url_filter.RULES})
    joined = url_filter.filter_by_join(pages, rules, lengths, url_filter.BLOCKED_SITES)
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in joined.collect()} == found


def test_no_domain_longer_than_an_entry():
    assert list(url_filter.domains("www.site.example.org", 11)) == ["example.org", "org"]
    assert list(url_filter.domains("example.org", 11)) == ["example.org", "org"]
    assert list(url_filter.domains("x" * 50, 11)) == []


def test_a_column_named_like_the_key(spark, tmp_path):
    rows = [(1, "one two", "en", "s", 888), (2, "ONE two", "en", "s", 999), (3, "three", "en", "s", 777)]
    docs = spark.createDataFrame(rows, SCHEMA + ", row_key bigint")
    kept = {r["doc_id"]: r["row_key"] for r in corpus_pipeline.exact_stage(spark, docs, "k").collect()}
    assert kept == {2: 999, 3: 777}
    for stage in (corpus_pipeline.near_stage, corpus_pipeline.mix_stage):
        got = {r["doc_id"]: r["row_key"] for r in stage(spark, docs, "k").collect()}
        assert all(dict([(1, 888), (2, 999), (3, 777)])[d] == v for d, v in got.items())


def test_interleaved_runs(spark):
    docs = [spark.createDataFrame([(k, f"text {k}", "en", "s"), (k + 1, f"TEXT {k}", "en", "s")], SCHEMA) for k in (0, 10)]
    first = corpus_pipeline.exact_stage(spark, docs[0], "same")
    second = corpus_pipeline.exact_stage(spark, docs[1], "same")
    assert [r["doc_id"] for r in first.collect()] == [1]
    assert [r["doc_id"] for r in second.collect()] == [11]


def test_a_finished_stage_leaves_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one", "en", "s"), (2, "two", "en", "s")], SCHEMA)
    corpus_pipeline.exact_stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / "exact"))
    before = [p for _, paths in corpus_pipeline._SPENT[str(tmp_path)] for p in paths]
    corpus_pipeline.mix_stage(spark, spark.read.parquet(str(tmp_path / "exact")), str(tmp_path))
    after = [p for _, paths in corpus_pipeline._SPENT[str(tmp_path)] for p in paths]
    assert before and not set(before) & set(after)


def test_shards_of_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(k, "w " * 40, "en", "ab"[k % 2]) for k in range(60)], SCHEMA)
    draws = mixing.mix(docs, shards=2)
    mixing.write_shards(draws, str(tmp_path / "s"), files=4)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert got.count() == draws.where("shard is not null").count() and len(got.inputFiles()) > 2
