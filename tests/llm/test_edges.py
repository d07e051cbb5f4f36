"""Very long texts, clashing column names and empty tables through every operator and every stage."""

import pytest

import corpus_pipeline
from lodeseam.llm import exact_dedup, katz, license_scan, mixing, near_copies, packing, quality_rules, simhash, token_counts, toxicity, url_filter

SCHEMA = "doc_id bigint, text string, lang string, source string"


def _operators(spark):
    P = pytest.importorskip("public_tokenizers")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    return {
        "op1": license_scan.scan,
        "op2": lambda d: mixing.per_document(mixing.mix(d)),
        "op3": simhash.near_duplicates,
        "op4": lambda d: exact_dedup.dedup_in_batches(d, exact_dedup.DigestIndex(spark, buckets=4)),
        "op5": lambda d: token_counts.token_counts(d, P.path("piece_bpe_32k.model")),
        "op7": katz.score_documents,
        "op8": lambda d: packing.pack(d, P.path("word_bpe_49k.json")).where("piece = 0"),
        "op9": lambda d: quality_rules.apply_rules(d, quality_rules.learn_rules(d, none)),
        "op10": lambda d: toxicity.score_documents(d, toxicity.learn(d, none)),
    }


def test_long_texts_and_clashing_columns(spark):
    texts = ["word " * 200_000, "x" * 1_000_000, "short text", None]
    extra = "n_words int, kept int, rule string, base_failed int, _text string, shard int, place int, digest string, fp int, cell int, side int, n int, key int, size int, words int, target int, score int, row string"
    rows = [(k, t, "en", "s", *[7 if "int" in c else "q" for c in extra.split(", ")]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {extra}").repartition(2)
    for name, operator in _operators(spark).items():
        assert sorted(r["doc_id"] for r in operator(docs).select("doc_id").collect()) == [0, 1, 2, 3], name
    pages = spark.createDataFrame([(1, "http://a.org/" + "x/" * 100_000, "q"), (2, "http://" + "a." * 2000 + "org/", "q")], "page_id bigint, url string, verdict string")
    assert {r["page_id"]: r["rule"] for r in url_filter.filter_urls(pages).collect()} == {1: "org/", 2: "org/"}


def test_empty_tables(spark, empty):
    for name, operator in _operators(spark).items():
        assert operator(empty).count() == 0, name
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    assert near_copies.near_copies(spark.createDataFrame([], "row_key bigint, text string"), "row_key").count() == 0


def test_stages_keep_columns_of_any_name_and_empty_tables(spark, empty, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["n_words", "kept", "rule", "base_failed", "_text", "_keep", "shard", "place", "digest", "component", "at", "keep_id", "batch", "first"]
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long, "en", "s"), (4, long + " z", "en", "s"), (4, long + " z", "en", "s"), (5, " ".join(f"v{i}" for i in range(2000)), None, None)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], SCHEMA + "".join(f", `{n}` int" for n in names)).repartition(2)
    kept = {"quality_rules": 4, "exact_dedup": 3, "near_dedup": 2}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns and all(r[n] == i for r in docs.collect() for i, n in enumerate(names))
        assert docs.count() == kept.get(name, docs.count())
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"empty-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"empty-{name}"))
        assert docs.count() == 0
