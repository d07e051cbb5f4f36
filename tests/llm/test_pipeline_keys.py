"""Null and repeated ids through the stages that decide by row."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string"


def _rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_exact_stage_decides_by_row(spark):
    rows = [(None, "a"), (None, "A"), (None, "b"), (5, "c"), (5, "c"), (5, "d"), (6, "D"), (None, "c")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA).repartition(3)
    got = _rows(corpus_pipeline.exact_stage(spark, docs, ""))
    assert [(i, t.lower()) for i, t in got] == [(5, "c"), (6, "d"), (None, "a"), (None, "b")]


def test_mix_stage_draws_by_row(spark):
    rows = [(k if k % 3 else None, f"text {k}") for k in range(30)] + [(7, "seven")] * 3 + [(7, "other seven")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA).repartition(3)
    got = _rows(corpus_pipeline.mix_stage(spark, docs, ""))
    size = lambda found: sum(len(t.split()) for _, t in found)
    assert abs(size(got) - 1.5 * size(rows)) <= 2
    assert {i for i, _ in got} == {i for i, _ in rows} and set(got) == set(rows)


def test_rules_stage_decides_by_row(spark, sample, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(r["text"], r["lang"]) for r in sample.collect()]
    docs = lambda ids: spark.createDataFrame([(i, t, lang, "s") for i, (t, lang) in zip(ids, rows, strict=True)], SCHEMA)
    kept = lambda ids: sorted(r["text"] for r in corpus_pipeline.rules_stage(spark, docs(ids), str(tmp_path)).collect())
    assert kept(range(len(rows))) == kept([4 if k % 2 else None for k in range(len(rows))]) != []


def test_pack_stage_keeps_every_row(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(None, "one", "en", "s"), (None, "two", "en", "s"), (4, "three", "en", "s"), (4, "four", "en", "s")], SCHEMA)
    assert sorted((r["doc_id"] for r in corpus_pipeline.pack_stage(spark, docs, "").collect()), key=str) == [4, 4, None, None]
