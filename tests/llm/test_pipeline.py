"""The five stages on the smallest tables, each against what the operators say about its input."""

import os

import pytest

import corpus_pipeline

from test_dedup import _exact
from test_near_copies import _components

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "exact_dedup":
            assert kept[name] == sorted(i for i, x in _exact(rows).items() if x[2])
        if name == "near_dedup":
            assert kept[name] == sorted(i for i, x in _components(rows).items() if x == i)
        if name == "mix_sources":
            assert set(kept[name]) <= {i for i, _ in rows} and len(kept[name]) > len(rows)
        if name == "pack":
            assert set(kept[name]) == {i for i, _ in rows}
    assert len(kept["quality_rules"]) > 100
