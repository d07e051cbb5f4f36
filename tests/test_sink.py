"""The exactly-once sink under replays, failures and late rows; sub-questions and retries of the locator."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodeseam.operators import locate
from lodeseam.streaming import sink

SCHEMA = "id int, created_at timestamp, score double"


def _rows(spark, *ids, day=1, hour=0):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, day, hour, i % 60), i / 2) for i in ids], SCHEMA)


def test_each_row_once(spark, tmp_path):
    path = str(tmp_path / "out")
    write = sink.exactly_once(path)
    write(_rows(spark, 1, 2, 2, 3), 0)
    write(_rows(spark, 1, 2, 2, 3), 0)  # the same batch again
    write(_rows(spark, 3, 4, day=2), 1)  # 3 is a copy, a day later
    write(_rows(spark, 9, day=1, hour=5), 2)  # nineteen hours behind
    write(_rows(spark, 9, 10, day=2, hour=1), 3)  # the late row's copy
    schema = _rows(spark, 1).schema
    assert sorted(r["id"] for r in sink.read(spark, path, schema).collect()) == [1, 2, 3, 4, 10]
    assert [r["id"] for r in sink.read(spark, path, schema, "late").collect()] == [9]
    assert sorted(tuple(r)[:3] for r in sink.ledger(spark, path).collect()) == [(0, 3, 0), (1, 1, 0), (2, 0, 1), (3, 1, 0)]


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write = sink.exactly_once(path)
    write(_rows(spark, 1), 0)
    # an attempt that wrote its rows and died before the ledger
    _rows(spark, 5, 6).write.parquet(f"{path}/rows/batch_id=1")
    schema = _rows(spark, 1).schema
    assert [r["id"] for r in sink.read(spark, path, schema).collect()] == [1]
    with pytest.raises(Exception, match="ASSERT|bad"):
        write(_rows(spark, 7).withColumn("score", F.expr("cast(raise_error('bad') as double)")), 1)
    write(_rows(spark, 5, 7), 1)
    assert sorted(r["id"] for r in sink.read(spark, path, schema).collect()) == [1, 5, 7]


def test_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        _rows(spark, k, k + 1, 50 + k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(_rows(spark, 1).schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda check: stream.writeStream.foreachBatch(sink.exactly_once(path)).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start().awaitTermination()
    run("a")
    run("b")  # a lost checkpoint: all batches come again
    assert sorted(r["id"] for r in sink.read(spark, path, _rows(spark, 1).schema).collect()) == [0, 1, 2, 3, 50, 51, 52]


def test_recall_asks_parts_and_retries(spark):
    units = spark.createDataFrame([(1, "parse configuration files"), (2, "render user interface"), (3, "zebra handling")], "unit_id int, content string")
    asked_for = []

    def search(rows):
        held = [(r["query_id"], r["query"]) for r in rows.collect()]
        asked_for.append(sorted(q for _, q in held))
        hits = [(k, u, float(len(set(q.split()) & set(t.split())))) for k, q in held for u, t in [(1, "parse configuration files"), (2, "render user interface"), (3, "zebra handling")] if len(set(q.split()) & set(t.split())) >= (1 if "zebra" in q and len(q.split()) < 3 else 2)]
        return spark.createDataFrame(hits, "query_id string, chunk_id int, score double")

    questions = spark.createDataFrame([(7, "parse configuration files and where the render user interface starts"), (8, "zebra unknown")], "query_id int, query string")
    found = sorted(tuple(r) for r in locate.recall(questions, units, search).collect())
    assert found == [(7, 1, 3.0), (7, 2, 3.0), (8, 3, 1.0)]
    assert "parse configuration files" in asked_for[0] and any("zebra" in q for q in asked_for[-1])
