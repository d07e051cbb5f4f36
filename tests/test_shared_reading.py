"""Texts are read once for all that is asked of them."""

from lodeseam.operators import lexical, phrases
from lodeseam.plans import contexts, places

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.select("query_id", "snapshot_id", "chunk_id", "score").collect()))


def _counted(monkeypatch):
    calls, count = [], lexical._term_counts
    monkeypatch.setattr(lexical, "_term_counts", lambda *a: calls.append(1) or count(*a))
    return calls


def test_searches_share_the_counted_terms(spark, monkeypatch):
    texts = [(s, k, " ".join(f"w{(k * j) % 23}" for j in range(1, 2 + k % 30))) for k in range(300) for s in "ab"]
    chunks = spark.createDataFrame(texts, "snapshot_id string, chunk_id bigint, content string")
    some = spark.createDataFrame([(q, [f"w{(q + j) % 23}" for j in range(5)]) for q in range(8)], "query_id bigint, terms array<string>")
    other = spark.createDataFrame([(q, "a", [f"w{(q * 3 + j) % 29}" for j in range(7)]) for q in range(6)], "query_id bigint, snapshot_id string, terms array<string>")
    expected = [_rows(lexical.bm25_top(some, chunks, 9)), _rows(lexical.bm25_top(other, chunks, 9, least_terms=4))]
    assert all(expected)
    calls = _counted(monkeypatch)
    assert [_rows(found) for found in lexical.bm25_tops([(some, 1), (other, 4)], chunks, 9)] == expected and len(calls) == 1
    monkeypatch.setattr(lexical, "MATRIX_CELLS", 200)  # too many together, so one after the other
    assert [_rows(found) for found in lexical.bm25_tops([(some, 1), (other, 4)], chunks, 9)] == expected
    monkeypatch.setattr(lexical, "MATRIX_CELLS", 1)
    assert [_rows(found) for found in lexical.bm25_tops([(some, 1), (other, 4)], chunks, 9)] == expected


def test_a_comparison_counts_terms_once(spark, monkeypatch):
    calls = _counted(monkeypatch)
    assert places.capture_comparison(spark, SF).count() == 3 and len(calls) == 1


def test_merge_slots_cuts_texts_of_candidates_only(spark):
    plan = contexts.merge_slots(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan  # what keeps the candidates stands before their texts are cut


def test_phrases_cut_every_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = spark.createDataFrame([("s", k, f"one two three four w{k % 7} five six") for k in range(50)], "snapshot_id string, chunk_id bigint, content string")
    asked = spark.createDataFrame([(1, "two three four"), (2, "w3 five six"), (3, "six one two")], "query_id int, query string")
    held = phrases.positions(texts.mapInArrow(seen, texts.schema))
    found = sorted((r["query_id"], r["chunk_id"], r["hits"], r["first"]) for r in phrases.phrase_hits(asked, held).collect())
    assert found == [(1, k, 1, 1) for k in range(50)] + [(2, k, 1, 4) for k in range(3, 50, 7)] and read.value == 50
