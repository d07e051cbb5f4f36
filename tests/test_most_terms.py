"""Chunks that hold most of a query's terms."""

from lodeseam.operators import lexical
from lodeseam.plans import answers

SF = "/root/testdata/sf0.001"


def test_most_terms_equals_counting(spark, monkeypatch):
    texts = [("ab"[k % 2], (k * 37) % 3000, " ".join(f"W{(k * j) % 19}" for j in range(1, 2 + k % 9))) for k in range(3000)]
    chunks = spark.createDataFrame(texts, "snapshot_id string, chunk_id bigint, content string").repartition(3)
    asked = [(f"q{q}", [f"w{(q * 5 + j) % 23}" for j in range(q % 6)]) for q in range(12)]
    expected = []
    for query, terms in asked:
        for snapshot in "ab":
            held = [(-len(set(terms) & set(text.lower().split())), chunk) for s, chunk, text in texts if s == snapshot]
            expected += [(query, snapshot, chunk, -n) for n, chunk in sorted(h for h in held if h[0])[:4]]
    rows = lambda: sorted(tuple(r) for r in lexical.most_terms(spark.createDataFrame(asked, "query_id string, terms array<string>"), chunks, 4).select("query_id", "snapshot_id", "chunk_id", "score").collect())
    assert expected and rows() == sorted(expected)
    monkeypatch.setattr(lexical, "MATRIX_CELLS", 1)
    assert rows() == sorted(expected)


def test_key_phrases_shuffle_no_words(spark):
    plan = answers.phrase_recall(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan  # texts are read before, where their terms are counted
