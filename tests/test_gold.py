import pytest

from lodeseam.operators import evaluate

TEXTS = {1: "xalpha beta gammay and more", 2: "alpha beta  gamma", 3: None, 4: "", 5: "alpha beta gamma alpha beta gamma", 6: "one\ntwo beta gamma", 7: "gamma-beta"}
ASKED = {1: "alpha beta gamma", 2: "beta  gamma", 3: "gamma", 4: None, 5: "two beta gamma", 6: "", 7: "a b c"}


@pytest.mark.parametrize("held_bytes", (1 << 20, 0))
def test_holders_are_all_texts_that_contain_a_question(spark, monkeypatch, held_bytes):
    monkeypatch.setattr(evaluate, "HELD_BYTES", held_bytes)
    chunks = spark.createDataFrame([*TEXTS.items(), (1, TEXTS[1])], "chunk_id long, content string")
    questions = spark.createDataFrame([*ASKED.items(), (1, ASKED[1])], "query_id int, query string")
    found = evaluate.holders(questions, chunks)
    expected = {(q, c) for q, a in ASKED.items() for c, t in TEXTS.items() if a is not None and t is not None and a in t}
    assert (1, 1) in expected and found.columns == ["query_id", "item"]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
