"""Files that a parser cannot take, and imports in their scope."""

from lodeseam.operators import chunking

SCHEMA = "snapshot_id string, path string, content string"


def test_deep_files_do_not_stop_a_job(spark):
    deep = "x = " + "(" * 150 + "1" + ")" * 150
    chain = "x = " + "+".join(["a"] * 20_000)
    calls = "f(" * 90 + ")" * 90
    docs = spark.createDataFrame([("s", "deep.py", deep * 40), ("s", "chain.py", chain), ("s", "calls.py", calls), ("s", "good.py", "import os\nos.getcwd()")], SCHEMA)
    facts = chunking.python_symbols(docs).collect()
    assert {r["path"] for r in facts} == {"deep.py", "chain.py", "calls.py", "good.py"}
    assert [r["target"] for r in facts if r["path"] == "good.py" and r["kind"] == "calls"] == ["os.getcwd"]
    rows = chunking.config_rows(spark.createDataFrame([("s", "a.json", "[" * 100_000), ("s", "b.json", '{"k": [1]}')], SCHEMA)).collect()
    assert [r["kind"] for r in rows if r["path"] == "a.json"] == ["fallback"]
    assert [r["json_path"] for r in rows if r["path"] == "b.json"] == ["$", "$.k", "$.k[0]"]


def test_imports_count_where_they_stand(spark):
    source = "import a\ndef f():\n    import b as a\n    def g():\n        a.x()\n    a.y()\ndef h():\n    a.z()\n"
    facts = chunking.python_symbols(spark.createDataFrame([("s", "m.py", source)], SCHEMA)).collect()
    assert sorted(r["target"] for r in facts if r["kind"] == "calls") == ["a.z", "b.x", "b.y"]
