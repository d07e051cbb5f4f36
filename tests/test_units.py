"""Import candidates, Markdown sections, re-pointing and overview cards."""

import pytest
from pyspark.sql import functions as F

from lodeseam.operators import chunking, corpus_map, linking


@pytest.mark.parametrize(
    ("path", "target", "expected"),
    [
        ("pkg/a.py", "os.path", ["os.path"]),
        ("pkg/sub/a.py", ".b", ["pkg.sub.b"]),
        ("pkg/sub/a.py", "..b", ["pkg.b"]),
        ("pkg/sub/a.py", ".", ["pkg.sub"]),
        ("src/a.ts", "./b.ts", ["src/b.ts", "src/b.ts/index.js", "src/b.ts/index.jsx", "src/b.ts/index.ts", "src/b.ts/index.tsx"]),
        ("a.ts", "../b", []),
    ],
)
def test_module_candidates(spark, path, target, expected):
    row = spark.createDataFrame([(path, target)], "p string, t string").select(linking.module_candidates(F.col("p"), F.col("t")).alias("c")).first()
    assert row["c"] == expected


def test_imports_bind_to_modules(spark):
    relations = spark.createDataFrame([("1", "x/a.py", ".b"), ("2", "x/a.py", "y.c"), ("3", "web/a.js", "./m")], "relation_id string, path string, target_ref string")
    modules = spark.createDataFrame([("m1", "x.b"), ("m2", "src.y.c"), ("m3", "web/m/index.ts")], "symbol string, qualified string")
    got = {r["relation_id"]: (r["target"], r["method"]) for r in linking.link_imports(relations, modules).collect()}
    assert got == {"1": ("m1", "module"), "2": ("m2", "suffix"), "3": ("m3", "module")}


def test_markdown_sections(spark):
    text = "# A\n## B\n```\n# no\n```\n## B\nTitle\n=====\nx\n### C #\n"
    rows = chunking.markdown_sections(spark.createDataFrame([(1, text), (2, None)], "id long, content string"), "id").orderBy("line_no").collect()
    assert [(r["line_no"], r["level"], r["section"], r["parent"]) for r in rows] == [
        (1, 1, "A", None), (2, 2, "A/B", "A"), (6, 2, "A/B[2]", "A"), (7, 1, "Title", None), (10, 3, "Title/C", "Title"),
    ]


def test_references_follow_a_split_unit(spark):
    refs = spark.createDataFrame([("r", "u1", "u2"), ("s", "u2", None)], "id string, source string, target string")
    moved = chunking.repoint(refs, spark.createDataFrame([("u1", "u1#0")], "old_id string, new_id string"), ["source", "target"])
    assert {(r["id"], r["source"], r["target"]) for r in moved.collect()} == {("r", "u1#0", "u2"), ("s", "u2", None)}


def test_overview_and_guide(spark):
    files = spark.createDataFrame([("s", "src/main.py", "python"), ("s", "src/b.py", "python"), ("s", "README.md", "markdown")], "snapshot_id string, path string, language string")
    r = corpus_map.overview(files).first()
    assert (r["files"], r["folders"], r["languages"], r["missing"]) == (3, 2, "python,markdown", "tests,config")
    assert {(x["stage"], x["position"], x["path"]) for x in corpus_map.reading_guide(files).collect()} == {("entry_points", 1, "src/main.py"), ("modules", 1, "README.md"), ("modules", 2, "src/b.py")}


def test_dealt_rows_of_a_task_do_not_grow(spark):
    from lodeseam.sources import shared

    rows = spark.range(100)
    assert shared.dealt(rows, 100, "id").rdd.getNumPartitions() == 8
    assert shared.dealt(rows, 36_000_000, "id").rdd.getNumPartitions() == 180


def test_what_grows_with_relations_grows_in_tasks(spark, monkeypatch):
    from lodeseam.operators import evaluate, fusion
    from lodeseam.sources import shared

    asked = []
    for module in (evaluate, fusion):
        monkeypatch.setattr(module, "dealt", lambda df, rows, *keys: asked.append((rows, keys)) or shared.dealt(df, rows, *keys))
    monkeypatch.setattr(shared, "TASK_ROWS", 5)
    relations = spark.createDataFrame([(f"r{k:03}", "calls", f"s{k % 9}", f"p{k}") for k in range(90)], "relation_id string, kind string, source string, target string")
    seeds = spark.createDataFrame([(k % 2, f"s{k}", 1.0) for k in range(8)], "query_id int, node string, score double")
    expected = [(q, f"p{k}", f"r{k:03}", n) for q in (0, 1) for n, k in enumerate([k for k in range(90) if k % 9 < 8 and k % 9 % 2 == q][:5], 1)]
    for most in (500_000, 0):
        monkeypatch.setattr(fusion, "BROADCAST_SEEDS", most)
        found = fusion.expand_one_hop(seeds, relations, 5).select("query_id", "node", "relation_id", "position")
        assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert asked.pop() == (90, ("query_id", "node"))
    rows = [("b", 1, "baseline"), ("b", 1, "treatment"), ("b", 2, "baseline"), ("b", 2, "baseline"), ("b", 2, None), ("b", 2, None), ("c", None, "treatment")]
    known = spark.createDataFrame([("b", 1), ("b", 1), ("b", 4), (None, 5)], "benchmark_id string, task_id int")
    frame = spark.createDataFrame(rows, "benchmark_id string, task_id int, mode string")
    found = sorted(map(str, map(tuple, evaluate.violations(frame, known).collect())))
    assert found == sorted(map(str, [
        ("duplicate_row", "b", 2), ("duplicate_row", "b", 2), ("missing_cohort", "b", 2), ("missing_cohort", "c", None), ("unknown_task", "b", 2), ("unknown_task", "c", None), ("missing_task", "b", 4), ("missing_task", None, 5),
    ]))
    assert asked[-2:] == 2 * [(7, ("benchmark_id", "task_id"))]


def test_group_coverage_is_dealt_by_its_rows(spark, monkeypatch):
    import os

    import pytest

    from lodeseam.plans import places
    from lodeseam.sources import shared

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    found = places.group_coverage(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() > 8
