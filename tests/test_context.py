"""Context assembly against a direct loop."""

import random

from pyspark.sql import functions as F

from lodeseam.operators import context, evaluate


def test_intents_ignore_format_requests(spark):
    rows = [("Which callers are affected? Return JSON only with tests and impact.", ["impact"]), ("How does it work and which tests verify it", ["behavior", "test"]), ("如何 修改", ["behavior", "impact"]), ("contest of flowers", []), (None, [])]
    got = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(rows)], "i int, q string").select("i", context.intents(F.col("q")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [x for _, x in rows]


def _merge(rows, intents, most=8):
    pointed = {"impact", "test"} & set(intents)
    rank = {"phrase": 0, "supplement": 1 if pointed else 2, "primary": 2 if pointed else 1}
    unique, seen = [], set()
    for r in sorted(rows, key=lambda r: (rank[r["origin"]], r["ord"])):
        key = (r["path"], r["start_line"], r["end_line"])
        if key not in seen:
            seen.add(key)
            unique.append(r)
    picked = []

    def reserve(fits, n=1):
        for r in [r for r in unique if r not in picked and fits(r)][:n]:
            picked.append(r)

    test = lambda r: r["path"].startswith("tests/")
    reserve(lambda r: r["origin"] == "phrase", 2)
    if "impact" in intents:
        reserve(lambda r: r["is_impact"])
    if "test" in intents:
        reserve(test)
        reserve(lambda r: not test(r))
    if not pointed:
        reserve(lambda r: r["is_definition"] and not test(r))
    if "behavior" in intents and not pointed:
        reserve(lambda r: not test(r))
    rest = sorted([r for r in unique if r not in picked], key=lambda r: -r["overlap"])
    return [(r["path"], r["start_line"]) for r in (picked + rest)[:most]]


def test_merge_equals_a_loop(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    for q in range(60):
        intents = rng.sample(["impact", "test", "behavior"], rng.randint(0, 3))
        own, place = [], {"phrase": 0, "primary": 0, "supplement": 0}
        for _ in range(rng.randint(1, 25)):
            origin = rng.choice(list(place))
            place[origin] += 1
            own.append(
                {
                    "query_id": q, "intents": intents, "origin": origin, "ord": place[origin], "path": rng.choice(["tests/a", "src/b", "src/c", "d"]), "start_line": rng.randint(1, 9), "end_line": 9,
                    "overlap": rng.randint(0, 3), "is_impact": rng.random() < 0.3, "is_definition": rng.random() < 0.3,
                }
            )
        rows += own
        expected[q] = _merge(own, intents)
    schema = "query_id int, intents array<string>, origin string, ord int, path string, start_line int, end_line int, overlap int, is_impact boolean, is_definition boolean"
    got: dict = {}
    for r in context.merge_evidence(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((r["path"], r["start_line"]))
    assert got == expected


def test_saving_is_null_on_a_zero_base(spark):
    rows = [("a", "baseline", True, False, 200, 1.0), ("a", "treatment", True, False, 150, None), ("b", "baseline", True, True, 9, 1.0), ("b", "treatment", False, False, 5, 2.0)]
    report = evaluate.cohort_report(spark.createDataFrame(rows, "benchmark_id string, mode string, passed boolean, infrastructure_failure boolean, tokens long, elapsed_ms double"))
    assert {r["benchmark_id"]: r["saving"] for r in evaluate.percent_saving(report).collect()} == {"a": 25.0, "b": None}
    assert {(r["benchmark_id"], r["mode"]): (r["pass_rate"], r["p50_ms"]) for r in report.collect()}[("b", "baseline")] == (None, 1.0)
