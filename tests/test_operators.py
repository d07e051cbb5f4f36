"""Golden and brute-force checks of operators on inputs of our own."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseam.functions import text as X
from lodeseam.operators import chunking, corpus_map, evaluate, evidence, findings, fusion, graph, lexical, linking, locate, semantic, telemetry
from lodeseam.sources import corpus


def one(spark, value, column, type_="string"):
    return spark.createDataFrame([(value,)], f"v {type_}").select(column(F.col("v")).alias("r")).first()["r"]


def test_query_terms_split_camel_case_and_cjk(spark):
    assert one(spark, "getHTTPResponse foo_bar 查询", X.query_terms) == ["gethttpresponse", "get", "http", "response", "foo", "bar", "查询", "查", "询"]
    assert one(spark, "", X.query_terms) == []


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a b", 2), ("x = 1.5", 3), ("中文 ab", 3), (None, 0)])
def test_estimate_tokens(spark, text, n):
    assert one(spark, text, X.estimate_tokens) == n


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb", "\n", "a\x0bb\x0c", "a\n\nb\n"])
def test_lines_split_as_python_does(spark, text):
    assert one(spark, text, X.split_lines) == text.splitlines()


def test_paths(spark):
    rows = [("src/a.py", "python", False), ("tests/a.ts", "typescript", True), ("a/test_x.py", "python", True), ("b/x.spec.ts", "typescript", True), ("Dockerfile", "text", False), ("x.bin", None, False)]
    df = spark.createDataFrame([r[:1] for r in rows], "path string").select("path", X.detect_language(F.col("path")).alias("l"), X.is_test_path(F.col("path")).alias("t"))
    assert [tuple(r) for r in df.collect()] == rows
    assert one(spark, "a/node_modules/b.js", X.is_ignored) and not one(spark, "a/builds/b.js", X.is_ignored)
    assert one(spark, "./a\\b", X.safe_path) == "a/b"
    assert one(spark, "../a", X.safe_path) is None and one(spark, "C:/a", X.safe_path) is None


def test_redaction(spark):
    assert one(spark, "token=abc123 and Authorization: Bearer xyz", X.redact) == "token=[redacted] and Authorization: Bearer [redacted]"
    assert one(spark, "see https://u:p@h.org/a#frag", X.redact) == "see https://[redacted]@h.org/a"
    assert one(spark, "at '/home/me/x y' done", X.redact) == "at '[local path]' done"
    assert one(spark, "https://h.org/a?token=1&page=2#x", X.redact_url) == "https://h.org/a?page=2"
    assert one(spark, "abcdefghij", X.mask_secret) == "••••ghij" and one(spark, "abc", X.mask_secret) == "•••" and one(spark, "", X.mask_secret) is None


def test_bm25_is_the_formula(spark):
    docs = [("s", 1, "cat dog cat"), ("s", 2, "dog bird"), ("s", 3, "fish")]
    chunks = spark.createDataFrame(docs, "snapshot_id string, chunk_id long, content string")
    asked = spark.createDataFrame([(7, ["cat", "fish"])], "query_id long, terms array<string>")
    got = {r["chunk_id"]: r["score"] for r in lexical.bm25(asked, chunks).collect()}
    mean, idf = 2.0, np.log(2.5 / 1.5)
    score = lambda tf, length: idf * 4 * tf * 2.2 / (4 * tf + 1.2 * (0.25 + 0.75 * length / mean))
    assert got == {1: round(score(2, 3), 6), 3: round(score(1, 1), 6)}


def test_written_index_scores_alike(spark, tmp_path):
    docs = [("s", i, f"word{i % 3} word{i % 5} common text {'x ' * (i % 4)}") for i in range(40)] + [("t", 1, "word1 common")]
    chunks = spark.createDataFrame(docs, "snapshot_id string, chunk_id long, content string")
    asked = spark.createDataFrame([(1, ["word1", "common", "none"]), (2, ["word4"])], "query_id long, terms array<string>")
    lexical.build_index(chunks, str(tmp_path / "index"))
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "snapshot_id", "chunk_id", "matched", "score").collect())
    assert rows(lexical.bm25_indexed(asked, str(tmp_path / "index"))) == rows(lexical.bm25(asked, chunks)) != []


def test_fusion_order_and_gate(spark):
    rows = [(1, "lexical", 1, 10, "a", 50.0), (1, "lexical", 2, 11, "b", 40.0), (1, "semantic", 1, 11, "b", 0.9), (2, "lexical", 1, 12, "c", 1.0)]
    fused = fusion.rrf(spark.createDataFrame(rows, "query_id long, channel string, rank int, chunk_id long, path string, score double"))
    got = {(r["query_id"], r["chunk_id"]): (r["position"], r["rrf"]) for r in fused.collect()}
    assert got == {(1, 11): (1, round(1 / 62 + 1 / 61, 9)), (1, 10): (2, round(1 / 61, 9)), (2, 12): (1, round(1 / 61, 9))}
    decided = {r["query_id"]: (r["decision"], r["reason"]) for r in fusion.gate(fusion.observe(fused)).collect()}
    assert decided == {1: ("accepted", None), 2: ("low_relevance", "lexical_below_threshold")}
    boosted = fusion.gate(fusion.observe(fused.withColumn("boost", F.lit(4.0))))
    assert {r["decision"] for r in boosted.collect()} == {"accepted"}
    tail = fusion.rerank_head(fused.where("query_id = 1"), F.col("chunk_id") * -1, 50).orderBy("reranked")
    assert [r["chunk_id"] for r in tail.collect()] == [10, 11]


def test_cosine_ties_zero_and_wrong_dimension(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [-1.0, 0.0])], "vec_id long, vector array<float>")
    q = spark.createDataFrame([(9, [3.0, 0.0]), (8, [0.0, 0.0])], "query_id long, vector array<float>")
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in semantic.cosine_top_k(q, v, 5).orderBy("rank").collect()] == [(9, 1, 1.0), (9, 2, 1.0)]


def test_embedding_batches_are_halved_and_inputs_shortened(spark):
    def provider(texts):
        if len(texts) > 1 or len(texts[0]) > 40 or texts[0] == "bad":
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([("a", "x" * 100), ("b", "bad"), ("c", "ok")], "content_hash string, input string")
    got = {r["content_hash"]: (r["vector"], r["error"]) for r in semantic.embed(rows, provider).collect()}
    assert got == {"a": ([32.0], None), "b": (None, "no"), "c": ([2.0], None)}


def test_rank_quality_duplicates_use_positions(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 6), (2, "z", 1)], "query_id long, item string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "y")], "query_id long, item string")
    got = {r["query_id"]: (r["recall_5"], r["recall_10"], r["reciprocal_rank"]) for r in evaluate.rank_quality(ranked, gold).collect()}
    assert got == {1: (0.5, 1.0, 1.0), 2: (0.0, 0.0, 0.0)}


def test_durations_nearest_rank(spark):
    r = evaluate.durations(spark.createDataFrame([(x,) for x in (4.0, 1.0, 9.0, 2.0)], "ms double"), "ms").first()
    assert (r["least"], r["most"], r["p50"], r["p95"]) == (1.0, 9.0, 2.0, 9.0)


def test_paired_report_golden(spark):
    base, treat = [(45000, True), (43000, True), (42936, True)], [(50000, True), (49000, True), (49193, True)]
    rows = [("b", f"t{i}", mode, p, n) for mode, side in (("baseline", base), ("treatment", treat)) for i, (n, p) in enumerate(side)]
    report = evaluate.paired_report(evaluate.paired(spark.createDataFrame(rows, "benchmark_id string, task_id string, mode string, passed boolean, tokens long")))
    r = report.where("benchmark_id = 'all'").first()
    assert (r["baseline_tokens"], r["treatment_tokens"], r["token_change"]) == (130936, 148193, 13.18)


def test_token_chunks_match_a_loop(spark):
    rng = np.random.default_rng(3)
    docs = [(i, "\n".join("w " * int(n) for n in rng.integers(0, 30, rng.integers(1, 40)))) for i in range(20)]
    got: dict = {}
    for r in chunking.token_chunks(spark.createDataFrame(docs, "id long, content string"), "id", 50).collect():
        got.setdefault(r["id"], []).append((r["start_line"], r["end_line"], r["tokens"]))
    for i, text in docs:
        out, start, total = [], 1, 0
        lines = text.splitlines()
        for k, line in enumerate(lines, 1):
            n = len(line.split())
            if k > start and total + n > 50:
                out.append((start, k - 1, total))
                start, total = k, 0
            total += n
        if lines:
            out.append((start, len(lines), total))
        assert sorted(got.get(i, [])) == out


def test_python_symbols(spark):
    code = "import os\nfrom a.b import c\nclass A(Base):\n    async def f(self):\n        c()\ndef g():\n    return A().f()\n"
    docs = spark.createDataFrame([("s", "pkg/m.py", code), ("s", "bad.py", "def (")], "snapshot_id string, path string, content string")
    rows = chunking.python_symbols(docs).collect()
    facts = {(r["kind"], r["name"], r["target"]) for r in rows}
    assert {("class", "pkg.m.A", None), ("method", "pkg.m.A.f", None), ("function", "pkg.m.g", None), ("inherits", "pkg.m.A", "Base")} <= facts
    assert {("imports", "pkg.m", "os"), ("imports", "pkg.m", "a.b.c"), ("calls", "pkg.m.A.f", "a.b.c"), ("calls", "pkg.m.g", "A().f")} <= facts
    assert [r["path"] for r in rows if r["fact"] == "diagnostic"] == ["bad.py"]


def test_link_outcomes(spark):
    symbols = spark.createDataFrame([("1", "a.py", "f", "a.f"), ("2", "b.py", "f", "b.f"), ("3", "b.py", "g", "x.b.g")], "symbol string, path string, name string, qualified string")
    relations = spark.createDataFrame([("r1", "a.py", "a.f"), ("r2", "a.py", "f"), ("r3", "a.py", "b.g"), ("r4", "a.py", "zz"), ("r5", "c.py", "f")], "relation_id string, path string, target_ref string")
    got = {r["relation_id"]: (r["status"], r["target"]) for r in linking.link(relations, symbols).collect()}
    assert got == {"r1": ("resolved", "1"), "r2": ("resolved", "1"), "r3": ("resolved", "3"), "r4": ("unresolved", None), "r5": ("unresolved", None)}


def test_call_chain_with_cycle(spark):
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "c", "a")], "edge_id string, source string, target string")
    roots = spark.createDataFrame([("a",)], "root string")
    got = {(r["source"], r["target"], r["depth"]) for r in graph.call_chain(edges, roots, "callees", 10).collect()}
    assert got == {("a", "b", 1), ("b", "c", 2), ("c", "a", 3)}


def test_pack_respects_budgets(spark):
    rows = [(1, k, f"p{k % 3}", 1, 1.0 - k / 100, 500) for k in range(20)]
    r = evidence.pack(spark.createDataFrame(rows, "query_id long, chunk_id long, path string, priority long, score double, tokens long")).first()
    assert r["tokens"] <= 2400 and r["items"] <= 12 and r["sources"] == 3 and r["items"] + r["dropped"] == 20


def test_findings_stop_after_the_cap(spark):
    docs = spark.createDataFrame([(1, "eval (x)\nok\nexec(y) eval(z)"), (2, "password = 'longenough1'")], "id long, content string")
    found = findings.line_findings(docs, "id")
    assert {(r["id"], r["line_no"], r["rule"]) for r in found.collect()} == {(1, 1, "eval"), (1, 3, "eval"), (1, 3, "exec"), (2, 1, "hard-coded secret")}
    capped = findings.cap_findings(found.withColumn("scope", F.lit("s")), "scope", ["id", "line_no"], 2)
    assert capped.count() == 3


def test_directory_cards(spark):
    files = spark.createDataFrame([("s", "a/b/x.py", "python"), ("s", "a/y.md", "markdown"), ("s", "z.txt", "text")], "snapshot_id string, path string, language string")
    got = {r["directory"]: (r["files"], r["languages"], r["parent"]) for r in corpus_map.directory_cards(files).collect()}
    assert got == {"a": (2, "markdown,python", None), "a/b": (1, "python", "a")}


def test_scan_and_upsert(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\n")
    (tmp_path / "src" / "b.py").write_bytes(b"\x00\x01")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.js").write_bytes(b"1")
    got = {r["path"]: (r["indexable"], r["ignored_reason"]) for r in corpus.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": (True, None), "src/b.py": (False, "binary")}
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, at long")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id long, v string, at long")
    assert {(r["id"], r["v"]) for r in corpus.upsert(old, new, ["id"], "at").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_alert_fires_once_per_run(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, i, start + timedelta(minutes=i), None if i % 2 else 0.0) for i in range(25)] + [(1, 30, start + timedelta(minutes=30), 0.9)]
    rows += [(1, 31 + i, start + timedelta(minutes=31 + i), 0.001) for i in range(10)]
    df = spark.createDataFrame(rows, "repo_id long, id long, created_at timestamp, top_score double")
    assert sorted(r["id"] for r in telemetry.low_score_alerts(df).collect()) == [9, 40]


def test_location_terms_hints_and_clauses(spark):
    q = "Where does the handler of HTTPAdapter.send retry, and how the Session is closed by requests.sessions.Session.close"
    assert one(spark, q, locate.location_terms) == ["adapter", "close", "closed", "handler", "http", "requests", "retry", "send", "session", "sessions"]
    h = one(spark, q, locate.hints)
    assert h["methods"] == ["httpadapter.send", "session.close"] and h["symbols"] == ["requests.sessions.session.close"]
    clauses = one(spark, q, locate.sub_questions)
    assert clauses[0] == q and clauses[1].startswith("Where does the handler") and len(clauses) == 4


def test_keyphrases(spark):
    q = spark.createDataFrame([(1, "local development user for the model provider address"), (2, "of the"), (3, "Alpha beta and alpha Beta")], "query_id long, query string")
    got = {}
    for r in locate.keyphrases(q).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["phrase"])
    assert got == {1: ["local development user", "development user", "model provider address", "provider address"], 3: ["Alpha beta"]}


def test_windows_do_not_overlap(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "x", "y", "z"]
    rows = [(1, k, ["alpha", "beta"], "\n".join(" ".join(rng.choice(words, 3)) if rng.random() < 0.3 else "" for _ in range(int(rng.integers(10, 80)))), 5) for k in range(12)]
    got: dict = {}
    for r in locate.windows(spark.createDataFrame(rows, "query_id long, chunk_id long, terms array<string>, content string, start_line int")).collect():
        got.setdefault(r["chunk_id"], []).append((r["start_line"], r["end_line"], r["hits"]))
    for _, k, terms, content, start in rows:
        lines = content.split("\n")
        last = start + len(lines) - 1
        found = sorted((-len(set(x.split()) & set(terms)), start + i) for i, x in enumerate(lines) if set(x.split()) & set(terms))
        chosen: list = []
        for score, line in found:
            a, b = max(start, line - 6), min(last, line + 1)
            if not any(a <= w[1] and w[0] <= b for w in chosen):
                chosen.append((a, b, -score))
        if found and last - start < 24:
            chosen = [(start, last, -found[0][0])]
        assert sorted(got.get(k, [])) == sorted(chosen)


def test_ranges_are_dropped_in_rank_order(spark):
    rows = [(1, "a", 1, 5, 1), (1, "a", 4, 9, 2), (1, "b", 4, 9, 3), (1, "a", 10, 12, 4), (1, "a", 20, 22, 5), (1, "c", 1, 1, 6)]
    got = locate.drop_overlaps(spark.createDataFrame(rows, "query_id long, path string, start_line int, end_line int, rank int"), 3)
    assert sorted(r["rank"] for r in got.collect()) == [1, 3, 4]
