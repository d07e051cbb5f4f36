"""Operators and queries that have no SQL, against plain Python."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from lodeseam import catalog
from lodeseam.functions import text as X
from lodeseam.operators import chunking, context, evaluate, evidence, findings, locate, telemetry
from lodeseam.sources import corpus, shared

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
TOKEN = re.compile(X.TOKEN_ESTIMATE.removeprefix("(?U)"))
BREAK = re.compile("\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]")


def _lines(text):
    lines = BREAK.split(text or "")
    return lines[:-1] if lines[-1] == "" else lines


def _size(text):
    return len(TOKEN.findall(text))


def _slices(lines, most, overlap):
    sizes = [_size(x) for x in lines]
    if not lines:
        return []
    if sum(sizes) <= most or len(lines) == 1:
        return [(1, len(lines), sum(sizes))]
    out, start, used = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and used + n > most:
            out.append((start + 1, k, used))
            if sizes[k - 1] <= overlap and sizes[k - 1] + n <= most and k - 1 > start:
                start, used = k - 1, sizes[k - 1]
            else:
                start, used = k, 0
        used += n
    return [*out, (start + 1, len(lines), used)]


@tables
def test_token_slices(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text as content", "1 as start_line")
    got: dict = {}
    for r in chunking.slices(docs, "doc_id", 120, 30).collect():
        got.setdefault(r["doc_id"], []).append((r["start_line"], r["end_line"], r["tokens"], r["content"]))
    for r in docs.collect():
        lines = _lines(r["content"])
        assert sorted(got.get(r["doc_id"], [])) == [(a, b, n, "\n".join(lines[a - 1 : b])) for a, b, n in _slices(lines, 120, 30)]


@tables
def test_paragraph_parts_lose_no_line(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text as content", "1 as start_line")
    got: dict = {}
    for r in chunking.split_paragraphs(docs, "doc_id", 300, 60).collect():
        got.setdefault(r["doc_id"], []).append((r["part"], r["start_line"], r["end_line"], r["content"]))
    for r in docs.collect():
        lines, seen = r["content"].split("\n"), 0
        for part, a, b, content in sorted(got[r["doc_id"]]):
            assert content == "\n".join(lines[a - 1 : b]) and a <= seen + 1 <= b
            assert len(content) <= 300 or a == b
            seen = b
        assert seen == len(lines)


def test_function_slices(spark):
    inner = "    def g():\n" + "        x = 1\n" * 150 + "    def h():\n" + "        y = 2\n" * 150
    code = "def f():\n    z = 3\n" + inner + "def k():\n" + "    a = 4\n" * 400 + "def small():\n    return 1\n"
    rows = chunking.function_slices(spark.createDataFrame([("m.py", code), ("bad.py", "def (")], "path string, content string")).collect()
    f = sorted((r["slice"], r["start_line"], r["end_line"]) for r in rows if r["name"] == "f")
    k = sorted((r["slice"], r["start_line"], r["end_line"]) for r in rows if r["name"] == "k")
    assert f == [(0, 1, 2), (1, 3, 153), (2, 154, 304)]
    assert k[0][1] == 305 and k[-1][2] == 705 and all(a[2] + 1 == b[1] for a, b in zip(k, k[1:], strict=False)) and len(k) > 1
    assert not [r for r in rows if r["name"] == "small"]


def _truncate(text, most):
    if _size(text) <= most:
        return text
    out, used = [], 0
    for block in re.findall(r"[^\n]*\n|[^\n]+", text):
        if used + _size(block) > most:
            words = []
            for w in block.split():
                if used + _size(w) > most:
                    break
                words.append(w)
                used += _size(w)
            out.append(" ".join(words))
            break
        out.append(block)
        used += _size(block)
    kept = "".join(out).rstrip() or text[: max(1, most)]
    return kept if kept == text else kept + "\n…"


def test_truncation(spark):
    texts = ["one two three four", "a b\nc d e\nf", "longword" * 3, "", "x, y; z!\n\nnext line here", "a\n" * 30]
    rows = [(t, n) for t in texts for n in (1, 2, 3, 5, 8)]
    df = spark.createDataFrame(rows, "t string, n int")
    for r in df.select("t", "n", X.truncate_tokens(F.col("t"), F.col("n")).alias("c")).collect():
        assert r["c"] == _truncate(r["t"], r["n"]), (r["t"], r["n"])


@tables
def test_packed_texts_fit(spark):
    rows = catalog.queries()["pack_texts"](spark, SF).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    assert all(sum(r["tokens"] for r in g) <= 2400 and len(g) <= 12 for g in by.values()) and any(r["cut"] for r in rows)


def test_candidates_beyond_the_first_count_as_dropped(spark):
    rows = spark.createDataFrame([("q", k, f"p{k % 7}", 1, float(k), 50) for k in range(30)], "query_id string, chunk_id long, path string, priority int, score double, tokens long")
    packed = evidence.pack(rows, evidence.Budget(candidates=10, items=4)).first()
    assert packed["items"] == 4 and packed["dropped"] == 26


def test_supported_large_files_are_read(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "big.MD").write_bytes(b"# x\n" * 100)
    (tmp_path / "big.bin").write_bytes(b"y" * 400)
    (tmp_path / "small.bin").write_bytes(b"z")
    (tmp_path / "wide.txt").write_bytes("a\nb\n".encode("utf-16"))
    got = {r["path"]: r for r in corpus.scan_files(spark, str(tmp_path), max_bytes=100).collect()}
    assert got["docs/big.MD"]["indexable"] and got["docs/big.MD"]["line_count"] == 100 and got["docs/big.MD"]["content_sha1"]
    assert got["big.bin"]["content_sha1"] is None and got["big.bin"]["ignored_reason"] == "unsupported_file_type" and got["small.bin"]["content_sha1"]
    assert got["wide.txt"]["text"].lstrip("\ufeff") == "a\nb\n" and got["wide.txt"]["file_type"] == "text" and got["wide.txt"]["line_count"] == 2


def test_drift_stops_a_publish(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, content_sha1 string")
    corpus.require_no_drift(a, a)
    with pytest.raises(ValueError, match="q"):
        corpus.require_no_drift(a, a.where("path = 'p'"))


def test_captures_and_reports(spark, tmp_path):
    queries = [{"id": "a", "ranked": ["x"]}, {"id": "b", "ranked": []}]
    (tmp_path / "one.json").write_text("\ufeff" + json.dumps({"project": "p", "queries": queries}), encoding="utf-8")
    (tmp_path / "bad.json").write_text("{")
    rows = corpus.read_captures(spark, str(tmp_path / "*.json"), "project string, queries array<struct<id: string, ranked: array<string>>>").collect()
    assert sorted((r["id"] or "", r["project"] or "") for r in rows) == [("", ""), ("a", "p"), ("b", "p")]
    assert sum(r["_corrupt"] is not None for r in rows) == 1
    found = spark.createDataFrame([("r", "security", 1, "t", "high"), ("r", "documents", 1, "u", "info")], "report_id string, section string, ord int, title string, severity string")
    sections = findings.report_sections(found, spark.createDataFrame([("r", "C:\\x")], "report_id string, alias string"))
    corpus.write_report(sections, str(tmp_path / "out"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out" / "markdown")).collect())
    assert "## Summary" in text and "- [high] t" in text and "local-repository" in text
    assert spark.read.json(str(tmp_path / "out" / "json")).count() == 3


def test_a_snapshot_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "facts")
    corpus.replace_snapshot(spark.createDataFrame([("a", 1), ("b", 2)], "snapshot_id string, v int"), path)
    corpus.replace_snapshot(spark.createDataFrame([("a", 9)], "snapshot_id string, v int"), path)
    assert sorted((r["snapshot_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


def test_telemetry_rows_and_regression_gate(spark):
    rows = spark.createDataFrame([("secret", -3, -1.0)], "query string, returned_count int, duration_ms double")
    r = telemetry.record(rows).first()
    assert (r["query"], r["returned_count"], r["duration_ms"]) == ("[redacted]", 0, 0.0)
    m = lambda *v: spark.createDataFrame(list(v), "metric string, value double")
    got = {r["metric"]: r["ok"] for r in evaluate.regression(m(("a", 1.0), ("b", 2.0)), m(("a", 1.0), ("b", 2.1))).collect()}
    assert got == {"a": True, "b": False}


def test_executable_lines(spark):
    code = "import x\n# find me\n\n'''find\nfind\n'''\n\"\"\"find me\"\"\"\n/* find\n find */\nfind(me)\n* find\n// find\n/* find */\nlast find\n"
    rows = spark.createDataFrame([(1, code, ["find", "me"])], "id int, content string, terms array<string>")
    got = {r["line_no"]: r["hits"] for r in locate.executable_hits(rows, ["id"]).collect()}
    assert got == {1: 0, 10: 2, 14: 1}


def test_locator(spark):
    asked = spark.createDataFrame([(1, "Where does the parser read tokens and how does Lexer.next_token advance?")], "query_id int, query string")
    body = "def read_tokens(self):\n    return parse(tokens)\n"
    units = spark.createDataFrame(
        [(1, "src/parser.py", "function", 10, 11, body, "read_tokens"), (2, "src/lexer.py", "method", 5, 6, "def next_token(self):\n    pass\n", "next_token"), (3, "docs/a.md", "text", 1, 40, "tokens\n" + "filler\n" * 39, None), (4, "src/parser.py", "function", 10, 12, body, "read_tokens")],
        "unit_id long, path string, kind string, start_line int, end_line int, content string, symbol string",
    )
    symbols = spark.createDataFrame([(7, "read_tokens", "parser.read_tokens", "function", 1), (8, "next_token", "lexer.Lexer.next_token", "method", 2)], "symbol long, name string, qualified string, kind string, unit_id long")
    calls = spark.createDataFrame([(7, 8)], "source long, target long")
    hits = spark.createDataFrame([(1, 1, 9.0), (1, 1, 3.0), (1, 3, 30.0), (1, 4, 2.0)], "query_id int, chunk_id long, score double")
    rows = sorted(locate.locate(asked, hits, symbols, calls, units).collect(), key=lambda r: r["rank"])
    places = [(r["path"], r["start_line"], r["end_line"]) for r in rows]
    assert places[0] == ("src/lexer.py", 5, 6) and rows[0]["basis"] == "exact_symbol"  # named outright
    assert places.count(("src/parser.py", 10, 11)) == 1 and ("src/parser.py", 10, 12) not in places  # overlaps a better place
    assert places[-1][0] == "docs/a.md" and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


@tables
def test_located_places_do_not_overlap(spark):
    for name, limit in (("locate_code", 8), ("location_windows", 8)):
        by: dict = {}
        for r in catalog.queries()[name](spark, SF).collect():
            by.setdefault(r["query_id"], []).append((r["path"], r["start_line"], r["end_line"]))
        assert by and all(len(places) <= limit for places in by.values())
        for places in by.values():
            for i, (p, a, b) in enumerate(places):
                assert not any(p == q and a <= d and c <= b for q, c, d in places[i + 1 :])


@tables
def test_context_bundle(spark):
    rows = catalog.queries()["context_bundle"](spark, SF).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    assert {r["origin"] for r in rows} == {"primary", "phrase", "supplement"}
    for group in by.values():
        assert sorted(r["position"] for r in group) == list(range(1, len(group) + 1)) and len(group) <= 8
        assert len({(r["path"], r["start_line"], r["end_line"]) for r in group}) == len(group)


@tables
def test_merged_slots(spark):
    rows = catalog.queries()["merge_slots"](spark, SF).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r["position"])
    assert by and all(sorted(p) == list(range(1, len(p) + 1)) and len(p) <= 8 for p in by.values())


@tables
def test_redacted_turns(spark):
    rows = catalog.queries()["redact_text"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/conversations.parquet").count() and any(r["changed"] for r in rows)


def test_supplement_and_recovery(spark):
    asked = spark.createDataFrame([(1, ["impact"], False, True), (2, ["test"], False, False), (3, [], False, False)], "query_id int, intents array<string>, has_definition boolean, has_source boolean")
    answer = spark.createDataFrame([(q, k, 10 * q + k, "p", 1, 2) for q in (1, 2, 3) for k in range(6)], "query_id int, ord int, chunk_id int, path string, start_line int, end_line int")
    got: dict = {}
    for r in context.supplement(asked, {"impact": answer, "tests": answer, "symbol": answer}).collect():
        got.setdefault((r["query_id"], r["role"]), []).append(r["ord"])
    assert {k: len(v) for k, v in got.items()} == {(1, "static_impact_evidence"): 4, (1, "symbol_definition"): 4, (2, "related_test"): 4, (2, "symbol_definition"): 4, (3, "symbol_behavior_evidence"): 4}


def test_written_needs_a_shared_folder(spark):
    df = shared.written(spark.range(3), "t")
    assert df.count() == 3 and df.inputFiles()[0].startswith(spark.conf.get("spark.checkpoint.dir"))


@tables
def test_large_query_sets_take_the_other_way(spark, monkeypatch):
    """Beyond the bounds, BM25 goes through the join and cosine through buckets, with equal results."""
    from lodeseam.operators import lexical, semantic

    docs = corpus.chunks(spark, SF)
    asked = corpus.questions(spark, SF).select("query_id", X.query_terms(F.col("query")).alias("terms"))
    rows = lambda: sorted((r["query_id"], r["chunk_id"], r["score"]) for r in lexical.bm25_top(asked, docs, 20).collect())
    small = rows()
    monkeypatch.setattr(lexical, "MATRIX_CELLS", 0)
    assert rows() == small and len(small) >= 800
    e = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "embedding as vector")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    top = lambda **k: sorted(map(tuple, semantic.cosine_top_k(q, e, 5, query_block=4, **k).collect()))
    assert top() == top(broadcast_bytes=1000)


def test_index_splits_hot_terms(spark, tmp_path):
    from lodeseam.operators import lexical

    docs = spark.range(3000).select(F.lit("s").alias("snapshot_id"), F.col("id").alias("chunk_id"), F.concat(F.lit("the w"), F.col("id").cast("string")).alias("content"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # which would join such small ranges again
    try:
        lexical.build_index(docs, str(tmp_path / "index"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = spark.read.parquet(str(tmp_path / "index" / "postings")).where("term = 'the'").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in held) == 3000 and len(held) > 1
    asked = spark.createDataFrame([(1, ["w77"])], "query_id int, terms array<string>")
    assert [r["chunk_id"] for r in lexical.bm25_indexed(asked, str(tmp_path / "index")).collect()] == [77]
