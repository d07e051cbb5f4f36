"""Nothing is cut off before it is looked at."""

from lodeseam.operators import findings
from lodeseam.plans import contexts, corpus

SECRET = "password = 'correct horse battery'"


def _documents(spark, path, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{path}/documents.parquet")


def test_findings_read_whole_texts(spark, tmp_path):
    text = "filler line\n" * 5000 + SECRET + "\n-----BEGIN PRIVATE KEY-----"
    _documents(spark, tmp_path, [(1, text, "en", "a", len(text)), (2, SECRET, "en", "a", len(SECRET))])
    got = sorted((r["chunk_id"], r["line_no"], r["rule"]) for r in corpus.line_rule_findings(spark, str(tmp_path)).collect())
    assert got == [(1, 5001, "hard-coded secret"), (1, 5002, "private key"), (2, 1, "hard-coded secret")]
    assert corpus.finding_cap(spark, str(tmp_path)).count() == 3
    docs = spark.createDataFrame([(1, text)], "id bigint, content string")
    assert findings.line_findings(docs, "id", sample=30_000).count() == 0


def test_merge_slots_reads_whole_texts(spark, tmp_path):
    passage = "copper lantern drifts beyond quiet harbour"
    texts = ["zz " * 1000 + passage, "yy " * 10 + "nothing of it", "xx " * 10 + "or that"]
    _documents(spark, tmp_path, [(k, t, "en", "a", len(t)) for k, t in enumerate(texts)])
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["chunk_id"]: r["overlap"] for r in contexts.merge_slots(spark, str(tmp_path)).collect()}
    assert got[0] > 0
