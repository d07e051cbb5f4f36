"""Registered queries: import binding, reranking, batch embedding, regression of metrics, code rules, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, findings, fusion, linking, semantic
from ..sources.corpus import chunks, table
from ..sources.shared import folder
from ..streaming import sink
from ..streaming import telemetry as streams
from . import retrieval
from .corpus import _LINES_CTE


def import_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as modules, each importing the one of twice its number by its full name, or its neighbour from the same folder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("folder"))
    name = lambda folder, i: F.concat(F.replace(folder, F.lit("/"), F.lit(".")), F.lit(".d"), i.cast("string"))
    modules = docs.select(F.col("doc_id").alias("symbol"), name(F.col("folder"), F.col("doc_id")).alias("qualified"))
    twice = docs.select((F.col("doc_id") * 2).alias("symbol"), "doc_id", "folder").join(modules, "symbol", "left")
    target = F.when(F.col("doc_id") % 2 == 0, F.coalesce("qualified", F.lit("no.such.module"))).otherwise(F.concat(F.lit(".d"), (F.col("doc_id") + 1).cast("string")))
    relations = twice.select(F.col("doc_id").alias("relation_id"), F.concat("folder", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), target.alias("target_ref"))
    return linking.link_imports(relations, modules).where("method = 'module'").select("relation_id", "n", "target", "method")


BINDING_SQL = """WITH d AS (SELECT doc_id, source || '/' || lang AS f FROM documents)
SELECT a.doc_id AS relation_id, 1::BIGINT AS n, b.doc_id AS target, 'module' AS method FROM d a JOIN d b ON CASE WHEN a.doc_id % 2 = 0 THEN b.doc_id = a.doc_id * 2 ELSE b.doc_id = a.doc_id + 1 AND a.f = b.f END"""


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused rows whose first ten are ordered anew by their semantic score."""
    fused = retrieval.rrf_fuse(spark, sf_dir)
    return fusion.rerank_head(fused, F.coalesce("semantic_score", F.lit(0.0)), 10).select("query_id", "chunk_id", "position", "reranked")


RERANK_SQL = retrieval._two_channels(""" SELECT query_id, chunk_id, position,
  row_number() OVER (PARTITION BY query_id ORDER BY position > 10, CASE WHEN position <= 10 THEN -coalesce(semantic_score, 0) END, position)::INT AS reranked FROM fused""")

#: Characters that the provider of ``batch_embedding`` takes.
MOST = 1000


def _provider(texts: list[str]) -> list[list[float]]:
    if any(len(t) > MOST for t in texts):
        raise ValueError("too long")
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def batch_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all texts from a provider that refuses long ones: batches are halved, then texts."""
    rows = chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("content_hash"), F.coalesce("content", F.lit("")).alias("input"))
    found = semantic.embed(rows, _provider)
    return found.select(F.col("content_hash").cast("bigint").alias("chunk_id"), F.col("vector")[0].alias("length"), F.col("vector")[1].alias("spaces"), "error")


EMBED_SQL = f"""WITH t AS (SELECT doc_id AS chunk_id, coalesce(text, '') AS t, list_filter(range(40), lambda k: length(coalesce(text, '')) >> k <= {MOST})[1] AS k FROM documents),
c AS (SELECT chunk_id, left(t, length(t) >> k) AS t FROM t)
SELECT chunk_id, length(t)::FLOAT AS length, (length(t) - length(replace(t, ' ', '')))::FLOAT AS spaces, NULL::VARCHAR AS error FROM c"""


def metric_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of events by type against those without the largest user, within a tenth."""
    e = table(spark, sf_dir, "events")
    means = lambda rows: rows.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return evaluate.regression(means(e), means(e.where("user_id > 3")), 0.1)


REGRESSION_SQL = """WITH a AS (SELECT event_type AS metric, round(avg(value), 6) AS actual FROM events GROUP BY 1), b AS (SELECT event_type AS metric, round(avg(value), 6) AS frozen FROM events WHERE user_id > 3 GROUP BY 1)
SELECT metric, actual, frozen, coalesce(abs(actual - frozen) <= 0.1, false) AS ok FROM a FULL JOIN b USING (metric)"""


def code_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a line of code below their text, of five kinds that a rule names and one that none does."""
    code = F.element_at(F.array(*map(F.lit, ("x = eval (y)", "exec(z)", "pickle.loads(b)", "yaml.load(f)", "subprocess.run(c, shell=True)", "evaluate(x)"))), (F.col("chunk_id") % 6 + 1).cast("int"))
    docs = chunks(spark, sf_dir).withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit("\n"), code))
    return findings.line_findings(docs, "chunk_id", findings.CODE_RULES)


CODE_SQL = f"""WITH {_LINES_CTE.replace("coalesce(text, '')", "coalesce(text, '') || chr(10) || ['x = eval (y)', 'exec(z)', 'pickle.loads(b)', 'yaml.load(f)', 'subprocess.run(c, shell=True)', 'evaluate(x)'][doc_id % 6 + 1]")},
r AS (SELECT * FROM (VALUES ('eval', 'high', '\\beval\\s*\\('), ('exec', 'high', '\\bexec\\s*\\('), ('pickle.loads', 'high', '\\bpickle[.]loads\\s*\\('), ('yaml.load', 'medium', '\\byaml[.]load\\s*\\('), ('shell=True', 'medium', 'subprocess[.][A-Za-z_]+\\([^\\n]*shell\\s*=\\s*True')) AS v(rule, severity, p))
SELECT chunk_id, line_no::INT AS line_no, rule, severity, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS snippet FROM ln JOIN r ON regexp_matches(line, p)"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(kind).parquet(f"{sf_dir}/events*.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("tool_name"), F.col("value").alias("top_score"), F.lit(1.0).alias("duration_ms"))


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through the exactly-once sink, twice: rows and sums of each type are those of one pass."""
    stream, path = _stream(spark, sf_dir), f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    for attempt in ("first", "again"):  # the second run has lost its checkpoint, so every row comes again
        stream.writeStream.foreachBatch(sink.exactly_once(f"{path}/out")).option("checkpointLocation", f"{path}/{attempt}").trigger(availableNow=True).start().awaitTermination()
    held = sink.read(spark, f"{path}/out", stream.schema)
    return held.groupBy("tool_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("top_score"), 4).alias("total"))


STREAM_SQL = "SELECT event_type AS tool_name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily windows of the events as a stream gives them, after its last batch."""
    path = f"{folder(spark)}/daily-{uuid.uuid4().hex}"
    windows = streams.daily(_stream(spark, sf_dir), low=50.0)
    save = lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/out")
    windows.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    held = spark.read.schema(windows.schema).parquet(f"{path}/out")
    return held.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "tool_name", "requests", F.round("mean_score", 6).alias("mean_score"), "max_score", "low_scores")


DAILY_SQL = """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS tool_name, count(*) AS requests, round(avg(value), 6) AS mean_score, max(value) AS max_score, sum((value IS NULL OR value < 50)::INT)::BIGINT AS low_scores FROM events GROUP BY 1, 2"""

QUERIES = {
    "import_binding": import_binding, "reranked": reranked, "batch_embedding": batch_embedding, "metric_regression": metric_regression, "code_rule_findings": code_rule_findings,
    "stream_rows": stream_rows, "stream_daily": stream_daily,
}
ORACLES = {
    "import_binding": BINDING_SQL, "reranked": RERANK_SQL, "batch_embedding": EMBED_SQL, "metric_regression": REGRESSION_SQL, "code_rule_findings": CODE_SQL,
    "stream_rows": STREAM_SQL, "stream_daily": DAILY_SQL,
}
