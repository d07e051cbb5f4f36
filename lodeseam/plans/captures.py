"""Registered queries of captures and their checks: rates, coverage, validation, shapes, stage times, and the state of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, fusion, lexical, semantic
from ..sources.corpus import chunks, questions, table
from . import retrieval


def parameter_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: a value below 400 is valid, none is not."""
    return evaluate.parameter_pass_rate(table(spark, sf_dir, "events").select("event_type", (F.col("value") < 400).alias("valid")), "event_type")


PASS_SQL = "SELECT event_type, count(*) AS calls, count(*) FILTER (value < 400) AS valid, round(count(*) FILTER (value < 400) / count(*), 9) AS rate FROM events GROUP BY 1"


def location_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as location tasks of their type."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 3 == 0).alias("passed"), (F.col("event_id") % 5 / 4).alias("coverage"), (1 / (F.col("event_id") % 7 + 1)).alias("reciprocal_rank"), F.col("value").alias("duration_ms"))
    return evaluate.location_summary(rows, "event_type")


LOCATION_SUMMARY_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT event_type, max(value) FILTER (i = floor((n - 1) * 0.5)) AS p50_ms, max(value) FILTER (i = floor((n - 1) * 0.95)) AS p95_ms FROM r GROUP BY 1),
m AS (SELECT event_type, count(*) AS tasks, round(avg((event_id % 3 = 0)::INT), 9) AS pass_rate, round(avg(event_id % 5 / 4), 9) AS coverage, round(avg(1 / (event_id % 7 + 1)), 9) AS mrr FROM events GROUP BY 1)
SELECT * FROM m JOIN p USING (event_type)"""


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders are tasks, their items the alternatives of two groups; shipments of the same part are what tools return."""
    i = table(spark, sf_dir, "lineitem")
    path = (F.col("l_partkey") % 5).cast("string")
    at = F.col("l_quantity").cast("int")
    required = i.select(F.col("l_orderkey").alias("task_id"), (F.col("l_linenumber") % 2).alias("group_id"), path.alias("path"), at.alias("start_line"), (at + 3).alias("end_line"))
    tool = F.when(F.col("l_linestatus") == "O", "locator").otherwise("context")
    evidence = i.select(tool.alias("tool"), F.col("l_orderkey").alias("task_id"), path.alias("path"), (at - 8).alias("start_line"), (at + 8).alias("end_line"))
    return required, evidence


_RANGES = """rq AS (SELECT l_orderkey AS task_id, l_linenumber % 2 AS g, l_partkey % 5 AS path, l_quantity::INT AS a, l_quantity::INT + 3 AS b FROM lineitem),
ev AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'locator' ELSE 'context' END AS tool, l_orderkey AS task_id, l_partkey % 5 AS path, l_quantity::INT - 8 AS a, l_quantity::INT + 8 AS b FROM lineitem)"""


def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    required, evidence = _ranges(spark, sf_dir)
    return evaluate.group_coverage(required, evidence)


EVIDENCE_COVERAGE_SQL = f"""WITH {_RANGES}, h AS (SELECT DISTINCT task_id, g FROM rq JOIN ev USING (task_id, path) WHERE ev.a <= rq.b AND rq.a <= ev.b), gr AS (SELECT DISTINCT task_id, g FROM rq)
SELECT gr.task_id, count(*) AS groups, count(h.g) AS covered, count(h.g) = count(*) AS passed FROM gr LEFT JOIN h ON h.task_id = gr.task_id AND h.g = gr.g GROUP BY 1"""


def tool_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by either tool's evidence and by both, per tool."""
    found = evaluate.tool_audit(*_ranges(spark, sf_dir))
    return found.groupBy("tool").agg(F.count(F.lit(1)).alias("tasks"), F.sum("covered").alias("covered"), F.sum(F.col("passed").cast("int")).alias("passed"))


TOOL_AUDIT_SQL = f"""WITH {_RANGES}, e2 AS (SELECT * FROM ev UNION ALL SELECT 'union', task_id, path, a, b FROM ev), t AS (SELECT DISTINCT tool FROM e2), gr AS (SELECT DISTINCT tool, task_id, g FROM rq, t),
h AS (SELECT DISTINCT tool, task_id, g FROM rq JOIN e2 USING (task_id, path) WHERE e2.a <= rq.b AND rq.a <= e2.b),
s AS (SELECT gr.tool, gr.task_id, count(*) AS n, count(h.g) AS c FROM gr LEFT JOIN h ON h.tool = gr.tool AND h.task_id = gr.task_id AND h.g = gr.g GROUP BY ALL)
SELECT tool, count(*) AS tasks, sum(c)::BIGINT AS covered, count(*) FILTER (n = c) AS passed FROM s GROUP BY 1"""


def symbol_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders must have every status, a priority's last word, and the role of their segment."""
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.array(F.lit("F"), F.lit("O")).alias("paths"), F.lit("HIGH").alias("symbol"), F.array(F.lit("a")).alias("roles"))
    returned = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderstatus").alias("path"), F.replace("o_orderpriority", F.lit("-"), F.lit(".")).alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("role"))
    return evaluate.symbol_checks(tasks, returned)


CHECKS_SQL = """SELECT c_custkey AS task_id, coalesce(bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O'), false) AS paths_met, coalesce(bool_or(ends_with(o_orderpriority, '-HIGH')), false) AS symbol_met,
  coalesce(bool_or(o_orderkey % 2 = 0), false) AS roles_met FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as result rows: two modes, counters that may be negative or missing, paths that may be unsafe."""
    n = F.col("l_linenumber")
    path = F.when(n == 5, "/etc/x").when(n == 6, "a/../b").otherwise("src/x.py")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("benchmark_id"), F.col("l_orderkey").alias("task_id"), F.when(n % 2 == 0, "baseline").otherwise("treatment").alias("mode"),
        F.when(n != 3, F.col("l_quantity").cast("int") - 3).alias("input_tokens"), path.alias("path"), F.when(n == 2, "failed").when(n > 2, "passed").alias("status"),
        F.when(n % 3 == 0, "provider").when(n % 3 == 1, "guess").alias("usage_provenance"), F.when(n != 6, F.sha2(n.cast("string"), 256)).alias("raw_trace_sha256"),
    )


_RESULTS = """rs AS (SELECT l_returnflag AS benchmark_id, l_orderkey AS task_id, CASE WHEN l_linenumber % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS mode, CASE WHEN l_linenumber <> 3 THEN l_quantity::INT - 3 END AS tok,
  l_linenumber IN (5, 6) AS unsafe, CASE WHEN l_linenumber = 2 THEN 'failed' WHEN l_linenumber > 2 THEN 'passed' END AS status, l_linenumber AS n FROM lineitem)"""


def result_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    known = table(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").select(F.lit("R").alias("benchmark_id"), F.col("o_orderkey").alias("task_id"))
    found = evaluate.violations(rows, known, ("input_tokens",), "path")
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("task_id").alias("first"))


RESULT_VIOLATIONS_SQL = f"""WITH {_RESULTS}, k AS (SELECT 'R' AS benchmark_id, o_orderkey AS task_id FROM orders WHERE o_orderkey % 4 > 0), t AS (SELECT DISTINCT benchmark_id, task_id FROM rs),
v AS (SELECT 'duplicate_row' AS code, task_id FROM rs GROUP BY benchmark_id, task_id, mode HAVING count(*) > 1 UNION ALL SELECT 'missing_cohort', task_id FROM rs GROUP BY benchmark_id, task_id HAVING count(DISTINCT mode) < 2
UNION ALL SELECT 'negative_or_missing_input_tokens', task_id FROM rs WHERE coalesce(tok, -1) < 0 UNION ALL SELECT 'unsafe_path', task_id FROM rs WHERE unsafe
UNION ALL SELECT 'unknown_task', task_id FROM t WHERE (benchmark_id, task_id) NOT IN (SELECT (benchmark_id, task_id) FROM k) UNION ALL SELECT 'missing_task', task_id FROM k WHERE (benchmark_id, task_id) NOT IN (SELECT (benchmark_id, task_id) FROM t))
SELECT code, count(*) AS n, min(task_id) AS first FROM v GROUP BY 1"""


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.status_counts(_results(spark, sf_dir), "status", "usage_provenance")


STATUS_COUNTS_SQL = f"""WITH {_RESULTS} SELECT benchmark_id, mode, 'status' AS field, status AS value, count(*) AS n FROM rs WHERE status IS NOT NULL GROUP BY ALL
UNION ALL SELECT benchmark_id, mode, 'usage_provenance', CASE n % 3 WHEN 0 THEN 'provider' ELSE 'guess' END, count(*) FROM rs WHERE n % 3 < 2 GROUP BY ALL"""


def provenance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.provenance_gaps(_results(spark, sf_dir))


PROVENANCE_SQL = f"WITH {_RESULTS} SELECT benchmark_id, task_id, mode, CASE WHEN n % 3 <> 0 THEN 'unknown_provenance' ELSE 'no_trace_digest' END AS code FROM rs WHERE n % 3 <> 0 OR n = 6"


def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation quality of a source's three lowest documents against its three highest."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item"))
    gold = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("item")), "item")
    ids = docs.groupBy("query_id").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    cut = lambda start: evaluate.citations(ids.select("query_id", F.explode(F.slice("ids", start, F.lit(3))).alias("item")), gold)
    return evaluate.before_after(cut(F.lit(1)), cut(F.greatest(F.size("ids") - 2, F.lit(1))), ("precision", "relevant_cited"))


BEFORE_SQL = """WITH r AS (SELECT source AS q, doc_id AS i, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS lo, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS hi FROM documents),
g AS (SELECT DISTINCT source AS q, doc_id AS i FROM documents JOIN labels USING (doc_id) WHERE quality = 1), gq AS (SELECT DISTINCT q FROM g),
c AS (SELECT q, count(*) FILTER (lo <= 3) AS nl, count(*) FILTER (hi <= 3) AS nh, count(g.i) FILTER (lo <= 3) AS rl, count(g.i) FILTER (hi <= 3) AS rh FROM r LEFT JOIN g USING (q, i) GROUP BY 1),
m AS (SELECT round(avg(round(rl / nl, 9)), 9) AS pb, round(avg(round(rh / nh, 9)), 9) AS pa, round(avg(rl), 9) AS rb, round(avg(rh), 9) AS ra FROM c WHERE q IN (SELECT q FROM gq))
SELECT 'precision' AS metric, pb AS "before", pa AS "after", round(pa - pb, 6) AS change FROM m UNION ALL SELECT 'relevant_cited', rb, ra, round(ra - rb, 6) FROM m"""


def trace_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as traces."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("step"), F.left("event_type", F.lit(2)).alias("kind"), F.col("event_type").alias("tool"), (F.col("event_id") % 4).cast("string").alias("path"))
    return evaluate.trace_shape(rows)


SHAPE_SQL = """SELECT user_id AS trace_id, string_agg(left(event_type, 2), '>' ORDER BY event_id) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tools,
  string_agg(DISTINCT (event_id % 4)::VARCHAR, ',' ORDER BY (event_id % 4)::VARCHAR) AS paths FROM events GROUP BY 1"""


def cited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with finished orders cite the priorities of all their open ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("path"), "o_orderstatus", "o_orderkey")
    return evaluate.cited_files(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"))


CITED_SQL = """WITH g AS (SELECT o_custkey AS q, list(DISTINCT o_orderpriority) AS g FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), c AS (SELECT o_custkey AS q, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS c FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT q AS query_id, coalesce(array_to_string(c, ','), '') AS files, list_has_all(coalesce(c, []), g) AS passed FROM g LEFT JOIN c USING (q)"""


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event values in hundredths as stage times of runs that took a quarter longer."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("ms"))
    whole = rows.groupBy("run_id").agg((F.sum("ms") + F.floor(F.sum("ms") / 4)).alias("ms"))
    return evaluate.stage_times(rows, whole)


STAGES_SQL = """WITH r AS (SELECT user_id AS run_id, event_type AS stage, round(coalesce(value, 0) * 100)::BIGINT AS ms FROM events), k AS (SELECT run_id, sum(ms)::BIGINT AS k FROM r GROUP BY 1), w AS (SELECT run_id, k, k + k // 4 AS w FROM k),
s AS (SELECT run_id, stage, sum(ms)::BIGINT AS ms FROM r GROUP BY ALL UNION ALL SELECT run_id, 'unattributed', w - k FROM w)
SELECT run_id, stage, ms, CASE WHEN w <> 0 THEN round_even(100 * ms::DOUBLE / w, 2) END AS share FROM s JOIN w USING (run_id)"""


def capture_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of users' queries: events of an hour are a query, its users ranked by event, those of even events relevant."""
    e = table(spark, sf_dir, "events")
    items = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "user_id"))), lambda x: x["user_id"])
    rows = e.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(
        items.alias("ranked"), F.sort_array(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("user_id")))).alias("relevant"), F.sort_array(F.collect_set(F.when(F.col("event_id") % 5 == 0, F.col("user_id")))).alias("cited"),
        F.sort_array(F.collect_set("event_type")).alias("chosen"), F.min("value").alias("duration_ms"),
    )
    day = F.dayofmonth("h")
    expected = F.when(day % 3 > 0, F.array(F.lit("click"), F.lit("view")))
    timed = F.when((day % 4 > 0) | (F.hour("h") > 12), F.col("duration_ms"))
    return evaluate.capture_metrics(rows.select((day % 12).alias("capture_id"), F.col("h").alias("query_id"), "ranked", "relevant", "cited", F.when(day % 3 > 0, F.col("chosen")).alias("chosen"), expected.alias("expected"), timed.alias("duration_ms")))


CAPTURE_SQL = """WITH q AS (SELECT date_trunc('hour', ts) AS h, list(user_id ORDER BY event_id, user_id) AS rk, coalesce(list(DISTINCT user_id) FILTER (event_id % 2 = 0), []) AS rel, coalesce(list(DISTINCT user_id) FILTER (event_id % 5 = 0), []) AS ci,
  list(DISTINCT event_type ORDER BY event_type) AS ch, min(value) AS ms FROM events GROUP BY 1),
d AS (SELECT *, day(h) % 12 AS c, day(h) % 3 > 0 AS tools, CASE WHEN day(h) % 4 > 0 OR hour(h) > 12 THEN ms END AS t FROM q),
s AS (SELECT *, coalesce(len(list_intersect(rk[1:5], rel)) / nullif(len(rel), 0), 0) AS r5, coalesce(len(list_intersect(rk[1:10], rel)) / nullif(len(rel), 0), 0) AS r10,
  coalesce(1 / list_min(list_filter(list_transform(rel, lambda x: list_position(rk, x)), lambda p: p > 0)), 0) AS rr FROM d)
SELECT c AS capture_id, count(*) AS queries, round(avg(r5), 9) AS recall_5, round(avg(r10), 9) AS recall_10, round(avg(rr), 9) AS mrr, round(avg(list_has_any(ci, rel)::INT), 9) AS hit_rate,
  CASE WHEN bool_and(tools) THEN round(avg((ch = ['click', 'view'])::INT), 9) END AS tool_match, CASE WHEN count(t) = count(*) THEN quantile_disc(t, 0.5) END AS p50_ms,
  (bool_and(tools) OR NOT bool_or(tools)) AND count(t) IN (0, count(*)) AS complete FROM s GROUP BY 1"""


def first_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' first five imports and calls among their line items."""
    i = table(spark, sf_dir, "lineitem")
    rows = i.select(
        F.col("l_suppkey").alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_linenumber") % 3 == 0, "imports").when(F.col("l_linenumber") % 3 == 1, "calls").otherwise("contains").alias("kind"),
        (F.col("l_partkey") % 40).cast("string").alias("target"), (F.col("l_returnflag") != "A").alias("observed"),
    )
    return semantic.first_relations(rows).select("symbol", F.array_join("imports", ",").alias("imports"), F.array_join("calls", ",").alias("calls"))


FIRST_SQL = """WITH r AS (SELECT l_suppkey AS symbol, l_orderkey * 10 + l_linenumber AS o, l_linenumber % 3 AS k, (l_partkey % 40)::VARCHAR AS t FROM lineitem WHERE l_returnflag <> 'A' AND l_linenumber % 3 < 2),
f AS (SELECT symbol, k, t, min(o) AS o FROM r GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY symbol, k ORDER BY o, t) AS n FROM f)
SELECT symbol, coalesce(string_agg(t, ',' ORDER BY n) FILTER (k = 0), '') AS imports, coalesce(string_agg(t, ',' ORDER BY n) FILTER (k = 1), '') AS calls FROM n WHERE n <= 5 GROUP BY 1"""


def provider_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ten vectors, some shortened, repeated, misnumbered or not finite by their number."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("batch_id"), (F.col("vec_id") % 10).alias("index"), F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    answers = e.where("vec_id % 17 > 0").withColumn("index", F.when(F.col("vec_id") % 23 == 0, 99).otherwise(F.col("index")))
    vector = F.when(F.col("vec_id") % 29 == 0, F.slice("v", 1, 8)).when(F.col("vec_id") % 31 == 0, F.transform("v", lambda x: x * float("inf"))).otherwise(F.col("v"))
    answers = answers.select("batch_id", "index", vector.alias("vector"), "vec_id")
    return semantic.provider_violations(e.select("batch_id", "index"), answers.drop("vec_id").unionByName(answers.where("vec_id % 37 = 0").drop("vec_id")))


PROVIDER_SQL = """WITH e AS (SELECT vec_id, vec_id // 10 AS b, vec_id % 10 AS i FROM embeddings), a AS (SELECT vec_id, b, CASE WHEN vec_id % 23 = 0 THEN 99 ELSE i END AS i, vec_id % 29 = 0 AS short, vec_id % 29 <> 0 AND vec_id % 31 = 0 AS inf FROM e WHERE vec_id % 17 > 0),
b AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE vec_id % 37 = 0),
v AS (SELECT b, 'missing_answer' AS code, 1 AS n FROM e WHERE (b, i) NOT IN (SELECT (b, i) FROM b) UNION ALL SELECT b, 'unknown_index', 1 FROM b WHERE i > 9
UNION ALL SELECT b, 'repeated_answer', count(*) - 1 FROM b GROUP BY b, i HAVING count(*) > 1 UNION ALL SELECT b, 'not_finite', 1 FROM b WHERE inf UNION ALL SELECT b, 'mixed_dimensions', 2 FROM b GROUP BY b HAVING count(DISTINCT short) > 1)
SELECT b AS batch_id, code, sum(n)::BIGINT AS n FROM v GROUP BY ALL"""


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by label as snapshots: some have none, some queries no vector or a short one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("snapshot_id"), F.col("embedding").cast("array<double>").alias("v"))
    vector = F.when(F.col("vec_id") % 3 == 0, F.col("v")).when(F.col("vec_id") % 3 == 1, F.slice("v", 1, 3))
    return semantic.availability(e.select(F.col("vec_id").alias("query_id"), "snapshot_id", vector.alias("vector")), e.where("snapshot_id < 7").select("snapshot_id", F.col("v").alias("vector")))


AVAILABLE_SQL = """WITH r AS (SELECT vec_id AS query_id, CASE WHEN label >= 7 THEN 'no_vectors' WHEN vec_id % 3 = 2 THEN 'query_not_embedded' WHEN vec_id % 3 = 1 THEN 'dimension_mismatch' END AS reason FROM embeddings)
SELECT query_id, CASE WHEN reason IS NULL THEN 'hybrid' ELSE 'lexical' END AS mode, reason FROM r"""


def embedding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, with outcomes by their number."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("snapshot_id"), F.col("doc_id").alias("chunk_id"))
    n = F.col("chunk_id") % 40
    done = d.where(n > 0).withColumn("outcome", F.when(n == 1, "failed").when(n < 20, "reused").otherwise("stored"))
    return semantic.embedding_status(d, done)


EMBEDDING_STATUS_SQL = """WITH n AS (SELECT source AS snapshot_id, count(*) AS chunks, count(*) FILTER (doc_id % 40 >= 20) AS stored, count(*) FILTER (doc_id % 40 BETWEEN 2 AND 19) AS reused, count(*) FILTER (doc_id % 40 = 1) AS failed FROM documents GROUP BY 1)
SELECT snapshot_id, CASE WHEN stored + reused = chunks THEN 'ready' ELSE 'warning' END AS status, chunks, stored, reused, failed FROM n"""


def retrieval_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as queries with limits of every kind."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.coalesce("text", F.lit("")).alias("query"), F.when(F.col("turn") > 0, F.col("turn") * 30 - 40).alias("limit"))
    return fusion.plan(rows).withColumn("query", F.md5("query"))


PLAN_SQL = r"""WITH q AS (SELECT conv_id || '-' || turn AS query_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS query, least(greatest(CASE WHEN turn > 0 THEN turn * 30 - 40 ELSE 10 END, 1), 50)::INT AS l FROM conversations)
SELECT query_id, md5(query) AS query, l AS "limit", least(200, 4 * l)::INT AS candidates, 'lexical' AS mode FROM q"""


def match_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each question matches: without full stops it asks for four terms together."""
    rows = questions(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 2 == 0, F.replace("query", F.lit("."), F.lit(""))).otherwise(F.col("query")))
    return lexical.match_terms(rows).select("query_id", F.array_join("terms", " ").alias("terms"), "least")


MATCH_SQL = f"""WITH {retrieval._TERMS_CTE.replace("text AS query FROM benchmark", "CASE WHEN item_id % 2 = 0 THEN replace(text, '.', '') ELSE text END AS query FROM benchmark")},
m AS (SELECT *, list_filter(terms, lambda t: length(t) >= 3 AND t NOT IN ({retrieval._WORDS})) AS mean FROM terms),
c AS (SELECT *, NOT regexp_matches(query, '[_/\\\\.]|\\b[a-z]+[A-Z][A-Za-z0-9]*\\b') AND strlen(query) = length(query) AND len(mean) >= 4 AS co FROM m)
SELECT query_id, array_to_string(CASE WHEN co THEN mean[1:8] ELSE terms END, ' ') AS terms, CASE WHEN co THEN 4 ELSE 1 END AS least FROM c"""


def path_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without a path get their file's, and those without a file the repository's name."""
    rows = chunks(spark, sf_dir).select("chunk_id", F.col("chunk_id").alias("file_id"), F.when(F.col("chunk_id") % 3 == 0, "").when(F.col("chunk_id") % 3 == 1, F.col("path")).alias("path"))
    return lexical.backfill_path(rows, chunks(spark, sf_dir).where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("file_id"), "path"))


BACKFILL_SQL = f"SELECT doc_id AS chunk_id, doc_id AS file_id, CASE WHEN doc_id % 3 = 1 OR doc_id % 2 = 0 THEN {retrieval._PATH} ELSE 'repository' END AS path FROM documents"


def search_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_audit(questions(spark, sf_dir), retrieval.bm25_cooccur_topk(spark, sf_dir))


SEARCH_AUDIT_SQL = f"""WITH t AS ({retrieval.QUERY_TERMS_SQL}), r AS ({retrieval.BM25_COOCCUR_SQL})
SELECT t.query_id, t.terms AS normalized, count(r.chunk_id) AS candidates, arg_min(r.chunk_id, r.rank) AS best FROM t LEFT JOIN r USING (query_id) GROUP BY ALL"""

QUERIES = {
    "parameter_pass_rate": parameter_pass_rate, "location_summary": location_summary, "evidence_coverage": evidence_coverage, "tool_audit": tool_audit, "symbol_checks": symbol_checks,
    "result_violations": result_violations, "status_counts": status_counts, "provenance_gaps": provenance_gaps, "before_after": before_after, "trace_shape": trace_shape, "cited_files": cited_files,
    "stage_times": stage_times, "capture_metrics": capture_metrics, "first_relations": first_relations, "provider_violations": provider_violations, "availability": availability,
    "embedding_status": embedding_status, "retrieval_plan": retrieval_plan, "match_terms": match_terms, "path_backfill": path_backfill, "search_audit": search_audit,
}
ORACLES = {
    "parameter_pass_rate": PASS_SQL, "location_summary": LOCATION_SUMMARY_SQL, "evidence_coverage": EVIDENCE_COVERAGE_SQL, "tool_audit": TOOL_AUDIT_SQL, "symbol_checks": CHECKS_SQL,
    "result_violations": RESULT_VIOLATIONS_SQL, "status_counts": STATUS_COUNTS_SQL, "provenance_gaps": PROVENANCE_SQL, "before_after": BEFORE_SQL, "trace_shape": SHAPE_SQL, "cited_files": CITED_SQL,
    "stage_times": STAGES_SQL, "capture_metrics": CAPTURE_SQL, "first_relations": FIRST_SQL, "provider_violations": PROVIDER_SQL, "availability": AVAILABLE_SQL,
    "embedding_status": EMBEDDING_STATUS_SQL, "retrieval_plan": PLAN_SQL, "match_terms": MATCH_SQL, "path_backfill": BACKFILL_SQL, "search_audit": SEARCH_AUDIT_SQL,
}
