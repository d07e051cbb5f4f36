"""Registered queries of locating and of keeping tables: terms, phrases, windows, drift, upserts, checks, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import chunking, evaluate, locate, semantic
from ..sources import corpus
from ..sources.shared import dealt
from ..sources.corpus import chunks, questions, table
from . import corpus as units
from . import retrieval

_STOP = ", ".join(f"'{w}'" for w in locate.LOCATION_STOP_WORDS)
_IDENT = r"unnest(string_split(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '_'))"
_WORDS_OF = "unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))"


def location_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", F.array_join(locate.location_terms(F.col("query")), " ").alias("terms"))


LOCATION_TERMS_SQL = f"""WITH w AS (SELECT item_id AS query_id, {_WORDS_OF} AS w FROM benchmark), p AS (SELECT DISTINCT query_id, lower({_IDENT}) AS t FROM w),
k AS (SELECT * FROM p WHERE length(t) >= 3 AND t NOT IN ({_STOP})), x AS (SELECT * FROM k UNION SELECT query_id, 'adapter' FROM k WHERE t = 'handler')
SELECT b.item_id AS query_id, coalesce(string_agg(t, ' ' ORDER BY t), '') AS terms FROM benchmark b LEFT JOIN x ON x.query_id = b.item_id GROUP BY 1"""


def keyphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.keyphrases(questions(spark, sf_dir))


KEYPHRASES_SQL = f"""WITH l AS (SELECT item_id AS query_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS l FROM benchmark),
w AS (SELECT query_id, generate_subscripts(l, 1) AS pos, unnest(l) AS word FROM l),
c AS (SELECT *, pos - row_number() OVER (PARTITION BY query_id ORDER BY pos) AS run FROM w WHERE length(word) >= 3 AND lower(word) NOT IN ({_STOP})),
r AS (SELECT query_id, run, count(*) AS n, min(pos) AS pos, list(word ORDER BY pos) AS ws FROM c GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT query_id, n, pos, ws, unnest(range(1, n)) AS start FROM r), p AS (SELECT query_id, n, pos, start, array_to_string(ws[start:], ' ') AS phrase FROM e),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(phrase) ORDER BY n DESC, pos, start) AS k FROM p),
f AS (SELECT query_id, phrase, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, pos, start)::INT AS position FROM d WHERE k = 1)
SELECT query_id, position, phrase FROM f WHERE position <= 6"""


def location_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in the ten best chunks of each question, at most two of a file and eight of a question."""
    asked = questions(spark, sf_dir).select("query_id", locate.location_terms(F.col("query")).alias("terms"))
    best = retrieval.bm25_or_topk(spark, sf_dir).select("query_id", "chunk_id", "path", F.col("rank").alias("candidate"))
    rows = best.join(asked, "query_id").join(chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id").withColumn("start_line", F.lit(1))
    found = locate.windows(rows).join(best, ["query_id", "chunk_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "candidate", "start_line")
    return locate.drop_overlaps(found.withColumn("rank", F.row_number().over(order)), 8)


def symbol_window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around every line of a document with the token chunks they overlap."""
    docs = chunks(spark, sf_dir)
    w = chunking.lines(docs, "chunk_id").select(F.col("chunk_id").alias("key"), F.greatest(F.col("line_no") - 6, F.lit(1)).alias("start_line"), (F.col("line_no") + 1).alias("end_line"))
    u = chunking.token_chunks(docs, "chunk_id").select(F.col("chunk_id").alias("key"), F.col("chunk").alias("unit"), F.col("start_line").alias("unit_start"), F.col("end_line").alias("unit_end"))
    return locate.enclosing(w, u).select("key", "start_line", "end_line", "unit")


OVERLAP_SQL = units.CHUNKS_SQL.replace("SELECT chunk_id, chunk, min", ", u AS (SELECT chunk_id, chunk, min", 1) + """),
w AS (SELECT chunk_id AS key, greatest(line_no - 6, 1)::INT AS start_line, (line_no + 1)::INT AS end_line FROM ln)
SELECT key, w.start_line, w.end_line, u.chunk AS unit FROM w JOIN u ON u.chunk_id = key AND w.start_line <= u.end_line AND u.start_line <= w.end_line"""


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", X.snippet(F.col("content")).alias("snippet"))


SNIPPETS_SQL = r"""WITH f AS (SELECT doc_id AS chunk_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS s FROM documents)
SELECT chunk_id, CASE WHEN length(s) > 280 THEN rtrim(left(s, 280)) || '...' ELSE s END AS snippet FROM f"""


def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of what would be embedded for each document: path, first word as symbol, the rest of its first line as calls."""
    words = F.regexp_extract_all("content", F.lit("([A-Za-z]+)"))
    symbol, calls, none = F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.slice(words, 2, 7), F.expr("cast(array() as array<string>)")
    made = semantic.embedding_input(F.col("path"), F.lit("word"), symbol, F.lit(""), none, calls, F.col("content"))
    return chunks(spark, sf_dir).select("chunk_id", F.sha2(F.left(made, F.lit(2000)), 256).alias("input_hash"))


EMBEDDING_SQL = f"""WITH c AS (SELECT doc_id AS chunk_id, {retrieval._PATH} AS path, text, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents),
h AS (SELECT chunk_id, text, '[' || path || ']' || CASE WHEN len(w) > 0 THEN ' [word: ' || w[1] || ']' ELSE '' END || CASE WHEN len(w) > 1 THEN ' [calls: ' || array_to_string(w[2:6], ', ') || ']' ELSE '' END AS head FROM c)
SELECT chunk_id, sha256(left(head || chr(10) || text, 2000)) AS input_hash FROM h"""


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of the documents: the second lacks every 7th and has every 10th changed."""
    before = chunks(spark, sf_dir).select("chunk_id", "path", F.sha1("content").alias("content_sha1"))
    after = chunks(spark, sf_dir).where("chunk_id % 7 <> 0").select("path", F.sha1(F.when(F.col("chunk_id") % 10 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("content_sha1"))
    return corpus.drift(before, after)


DRIFT_SQL = f"""WITH c AS (SELECT doc_id, {retrieval._PATH} AS path, text FROM documents)
SELECT path, sha1(text) AS before, CASE WHEN doc_id % 7 <> 0 THEN sha1(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) END AS after FROM c WHERE doc_id % 7 = 0 OR doc_id % 10 = 0"""


def latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports of customers: the late half upserted into the early one by customer and priority."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))
    return corpus.upsert(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderpriority"], "o_orderkey")


LATEST_SQL = "SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey, arg_max(round(o_totalprice, 2), o_orderkey) AS o_totalprice FROM orders GROUP BY ALL"


def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order (snapshots to build) that have no finished one."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey").distinct().join(o.where("o_orderstatus = 'F'").select("o_custkey"), "o_custkey", "left_anti")


INCREMENTAL_SQL = "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"


def parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the state of their label: labelled good, labelled bad, or none."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "parsed").when(F.col("quality") == 0, "failed").otherwise("pending")
    return joined.groupBy("lang", status.alias("status")).agg(F.count(F.lit(1)).alias("files"))


STATUS_SQL = "SELECT lang, CASE quality WHEN 1 THEN 'parsed' WHEN 0 THEN 'failed' ELSE 'pending' END AS status, count(*) AS files FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"


def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question: candidates of either channel, fused rows, both-channel rows."""
    fused = retrieval.rrf_fuse(spark, sf_dir)
    return fused.groupBy("query_id").agg(
        F.count("lexical_score").alias("lexical"), F.count("semantic_score").alias("semantic"), F.count(F.lit(1)).alias("fused"), F.sum((F.col("signals") == "lexical,semantic").cast("int")).alias("in_both")
    )


AUDIT_SQL = retrieval._two_channels(" SELECT query_id, count(lexical_score) AS lexical, count(semantic_score) AS semantic, count(*) AS fused, count(*) FILTER (signals = 'lexical,semantic') AS in_both FROM fused GROUP BY 1")


def capture_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean recall and reciprocal rank with any term against co-occurring terms, and the change."""
    gold = retrieval._gold(spark, sf_dir)

    def means(ranked: DataFrame, name: str) -> DataFrame:
        q = evaluate.rank_quality(ranked.select("query_id", F.col("chunk_id").alias("item"), "rank"), gold)
        one = q.agg(*[F.round(F.avg(m), 9).alias(m) for m in ("recall_5", "recall_10", "reciprocal_rank")])
        return one.selectExpr("stack(3, 'recall_5', recall_5, 'recall_10', recall_10, 'reciprocal_rank', reciprocal_rank) as (metric, v)").withColumnRenamed("v", name)

    any_term, cooccurring = retrieval.bm25_both_topk(spark, sf_dir)
    before, after = means(any_term, "before"), means(cooccurring, "after")
    return before.join(after, "metric").withColumn("change", F.round(F.col("after") - F.col("before"), 6))


def _means_sql(ranked: str) -> str:
    return f"""SELECT round(avg(a), 9) AS recall_5, round(avg(b), 9) AS recall_10, round(avg(c), 9) AS reciprocal_rank FROM (
  SELECT g.query_id, round(count(*) FILTER (k.rank <= 5) / count(*), 9) AS a, round(count(*) FILTER (k.rank <= 10) / count(*), 9) AS b, round(coalesce(1 / min(k.rank), 0), 9) AS c
  FROM gold g LEFT JOIN ({ranked}) k ON k.query_id = g.query_id AND k.chunk_id = g.item GROUP BY 1)"""


COMPARISON_SQL = f"""WITH gold AS (SELECT DISTINCT * FROM ({retrieval._GOLD_SQL})), b AS ({_means_sql(retrieval.BM25_OR_SQL)}), a AS ({_means_sql(retrieval.BM25_COOCCUR_SQL)}),
bb AS (UNPIVOT b ON recall_5, recall_10, reciprocal_rank INTO NAME metric VALUE "before"), aa AS (UNPIVOT a ON recall_5, recall_10, reciprocal_rank INTO NAME metric VALUE "after")
SELECT metric, "before", "after", round("after" - "before", 6) AS change FROM bb JOIN aa USING (metric)"""


def input_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a checked capture may not have: repeated keys, unknown references, values out of range; one row each."""
    e, items = table(spark, sf_dir, "events"), table(spark, sf_dir, "lineitem")
    found = (
        items.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_line").alias("code"), F.col("l_orderkey").alias("id"))
        .unionByName(items.where("l_discount < 0.02").select(F.lit("low_discount").alias("code"), F.col("l_orderkey").alias("id")))
        .unionByName(e.where("value < 0 or value is null").select(F.lit("bad_value").alias("code"), F.col("event_id").alias("id")))
    )
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


VIOLATIONS_SQL = """WITH v AS (SELECT 'duplicate_line' AS code, l_orderkey AS id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'low_discount', l_orderkey FROM lineitem WHERE l_discount < 0.02 UNION ALL SELECT 'bad_value', event_id FROM events WHERE value < 0 OR value IS NULL)
SELECT code, count(*) AS n, min(id) AS first_id FROM v GROUP BY 1"""


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that each page mentions, and its headings."""
    low = F.lower(F.coalesce("html", F.lit("")))
    topics = ("install", "usage", "quickstart", "api", "test")
    named = F.array_join(F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), t) for t in topics]), lambda x: x.isNotNull()), ",")
    return table(spark, sf_dir, "pages").select("page_id", named.alias("topics"), F.size(F.regexp_extract_all(low, F.lit("(<h[1-6])"))).alias("headings"))


_TOPICS = " || ".join(f"CASE WHEN contains(h, '{t}') THEN ',{t}' ELSE '' END" for t in ("install", "usage", "quickstart", "api", "test"))
FINDINGS_SQL = f"WITH p AS (SELECT page_id, lower(coalesce(html, '')) AS h FROM pages) SELECT page_id, substr({_TOPICS}, 2) AS topics, len(regexp_extract_all(h, '<h[1-6]'))::INT AS headings FROM p"


def page_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty of the parts whose name holds a word, by name: offset and limit are the feature."""
    return table(spark, sf_dir, "part").where(F.ilike("p_name", F.lit("%e%"))).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").offset(100).limit(50)


PAGE_SQL = "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%e%' ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100"


def group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: a group (line number parity) is covered if any of its ship dates lies within 30 days of the order date."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("group"), "l_shipdate")
    items = dealt(items, items.count(), "l_orderkey")  # the join and both groupings stay in these tasks
    joined = items.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    hit = F.col("l_shipdate").cast("date").between(F.col("o_orderdate").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), 30))
    groups = joined.groupBy("l_orderkey", "group").agg(F.bool_or(hit).alias("covered"))
    return groups.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("covered").cast("int")).alias("covered"), F.bool_and("covered").alias("passed"))


COVERAGE_SQL = """WITH g AS (SELECT l_orderkey, l_linenumber % 2 AS g, bool_or(l_shipdate::DATE BETWEEN o_orderdate::DATE AND o_orderdate::DATE + 30) AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT l_orderkey, count(*) AS groups, count(*) FILTER (c) AS covered, bool_and(c) AS passed FROM g GROUP BY 1"""

QUERIES = {
    "location_terms": location_terms, "keyphrases": keyphrases, "location_windows": location_windows, "symbol_window_overlap": symbol_window_overlap, "snippets": snippets,
    "embedding_inputs": embedding_inputs, "scan_drift": drift, "latest_reports": latest_reports, "incremental_build": incremental_build, "parse_status": parse_status,
    "run_audit": run_audit, "capture_comparison": capture_comparison, "input_violations": input_violations, "document_findings": document_findings,
    "page_of_nodes": page_of_nodes, "group_coverage": group_coverage,
}
ORACLES = {
    "location_terms": LOCATION_TERMS_SQL, "keyphrases": KEYPHRASES_SQL, "symbol_window_overlap": OVERLAP_SQL, "snippets": SNIPPETS_SQL,
    "embedding_inputs": EMBEDDING_SQL, "scan_drift": DRIFT_SQL, "latest_reports": LATEST_SQL, "incremental_build": INCREMENTAL_SQL, "parse_status": STATUS_SQL,
    "run_audit": AUDIT_SQL, "capture_comparison": COMPARISON_SQL, "input_violations": VIOLATIONS_SQL, "document_findings": FINDINGS_SQL,
    "page_of_nodes": PAGE_SQL, "group_coverage": COVERAGE_SQL,
}
