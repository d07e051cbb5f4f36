"""Registered queries of snapshot-scoped reads: customers are repositories, their orders snapshots, parts symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..sources import corpus
from ..sources import snapshots as S
from ..sources.corpus import chunks, table
from . import corpus as units
from . import retrieval


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("repo_id"), status.alias("status"), F.col("o_orderdate").cast("date").alias("created_at"), F.col("o_orderpriority").alias("commit")
    )


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = _snapshots(spark, sf_dir).where("status = 'succeeded'").groupBy("repo_id").agg(F.max("snapshot_id").alias("active_snapshot_id"), F.max("created_at").alias("created_at"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("alias")).join(active, "repo_id", "left")


_S = """sn AS (SELECT o_orderkey AS snapshot_id, o_custkey AS repo_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
  o_orderdate::DATE AS created_at, o_orderpriority AS "commit" FROM orders),
ac AS (SELECT repo_id, max(snapshot_id) AS active_snapshot_id, max(created_at) AS created_at FROM sn WHERE status = 'succeeded' GROUP BY 1),
re AS (SELECT c_custkey AS repo_id, c_name AS alias, active_snapshot_id, created_at FROM customer LEFT JOIN ac ON ac.repo_id = c_custkey)"""


def snapshot_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: users ask for a repository, every third for its active snapshot, others for one by number."""
    wanted = F.when(F.col("event_id") % 3 > 0, F.col("event_id"))
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("repo_id"), wanted.alias("snapshot_id"))
    return S.select_snapshot(asked, _repos(spark, sf_dir), _snapshots(spark, sf_dir))


SELECTION_SQL = f"""WITH {_S}, q AS (SELECT event_id AS request_id, user_id AS repo_id, CASE WHEN event_id % 3 > 0 THEN event_id END AS asked FROM events),
j AS (SELECT q.request_id, q.repo_id, re.repo_id AS known, coalesce(asked, active_snapshot_id) AS sid FROM q LEFT JOIN re USING (repo_id)),
e AS (SELECT j.*, CASE WHEN known IS NULL THEN 'repo_not_found' WHEN sid IS NULL THEN 'no_active_snapshot' WHEN sn.status IS NULL THEN 'snapshot_not_found' WHEN sn.status <> 'succeeded' THEN 'snapshot_not_ready' END AS error
  FROM j LEFT JOIN sn ON sn.snapshot_id = sid AND sn.repo_id = j.repo_id)
SELECT request_id, repo_id, CASE WHEN error IS NULL THEN sid END AS snapshot_id, error FROM e"""


def repo_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.repo_list(_repos(spark, sf_dir), _snapshots(spark, sf_dir))


REPOS_SQL = f"WITH {_S} SELECT re.repo_id, alias, re.created_at, active_snapshot_id, sn.status, coalesce(sn.status = 'succeeded', false) AS indexed FROM re LEFT JOIN sn ON sn.snapshot_id = active_snapshot_id"


def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.snapshot_list(_snapshots(spark, sf_dir), 12)


SNAPSHOTS_SQL = f"WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, snapshot_id DESC)::INT AS position FROM sn) SELECT * FROM r WHERE position <= 12"


def snapshots_to_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _snapshots(spark, sf_dir)
    return S.to_build(known.select("repo_id", "commit"), known)


BUILD_SQL = f"""WITH {_S} SELECT DISTINCT repo_id, "commit" FROM sn a WHERE NOT EXISTS (SELECT 1 FROM sn b WHERE b.status = 'succeeded' AND b.repo_id = a.repo_id AND b."commit" = a."commit")"""


def search_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name, brand or type holds a pattern with wildcards, all of them."""
    return S.search_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "a_e", ["p_name", "p_brand", "p_type"], ["p_name", "p_partkey"])


SEARCH_SQL = "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%a_e%' OR p_brand ILIKE '%a_e%' OR p_type ILIKE '%a_e%'"


def point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a label, by id, and how many chunks each source's snapshot has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("snapshot_id"), "lang")
    return S.by_ids(docs, table(spark, sf_dir, "labels"), ["doc_id"]).join(S.chunk_counts(docs), "snapshot_id")


POINT_SQL = """WITH n AS (SELECT source, count(*) AS chunks FROM documents GROUP BY 1)
SELECT doc_id, source AS snapshot_id, lang, chunks FROM documents JOIN n USING (source) WHERE doc_id IN (SELECT doc_id FROM labels)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty-line windows of the documents as units."""
    docs = chunks(spark, sf_dir)
    unit = F.concat_ws(":", F.col("chunk_id").cast("string"), F.col("start_line").cast("string"))
    return chunking.fixed_windows(docs, "chunk_id").select(
        F.lit("s1").alias("snapshot_id"), F.col("chunk_id").alias("file_id"), unit.alias("unit_id"), F.lit("window").alias("kind"), "start_line", "end_line", "content"
    )


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("snapshot_id", F.col("chunk_id").alias("file_id"), "path", "language", F.col("language").isin("en", "fr").alias("indexable"))


def chunk_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the English and French files, with the digest of their content and a stable id."""
    found = S.project_chunks(_units(spark, sf_dir), _files(spark, sf_dir).where("indexable"))
    digest = F.md5("content")
    return found.select(
        "chunk_id", "path", "language", "kind", "start_line", "end_line",
        S.stable_chunk_id(F.lit("r1"), F.col("snapshot_id"), F.col("path"), F.col("start_line"), F.col("end_line"), digest, F.col("kind")).alias("stable_id"),
    )


_U = units.WINDOWS_SQL
_UNITS = f"un AS ({_U}), fi AS (SELECT doc_id AS chunk_id, {retrieval._PATH} AS path, lang AS language FROM documents)"
READ_MODEL_SQL = f"""WITH {_UNITS} SELECT chunk_id || ':' || start_line AS chunk_id, path, language, 'window' AS kind, start_line, end_line,
  left(sha256(concat_ws(chr(0), 'r1', 's1', path, start_line::VARCHAR, end_line::VARCHAR, content_md5, 'window')), 32) AS stable_id FROM un JOIN fi USING (chunk_id) WHERE language IN ('en', 'fr')"""


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its windows, files without a window included."""
    own = _units(spark, sf_dir).join(_files(spark, sf_dir).select("file_id", "path"), "file_id").select("snapshot_id", "path", "start_line", "end_line", F.col("file_id").alias("chunk_id"))
    found = S.snapshot_files(_files(spark, sf_dir), own)
    spans = F.transform("chunks", lambda c: F.concat_ws("-", c["start_line"].cast("string"), c["end_line"].cast("string")))
    return found.select("path", F.array_join(spans, ",").alias("spans"), F.size("chunks").alias("n"))


SNAPSHOT_FILES_SQL = f"""WITH {_UNITS} SELECT path, coalesce(string_agg(start_line || '-' || end_line, ',' ORDER BY start_line), '') AS spans, count(start_line)::INT AS n
FROM fi LEFT JOIN un USING (chunk_id) GROUP BY path"""


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every document as a file: its windows are facts, a bad label an error, a toxic one a warning."""
    labels = table(spark, sf_dir, "labels")
    noted = labels.where("quality = 0 or toxic = 1").select(F.col("doc_id").alias("file_id"), F.when(F.col("quality") == 0, "error").otherwise("warning").alias("severity"))
    return S.status_per_file(_files(spark, sf_dir), _units(spark, sf_dir).where("end_line > 2"), noted)


FILE_STATUS_SQL = f"""WITH {_UNITS}, f AS (SELECT chunk_id, count(*) AS n FROM un WHERE end_line > 2 GROUP BY 1),
g AS (SELECT doc_id AS chunk_id, max((quality = 0)::INT) AS error FROM labels WHERE quality = 0 OR toxic = 1 GROUP BY 1)
SELECT chunk_id AS file_id, CASE WHEN language NOT IN ('en', 'fr') THEN 'skipped' WHEN n IS NOT NULL AND error IS NULL THEN 'parsed' WHEN n IS NOT NULL THEN 'partial' WHEN error = 1 THEN 'failed' ELSE 'missing' END AS status
FROM fi LEFT JOIN f USING (chunk_id) LEFT JOIN g USING (chunk_id)"""


def _relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Large parts as symbols in files by brand, line items as relations between parts."""
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_brand").alias("file_id"), F.col("p_name").alias("name"), "p_size")
    item = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    target = F.when(F.col("l_linenumber") % 4 > 0, F.col("l_suppkey")).cast("string")
    relations = table(spark, sf_dir, "lineitem").select(item.alias("relation_id"), F.lit("calls").alias("kind"), F.col("l_partkey").cast("string").alias("source"), target.alias("target"))
    return symbols, relations


_G = """sy AS (SELECT p_partkey::VARCHAR AS symbol, p_brand AS file_id, p_size FROM part),
rl AS (SELECT l_orderkey || '-' || l_linenumber AS relation_id, 'calls' AS kind, l_partkey::VARCHAR AS source, CASE WHEN l_linenumber % 4 > 0 THEN l_suppkey::VARCHAR END AS target FROM lineitem)"""


def graph_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts of size above ten."""
    symbols, relations = _relations(spark, sf_dir)
    return S.project_graph(symbols.where("p_size > 10"), relations)[1]


PROJECTION_SQL = f"WITH {_G} SELECT * FROM rl WHERE source IN (SELECT symbol FROM sy WHERE p_size > 10) AND target IN (SELECT symbol FROM sy WHERE p_size > 10)"


def replace_file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after one brand's file came with half of its parts and no relation."""
    symbols, relations = _relations(spark, sf_dir)
    own = symbols.select("symbol", "file_id")
    none = spark.createDataFrame([], "unit_id string, file_id string")
    fresh = {"units": none, "symbols": own.where("file_id = 'Brand#13' and symbol % 2 = 0"), "relations": relations.limit(0)}
    out = S.replace_file_facts({"units": none, "symbols": own, "relations": relations}, fresh, own.where("file_id = 'Brand#13'").select("file_id"))
    return out["symbols"].select(F.lit("symbol").alias("fact"), F.col("symbol").alias("id")).unionByName(out["relations"].select(F.lit("relation").alias("fact"), F.col("relation_id").alias("id")))


REPLACE_SQL = f"""WITH {_G}, g AS (SELECT symbol FROM sy WHERE file_id = 'Brand#13')
SELECT 'symbol' AS fact, symbol AS id FROM sy WHERE file_id <> 'Brand#13' OR symbol::BIGINT % 2 = 0
UNION ALL SELECT 'relation', relation_id FROM rl WHERE source NOT IN (SELECT symbol FROM g) AND (target IS NULL OR target NOT IN (SELECT symbol FROM g))"""


def publish_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over customers as files, orders as units and chunks, line items as relations between orders."""
    files = table(spark, sf_dir, "customer").where("c_custkey % 50 > 0").select(F.col("c_custkey").alias("file_id"))
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("file_id"))
    kept = found.where("unit_id % 30 > 0").select(F.col("unit_id").alias("chunk_id"))
    relations = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.when(F.col("l_linenumber") > 1, F.col("l_partkey")).alias("target"))
    return S.integrity(files, found, kept, relations, kept.where("chunk_id % 7 > 0"))


GATES_SQL = """WITH u AS (SELECT o_orderkey AS id, o_custkey AS f FROM orders), c AS (SELECT id FROM u WHERE id % 30 > 0),
g AS (SELECT 'no_files' AS gate, (count(*) = 0)::BIGINT AS n FROM customer WHERE c_custkey % 50 > 0
UNION ALL SELECT 'units_without_file', count(*) FROM u WHERE f NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 > 0)
UNION ALL SELECT 'units_without_chunk', count(*) FROM u WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT 'chunks_without_unit', 0
UNION ALL SELECT 'dangling_source', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM u)
UNION ALL SELECT 'dangling_target', count(*) FROM lineitem WHERE l_linenumber > 1 AND l_partkey NOT IN (SELECT id FROM u)
UNION ALL SELECT 'chunks_without_vector', count(*) FROM c WHERE id % 7 = 0)
SELECT gate, n, n = 0 AS passed FROM g"""


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose quantity range is a range of lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 2).alias("start_line"), (F.col("l_quantity").cast("int") - 10).alias("end_line"))
    return rows.where(S.has_line_range(F.col("start_line"), F.col("end_line")))


RANGES_SQL = """SELECT l_orderkey, l_linenumber, (l_linenumber - 2) AS start_line, (l_quantity::INT - 10) AS end_line FROM lineitem
WHERE l_linenumber - 2 >= 1 AND l_quantity::INT - 10 >= l_linenumber - 2"""


def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as evidence of four kinds, with paths missing in turn."""
    n = F.col("page_id") % 4
    kind = F.element_at(F.array(*map(F.lit, ("exact", "lexical", "structural", "other"))), (n + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("query_id"), F.col("page_id").alias("chunk_id"), F.when(n == 0, F.col("url")).alias("path"), F.when(n == 1, F.col("url")).otherwise(" ").alias("file_path"),
        F.when(n == 2, "sym").alias("symbol"), kind.alias("match_type"), F.col("html").alias("content"),
    )
    return S.display_rows(rows)


DISPLAY_SQL = r"""WITH f AS (SELECT *, page_id % 4 AS n, trim(regexp_replace(coalesce(html, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS s FROM pages)
SELECT page_id AS query_id, page_id AS chunk_id, CASE n WHEN 0 THEN coalesce(url, 'repository') WHEN 1 THEN coalesce(url, 'repository') WHEN 2 THEN 'sym' ELSE 'repository' END AS path,
  CASE n WHEN 0 THEN 'exact match' WHEN 1 THEN 'text match' WHEN 2 THEN 'related in the graph' ELSE 'match' END AS reason,
  CASE WHEN length(s) > 360 THEN rtrim(left(s, 360)) || '...' ELSE s END AS snippet FROM f"""


def output_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers with up to twelve line items; a role only for returned ones."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"))
    rows = items.select(
        F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("rank"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk_id"),
        F.col("l_linestatus").alias("path"), F.lit(1).alias("start_line"), F.col("l_linenumber").cast("int").alias("end_line"), F.lit("").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "returned").alias("role"), F.lit(None).cast("string").alias("relation"),
    )
    found = S.output_records(rows).withColumn("item", F.explode("items"))
    return found.select("query_id", F.get_json_object("item", "$.position").cast("int").alias("position"), F.get_json_object("item", "$.chunk_id").alias("chunk_id"), F.get_json_object("item", "$.about.role").alias("role"), F.get_json_object("item", "$.about.symbol").alias("symbol"))


RECORDS_SQL = """WITH r AS (SELECT l_suppkey AS query_id, l_orderkey || '-' || l_linenumber AS chunk_id, CASE WHEN max(l_returnflag) = 'R' THEN 'returned' END AS role,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_orderkey || '-' || l_linenumber)::INT AS position FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber)
SELECT query_id, position, chunk_id, role, NULL::VARCHAR AS symbol FROM r WHERE position <= 12"""


def stamped_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as facts of their host's file, in the stable order."""
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    facts = table(spark, sf_dir, "pages").select(host.alias("path"), F.col("page_id").alias("fact_id"), F.lit(1).alias("start_line"), F.char_length("url").alias("end_line"), F.lit("page").alias("kind"))
    files = facts.select("path").distinct().select("path", F.md5("path").alias("file_id"))
    return S.sort_facts(S.stamp(facts, "s9", files, "html"))


STAMP_SQL = "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS path, page_id AS fact_id, 1 AS start_line, length(url)::INT AS end_line, 'page' AS kind, 'html' AS parser, 's9' AS snapshot_id, md5(regexp_extract(url, '://([^/?#]*)', 1)) AS file_id FROM pages"


def reports_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve newest orders of every customer as reports, defaults filled in."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").cast("date").alias("created_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("summary")
    )
    return corpus.newest_reports(rows, 12)


REPORTS_SQL = """WITH r AS (SELECT o_custkey AS repo_id, o_orderkey AS report_id, o_orderdate::DATE AS created_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority ELSE 'no summary' END AS summary,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC)::INT AS position FROM orders) SELECT * FROM r WHERE position <= 12"""

QUERIES = {
    "snapshot_selection": snapshot_selection, "repo_list": repo_list, "snapshot_list": snapshot_list, "snapshots_to_build": snapshots_to_build, "search_parts": search_parts,
    "point_reads": point_reads, "chunk_read_model": chunk_read_model, "snapshot_files": snapshot_files, "file_status": file_status, "graph_projection": graph_projection,
    "replace_file_facts": replace_file_facts, "publish_gates": publish_gates, "line_ranges": line_ranges, "display_rows": display_rows, "output_records": output_records,
    "stamped_facts": stamped_facts, "reports_by_repo": reports_by_repo,
}
ORACLES = {
    "snapshot_selection": SELECTION_SQL, "repo_list": REPOS_SQL, "snapshot_list": SNAPSHOTS_SQL, "snapshots_to_build": BUILD_SQL, "search_parts": SEARCH_SQL,
    "point_reads": POINT_SQL, "chunk_read_model": READ_MODEL_SQL, "snapshot_files": SNAPSHOT_FILES_SQL, "file_status": FILE_STATUS_SQL, "graph_projection": PROJECTION_SQL,
    "replace_file_facts": REPLACE_SQL, "publish_gates": GATES_SQL, "line_ranges": RANGES_SQL, "display_rows": DISPLAY_SQL, "output_records": RECORDS_SQL,
    "stamped_facts": STAMP_SQL, "reports_by_repo": REPORTS_SQL,
}
