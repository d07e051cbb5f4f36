"""Registered queries over the corpus: units, maps, findings, routing, sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, corpus_map, findings
from ..sources.corpus import chunks, list_files, table
from ..sources.shared import folder

_LINES = r"string_split_regex(coalesce(text, ''), '\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]')"
_SPLIT = f"CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END"
_LINES_CTE = f"""raw AS (SELECT doc_id AS chunk_id, {_LINES} AS l FROM documents),
li AS (SELECT chunk_id, {_SPLIT} AS l FROM raw),
ln AS (SELECT chunk_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM li)"""
_EST = r"[一-鿿]|[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+(?:\.\p{Nd}+)?|[^\s]"


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", X.estimate_tokens(F.col("content")).alias("tokens"))


TOKEN_SQL = f"SELECT doc_id AS chunk_id, len(regexp_extract_all(coalesce(text, ''), '{_EST}'))::INT AS tokens FROM documents"


def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.fixed_windows(chunks(spark, sf_dir), "chunk_id")
    return found.select("chunk_id", "start_line", "end_line", "n_words", F.md5("content").alias("content_md5"))


WINDOWS_SQL = f"""WITH {_LINES_CTE}, w AS (SELECT chunk_id, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS content
FROM ln GROUP BY chunk_id, (line_no - 1) // 40)
SELECT chunk_id, start_line, end_line, len(regexp_extract_all(content, '\\S+'))::INT AS n_words, md5(content) AS content_md5 FROM w"""


def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.token_chunks(chunks(spark, sf_dir), "chunk_id", 600)


CHUNKS_SQL = f"""WITH RECURSIVE {_LINES_CTE}, s AS (SELECT chunk_id, line_no, len(regexp_extract_all(line, '{_EST}')) AS n FROM ln),
r(chunk_id, line_no, chunk, tokens) AS (
  SELECT chunk_id, line_no, 0, n FROM s WHERE line_no = 1
  UNION ALL SELECT s.chunk_id, s.line_no, CASE WHEN r.tokens + s.n > 600 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.tokens + s.n > 600 THEN s.n ELSE r.tokens + s.n END
  FROM r JOIN s ON s.chunk_id = r.chunk_id AND s.line_no = r.line_no + 1)
SELECT chunk_id, chunk, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line, max_by(tokens, line_no)::INT AS tokens FROM r GROUP BY ALL"""


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with every tenth of its lines made a heading, and every 25th a code fence."""
    rows = chunking.lines(chunks(spark, sf_dir), "chunk_id")
    made = F.when(F.col("line_no") % 25 == 0, "```").when(F.col("line_no") % 10 == 0, F.concat(F.repeat(F.lit("#"), (F.col("line_no") / 10 % 6 + 1).cast("int")), F.lit(" "), F.col("line"))).otherwise(F.col("line"))
    docs = rows.groupBy("chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", made.alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    return chunking.headings(docs, "chunk_id").select("chunk_id", "line_no", "level", "title")


HEADINGS_SQL = f"""WITH {_LINES_CTE}, f AS (SELECT chunk_id, line_no, line, sum(CASE WHEN line_no % 25 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY line_no) AS k FROM ln)
SELECT chunk_id, line_no::INT AS line_no, ((line_no // 10) % 6 + 1)::INT AS level, trim(regexp_replace(line, '\\s+#*\\s*$', '')) AS title
FROM f WHERE line_no % 10 = 0 AND line_no % 25 <> 0 AND k % 2 = 0 AND regexp_matches(line, '^\\s*\\S')"""


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each document when every third line is blank."""
    blank = chunks(spark, sf_dir).withColumn("content", F.array_join(F.transform(X.split_lines(F.col("content")), lambda x, i: F.when(i % 3 == 2, "").otherwise(x)), "\n"))
    return chunking.paragraphs(blank, "chunk_id")


PARAGRAPHS_SQL = f"""WITH {_LINES_CTE}, b AS (SELECT chunk_id, line_no, CASE WHEN line_no % 3 = 0 THEN '' ELSE line END AS line FROM ln),
m AS (SELECT *, trim(line) <> '' AND coalesce(trim(lag(line) OVER w) = '', true) AS first FROM b WINDOW w AS (PARTITION BY chunk_id ORDER BY line_no)),
n AS (SELECT *, sum(first::INT) OVER (PARTITION BY chunk_id ORDER BY line_no) AS paragraph FROM m)
SELECT chunk_id, paragraph::BIGINT AS paragraph, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line, sum(length(line))::BIGINT AS n_chars FROM n WHERE trim(line) <> '' GROUP BY ALL"""


def file_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rebuilt from windows of forty lines that overlap by five."""
    docs = chunks(spark, sf_dir).select("chunk_id", X.split_lines(F.col("content")).alias("l")).where("size(l) > 0")
    starts = docs.select("chunk_id", "l", F.explode(F.sequence(F.lit(1), F.size("l"), F.lit(35))).alias("start_line"))
    cut = starts.select("chunk_id", "start_line", F.array_join(F.slice("l", F.col("start_line"), F.lit(40)), "\n").alias("content"))
    return chunking.rebuild(cut, "chunk_id").select("chunk_id", "n_lines", F.md5("content").alias("content_md5"))


REBUILD_SQL = f"""WITH {_LINES_CTE} SELECT chunk_id, max(line_no)::INT AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS content_md5 FROM ln GROUP BY 1"""


def json_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.json_keys(table(spark, sf_dir, "events"), "event_id", "props")


JSON_SQL = """SELECT event_id, '$.' || k AS json_path, json_extract_string(props, '$."' || k || '"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"""


def source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each normalised URL, and how many share it."""
    keyed = table(spark, sf_dir, "pages").select("page_id", X.normalize_url(F.col("url")).alias("source"))
    return keyed.groupBy("source").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


SOURCE_SQL = r"""SELECT lower(regexp_replace(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', ''), '\.git$', '')) AS source, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1"""


def integrity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references and missing counterparts among documents, labels, orders and line items."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    checks = {
        "labels_without_document": labels.join(docs, "doc_id", "left_anti"),
        "documents_without_label": docs.join(labels, "doc_id", "left_anti"),
        "items_without_order": items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "orders_without_item": orders.join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
    }
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return whole.withColumn("ok", F.col("n") == 0)


INTEGRITY_SQL = """WITH c AS (SELECT 'labels_without_document' AS "check", count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'documents_without_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'items_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders_without_item', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) SELECT *, n = 0 AS ok FROM c"""


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the host's labels and the URL's path are the folders."""
    url = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://", "")
    path = F.regexp_replace(url, "/+$", "")
    return table(spark, sf_dir, "pages").select(F.lit("s1").alias("snapshot_id"), "page_id", path.alias("path"), F.regexp_extract(path, "^[^/]*/([^/]+)/", 1).alias("language"))


_FILES = r"""files AS (SELECT 's1' AS snapshot_id, page_id, path, regexp_extract(path, '^[^/]*/([^/]+)/', 1) AS language FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/+$', '') AS path FROM pages))"""


def corpus_map_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_map.counts(_page_files(spark, sf_dir))


MAP_SQL = f"""WITH {_FILES}, c AS (SELECT *, 'other' AS class, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '/' END AS folder FROM files)
SELECT snapshot_id, 'language' AS facet, language AS value, count(*) AS files FROM c GROUP BY ALL UNION ALL
SELECT snapshot_id, 'class', class, count(*) FROM c GROUP BY ALL UNION ALL SELECT snapshot_id, 'folder', folder, count(*) FROM c GROUP BY ALL"""


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve pages to read first on each host."""
    files = _page_files(spark, sf_dir).withColumn("snapshot_id", F.regexp_extract("path", "^[^/]*", 0))
    return corpus_map.reading_order(files.select("snapshot_id", "path", "language").distinct())


READING_SQL = f"""WITH {_FILES}, d AS (SELECT DISTINCT regexp_extract(path, '^[^/]*') AS snapshot_id, path FROM files),
r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY len(string_split(path, '/')), path)::INT AS position FROM d)
SELECT snapshot_id, position, path FROM r WHERE position <= 12"""


def directory_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_map.directory_cards(_page_files(spark, sf_dir))


CARDS_SQL = f"""WITH {_FILES}, p AS (SELECT *, string_split(path, '/') AS s FROM files),
a AS (SELECT snapshot_id, language, s, unnest(range(1, len(s))) AS k FROM p), e AS (SELECT snapshot_id, array_to_string(s[1:k], '/') AS directory, language, count(*) AS n FROM a GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, directory ORDER BY n DESC, language) AS r FROM e)
SELECT snapshot_id, directory, sum(n)::BIGINT AS files, string_agg(language, ',' ORDER BY r) FILTER (r <= 3) AS languages,
  CASE WHEN contains(directory, '/') THEN regexp_replace(directory, '/[^/]*$', '') END AS parent FROM t GROUP BY snapshot_id, directory"""


def overview_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card per host."""
    return corpus_map.overview(_page_files(spark, sf_dir).withColumn("snapshot_id", F.regexp_extract("path", "^[^/]*", 0)))


OVERVIEW_SQL = f"""WITH {_FILES}, f AS (SELECT regexp_extract(path, '^[^/]*') AS snapshot_id, path, language FROM files),
l AS (SELECT snapshot_id, language, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY n DESC, language) AS k FROM l)
SELECT snapshot_id, sum(n)::BIGINT AS files, 1::BIGINT AS folders, 'entry,tests,config' AS missing, string_agg(language, ',' ORDER BY k) FILTER (k <= 5) AS languages FROM r GROUP BY 1"""


def reading_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of reading each host's pages, which get extensions of every kind."""
    kinds = F.array(*map(F.lit, ("/main.py", "/x.json", "/test_a.py", "/b.ts")))
    p = _page_files(spark, sf_dir).select(F.regexp_extract("path", "^[^/]*", 0).alias("snapshot_id"), F.concat(F.col("path"), F.element_at(kinds, (F.col("page_id") % 4 + 1).cast("int"))).alias("path")).distinct()
    return corpus_map.reading_guide(p.withColumn("language", X.detect_language(F.col("path"))))


GUIDE_SQL = f"""WITH {_FILES}, p AS (SELECT DISTINCT regexp_extract(path, '^[^/]*') AS snapshot_id, path || ['/main.py', '/x.json', '/test_a.py', '/b.ts'][page_id % 4 + 1] AS path FROM files),
g AS (SELECT *, CASE WHEN ends_with(path, '/main.py') THEN 'entry_points' WHEN ends_with(path, '.json') THEN 'configuration' WHEN ends_with(path, '/test_a.py') THEN 'tests' ELSE 'modules' END AS stage FROM p)
SELECT snapshot_id, stage, path, row_number() OVER (PARTITION BY snapshot_id, stage ORDER BY path)::INT AS position FROM g"""


def catalog_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containment tree of regions, nations and customers: node, kind, parent and number of children."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    node = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    rows = (
        region.select(node("r", F.col("r_regionkey")).alias("node"), F.lit("overview").alias("kind"), F.lit(None).cast("string").alias("parent"))
        .unionByName(nation.select(node("n", F.col("n_nationkey")).alias("node"), F.lit("subsystem").alias("kind"), node("r", F.col("n_regionkey")).alias("parent")))
        .unionByName(customer.select(node("c", F.col("c_custkey")).alias("node"), F.lit("file").alias("kind"), node("n", F.col("c_nationkey")).alias("parent")))
    )
    kids = rows.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    return rows.join(kids, "node", "left").select("node", "kind", "parent", F.coalesce("children", F.lit(0)).alias("children"))


PARENTS_SQL = """WITH t AS (SELECT 'r' || r_regionkey AS node, 'overview' AS kind, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'subsystem', 'r' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'file', 'n' || c_nationkey FROM customer), k AS (SELECT parent AS node, count(*) AS children FROM t WHERE parent IS NOT NULL GROUP BY 1)
SELECT node, kind, parent, coalesce(children, 0) AS children FROM t LEFT JOIN k USING (node)"""


def line_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.line_findings(chunks(spark, sf_dir), "chunk_id", findings.SECRET_RULES)


_SECRET = "(?i)(api[_-]?key|secret|token|password)\\s*=\\s*[''\"][^''\"]{8,}[''\"]"
_FOUND = f"""found AS (SELECT chunk_id, line_no::INT AS line_no, 'hard-coded secret' AS rule, 'high' AS severity, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS s FROM ln WHERE regexp_matches(line, '{_SECRET}')
UNION ALL SELECT chunk_id, line_no::INT, 'private key', 'high', trim(regexp_replace(line, '\\s+', ' ', 'g')) FROM ln WHERE regexp_matches(line, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----'))"""
_SNIP = "CASE WHEN length(s) > 240 THEN rtrim(left(s, 240)) || '...' ELSE s END AS snippet"
FINDINGS_SQL = f"WITH {_LINES_CTE}, {_FOUND} SELECT chunk_id, line_no, rule, severity, {_SNIP} FROM found"


def finding_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each source, in file order, up to the line that brings it to three."""
    found = line_rule_findings(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    return findings.cap_findings(found, "source", ["chunk_id", "line_no"], 3).select("source", "chunk_id", "line_no", "rule")


CAP_SQL = f"""WITH {_LINES_CTE}, {_FOUND}, f AS (SELECT found.*, source FROM found JOIN documents ON doc_id = chunk_id),
c AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY chunk_id, line_no) - 1 AS earlier FROM f)
SELECT source, chunk_id, line_no, rule FROM c WHERE earlier < 3"""


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn and its page of the same number as one redacted text, and whether redaction changed it."""
    turns = table(spark, sf_dir, "conversations").join(table(spark, sf_dir, "pages").select(F.col("page_id").alias("conv_id"), "url"), "conv_id", "left")
    whole = F.concat_ws(" ", "text", "url")
    return turns.select("conv_id", "turn", F.md5(X.redact(whole)).alias("redacted_md5"), (X.redact(whole) != whole).alias("changed"))


def redact_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs without user info, fragment, and the parameters named ref or utm_source beside the usual sensitive ones."""
    return table(spark, sf_dir, "pages").select("page_id", X.redact_url(F.col("url"), r"(?i)^(ref|utm_source)$|token|secret|password").alias("url"))


URLS_SQL = r"""WITH b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
p AS (SELECT page_id, regexp_replace(u, '\?.*$', '') AS base, CASE WHEN contains(u, '?') THEN string_split(regexp_extract(u, '\?(.*)$', 1), '&') ELSE [] END AS ps FROM b),
k AS (SELECT page_id, base, array_to_string(list_filter(ps, lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '(?i)^(ref|utm_source)$|token|secret|password')), '&') AS q FROM p)
SELECT page_id, CASE WHEN q <> '' THEN base || '?' || q ELSE base END AS url FROM k"""


def mask_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.mask_secret(F.col("c_name")).alias("masked"))


_MASK = "CASE WHEN {0} = '' THEN NULL WHEN length({0}) <= 4 THEN repeat('•', length({0})) ELSE '••••' || right({0}, 4) END"
MASK_SQL = f"SELECT c_custkey, {_MASK.format('c_name')} AS masked FROM customer"


def route_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent and precise-symbol flag of every turn."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.route_intent(text).alias("intent"), X.has_precise_symbol(text).alias("precise"))


_INTENT = " ".join("WHEN " + " OR ".join(f"contains(lower(t), '{w}')" for w in words) + f" THEN '{name}'" for name, words in X.INTENTS)
ROUTE_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations) SELECT conv_id, turn, CASE {_INTENT} ELSE 'direct_qa' END AS intent,
  len(list_filter(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_.]*'), lambda w: length(w) >= 3 AND regexp_matches(w, '[._]|^.+[A-Z]'))) > 0 AS precise FROM c"""


def trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traces: ordered roles, steps, characters, and the longest step."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.char_length(F.coalesce("text", F.lit(""))).alias("n"))
    steps = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return t.groupBy("conv_id").agg(F.array_join(F.transform(steps, lambda s: s["role"]), ">").alias("roles"), F.count(F.lit(1)).alias("steps"), F.sum("n").alias("chars"), F.max("n").alias("longest"))


TRACE_SQL = """SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles, count(*) AS steps, sum(length(coalesce(text, '')))::BIGINT AS chars, max(length(coalesce(text, '')))::INT AS longest FROM conversations GROUP BY 1"""


def scan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path rules over paths made from page URLs with extensions of every kind."""
    kinds = F.array(*map(F.lit, (".py", ".ts", ".md", ".json", ".bin", "", "_test.py", ".spec.ts")))
    p = _page_files(spark, sf_dir).select("page_id", F.concat(F.col("path"), F.element_at(kinds, (F.col("page_id") % 8 + 1).cast("int"))).alias("path"))
    return p.select("page_id", X.detect_language(F.col("path")).alias("language"), X.is_test_path(F.col("path")).alias("is_test"), X.is_ignored(F.col("path")).alias("ignored"), corpus_map.file_class(F.col("path"), X.detect_language(F.col("path"))).alias("class"))


SCAN_SQL = f"""WITH {_FILES}, p AS (SELECT page_id, path || ['.py', '.ts', '.md', '.json', '.bin', '', '_test.py', '.spec.ts'][page_id % 8 + 1] AS path FROM files),
n AS (SELECT *, lower(string_split(path, '/')[-1]) AS name FROM p), e AS (SELECT *, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS ext FROM n),
g AS (SELECT *, CASE ext WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json' END AS language,
  page_id % 8 IN (6, 7) AS is_test FROM e)
SELECT page_id, language, is_test, false AS ignored, CASE WHEN language = 'markdown' THEN 'docs' WHEN is_test THEN 'tests' WHEN language = 'json' THEN 'config' WHEN language IS NOT NULL THEN 'source' ELSE 'other' END AS class FROM g"""

def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files, a folder for each source and language, and the bytes that a scan lists in each."""
    own = table(spark, sf_dir, "documents")
    name = F.md5(F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))
    root = f"{folder(spark)}/texts-{uuid.uuid4().hex}"
    own.select(F.coalesce("text", F.lit("")).alias("value"), name.alias("folder")).write.partitionBy("folder").text(root)
    found = list_files(spark, root).where("language = 'text'").withColumn("folder", F.regexp_extract("path", "^folder=([^/]*)/", 1))
    return found.groupBy("folder").agg(F.sum("length").alias("bytes"), F.max("is_test").alias("any_test"))


LISTED_SQL = """SELECT md5(coalesce(source, '') || '/' || coalesce(lang, '')) AS folder, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, false AS any_test FROM documents GROUP BY 1"""

QUERIES = {
    "token_estimate": token_estimate, "fixed_windows": fixed_windows, "token_chunks": token_chunks, "headings": headings, "paragraphs": paragraphs,
    "file_rebuild": file_rebuild, "json_key_rows": json_key_rows, "source_dedup": source_dedup, "integrity_gate": integrity_gate, "corpus_map": corpus_map_counts,
    "reading_order": reading_order, "directory_cards": directory_cards, "catalog_parents": catalog_parents, "line_rule_findings": line_rule_findings,
    "finding_cap": finding_cap, "redact_text": redact_text, "redact_urls": redact_urls, "mask_secret": mask_secret, "route_intent": route_intent,
    "trace_steps": trace_steps, "scan_classify": scan_classify, "listed_files": listed_files, "overview_cards": overview_cards, "reading_guide": reading_guide,
}
ORACLES = {
    "token_estimate": TOKEN_SQL, "fixed_windows": WINDOWS_SQL, "token_chunks": CHUNKS_SQL, "headings": HEADINGS_SQL, "paragraphs": PARAGRAPHS_SQL,
    "file_rebuild": REBUILD_SQL, "json_key_rows": JSON_SQL, "source_dedup": SOURCE_SQL, "integrity_gate": INTEGRITY_SQL, "corpus_map": MAP_SQL,
    "reading_order": READING_SQL, "directory_cards": CARDS_SQL, "catalog_parents": PARENTS_SQL, "line_rule_findings": FINDINGS_SQL,
    "finding_cap": CAP_SQL, "redact_urls": URLS_SQL, "mask_secret": MASK_SQL, "route_intent": ROUTE_SQL,
    "trace_steps": TRACE_SQL, "scan_classify": SCAN_SQL, "listed_files": LISTED_SQL, "overview_cards": OVERVIEW_SQL, "reading_guide": GUIDE_SQL,
}
