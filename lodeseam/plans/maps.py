"""Registered queries of maps, catalog cards, findings and reports: pages are files of three snapshots, with names of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus_map, findings
from ..sources import corpus as sources
from ..sources.corpus import chunks, table
from . import corpus as units

_NAMES = ("/main.py", "/x.json", "/test_a.py", "/b.ts", "/README.md")
_LANGS = ("python", "json", "python", "typescript", "markdown")
_KINDS = ("source", "config", "tests", "source", "readme")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, _NAMES))
    path = F.concat(F.col("path"), F.element_at(names, (F.col("page_id") % 5 + 1).cast("int")))
    rows = units._page_files(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("snapshot_id"), path.alias("path")).distinct()
    return rows.select("snapshot_id", "path", X.detect_language(F.col("path")).alias("language"), X.is_test_path(F.col("path")).alias("is_test"))


_pick = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "][page_id % 5 + 1]"
_F = f"""{units._FILES}, f AS (SELECT DISTINCT 's' || page_id % 3 AS snapshot_id, path || {_pick(_NAMES)} AS path, {_pick(_LANGS)} AS language, page_id % 5 = 2 AS is_test, {_pick(_KINDS)} AS class,
  page_id % 5 = 0 AS entry FROM files)"""


def key_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_map.key_files(_files(spark, sf_dir))


_KEYS = """k AS (SELECT snapshot_id, class AS facet, path FROM f WHERE class <> 'source' UNION SELECT snapshot_id, 'entrypoints', path FROM f WHERE entry),
kr AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, facet ORDER BY path)::INT AS position FROM k)"""
KEYS_SQL = f"WITH {_F}, {_KEYS} SELECT snapshot_id, facet, position, path FROM kr WHERE position <= 12"


def top_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_map.top_folders(_files(spark, sf_dir))


FOLDERS_SQL = f"""WITH {_F}, n AS (SELECT snapshot_id, string_split(path, '/')[1] AS folder, count(*) AS files FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY files DESC, folder)::INT AS position FROM n) SELECT snapshot_id, position, folder, files FROM r WHERE position <= 12"""


def overview_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and reading order of each snapshot; the first has no chunks."""
    files = _files(spark, sf_dir)
    held = files.where("snapshot_id <> 's0'").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("chunks"))
    return corpus_map.overview_answer(files, held)


OVERVIEW_ANSWER_SQL = f"""WITH {_F}, {_KEYS}, l AS (SELECT snapshot_id, language, count(*) AS n FROM f GROUP BY ALL),
a AS (SELECT snapshot_id, sum(n)::BIGINT AS files, string_agg(language, ', ' ORDER BY n DESC, language) AS ls FROM l GROUP BY 1),
p AS (SELECT snapshot_id, string_agg(path, ', ' ORDER BY position) FILTER (facet = 'readme' AND position <= 1) AS r, string_agg(path, ', ' ORDER BY position) FILTER (facet = 'entrypoints' AND position <= 3) AS e,
  string_agg(path, ', ' ORDER BY position) FILTER (facet = 'config' AND position <= 3) AS c FROM kr GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY list_position(['readme', 'config', 'source', 'docs', 'tests', 'other'], class), NOT entry, len(string_split(path, '/')), path) AS n FROM f),
q AS (SELECT snapshot_id, string_agg(path, ',' ORDER BY n) FILTER (n <= 12) AS reading_order FROM o GROUP BY 1)
SELECT snapshot_id, files, concat_ws(' ', files || ' files, mostly ' || ls || '.', 'Start with ' || r || '.', 'Entry points: ' || e || '.', 'Configuration: ' || c || '.',
  CASE WHEN snapshot_id = 's0' THEN 'Nothing is indexed yet.' ELSE files || ' chunks are indexed.' END) AS summary, reading_order FROM a LEFT JOIN p USING (snapshot_id) LEFT JOIN q USING (snapshot_id)"""


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol in every TypeScript and Python file, some of them named main, some without a signature."""
    rows = _files(spark, sf_dir).where("language in ('python', 'typescript')")
    n = F.char_length("path") % 3
    name = F.when(n == 0, "main").when(n == 1, "run").otherwise("stop")
    return rows.select("snapshot_id", "path", name.alias("name"), F.concat_ws(".", F.lit("m"), name).alias("qualified"), F.when(n == 2, "").otherwise("def f()").alias("signature"), F.lit("function").alias("kind"), F.concat(F.lit("u"), F.col("path")).alias("unit_id"))


_SYMS = """sy AS (SELECT snapshot_id, path, ['main', 'run', 'stop'][length(path) % 3 + 1] AS name, length(path) % 3 = 2 AS plain FROM f WHERE language IN ('python', 'typescript'))"""


def symbol_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_map.symbol_cards(_symbols(spark, sf_dir))


SYMBOL_CARDS_SQL = f"WITH {_F}, {_SYMS} SELECT snapshot_id, 'symbol' AS kind, 'm.' || name AS title, path, 'function m.' || name || ' in ' || path AS summary, CASE WHEN plain THEN 'no full signature' ELSE '' END AS unknowns FROM sy"


def file_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card per file; evidence is a symbol's unit, and JSON files failed to parse."""
    files = _files(spark, sf_dir).withColumn("parse_status", F.when(F.col("language") == "json", "failed").otherwise("parsed"))
    return corpus_map.file_cards(files, _symbols(spark, sf_dir), _symbols(spark, sf_dir).select("snapshot_id", "path", "unit_id"))


FILE_CARDS_SQL = f"""WITH {_F}, {_SYMS} SELECT f.snapshot_id, 'file' AS kind, f.path AS title, f.path, coalesce(nullif(concat_ws(',', CASE WHEN entry OR coalesce(name = 'main', false) THEN 'entry_point' END, CASE WHEN is_test THEN 'test' END,
  CASE WHEN language = 'json' THEN 'configuration' END), ''), 'module') AS categories, (name IS NOT NULL)::BIGINT AS symbols, (name IS NOT NULL)::BIGINT AS sources,
  concat_ws('; ', CASE WHEN name IS NULL THEN 'no evidence' END, CASE WHEN language = 'json' THEN 'parse status failed' END) AS unknowns FROM f LEFT JOIN sy ON sy.snapshot_id = f.snapshot_id AND sy.path = f.path"""


def subsystem_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_map.subsystem_cards(_files(spark, sf_dir), _symbols(spark, sf_dir).select("snapshot_id", "path", "unit_id"))


SUBSYSTEM_SQL = f"""WITH {_F}, {_SYMS}, n AS (SELECT snapshot_id, string_split(path, '/')[1] AS t, count(DISTINCT path) AS files FROM f GROUP BY ALL), s AS (SELECT snapshot_id, string_split(path, '/')[1] AS t, count(DISTINCT path) AS k FROM sy GROUP BY ALL)
SELECT snapshot_id, 'subsystem' AS kind, t || ' subsystem' AS title, t AS path, files, coalesce(k, 0) AS sources, CASE WHEN k IS NULL THEN 'role unknown' ELSE '' END AS unknowns FROM n LEFT JOIN s USING (snapshot_id, t)"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    folder = corpus_map.directory_cards(files).select("snapshot_id", F.lit("directory").alias("kind"), F.col("directory").alias("identity"), F.col("directory").alias("path"))
    own = files.select("snapshot_id", F.lit("file").alias("kind"), F.col("path").alias("identity"), "path")
    top = files.select("snapshot_id", F.lit("subsystem").alias("kind"), F.regexp_extract("path", "^([^/]*)", 1).alias("identity"), F.regexp_extract("path", "^([^/]*)", 1).alias("path")).distinct()
    overview = files.select("snapshot_id", F.lit("overview").alias("kind"), F.lit("").alias("identity"), F.lit("").alias("path")).distinct()
    symbol = _symbols(spark, sf_dir).select("snapshot_id", F.lit("symbol").alias("kind"), F.concat_ws("#", "path", "name").alias("identity"), "path")
    return corpus_map.parents(folder.unionByName(own).unionByName(top).unionByName(overview).unionByName(symbol))


_CARDS = f"""{_F}, {_SYMS}, d AS (SELECT DISTINCT snapshot_id, array_to_string(s[1:k], '/') AS path FROM (SELECT snapshot_id, s, unnest(range(1, len(s))) AS k FROM (SELECT snapshot_id, string_split(path, '/') AS s FROM f))),
c AS (SELECT snapshot_id, 'directory' AS kind, path AS identity, path, 'subsystem' AS pk, string_split(path, '/')[1] AS pi FROM d
  UNION ALL SELECT snapshot_id, 'file', path, path, 'directory', regexp_replace(path, '/?[^/]*$', '') FROM f UNION ALL SELECT DISTINCT snapshot_id, 'subsystem', string_split(path, '/')[1], string_split(path, '/')[1], 'overview', '' FROM f
  UNION ALL SELECT DISTINCT snapshot_id, 'overview', '', '', NULL, NULL FROM f UNION ALL SELECT snapshot_id, 'symbol', path || '#' || name, path, 'file', path FROM sy),
cc AS (SELECT snapshot_id, kind, identity, path, 'catalog_' || kind || '_' || left(sha256(concat_ws(chr(0), snapshot_id, kind, identity)), 24) AS card_id,
  CASE WHEN pk IS NOT NULL THEN 'catalog_' || pk || '_' || left(sha256(concat_ws(chr(0), snapshot_id, pk, pi)), 24) END AS parent_id FROM c)"""


def catalog_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cards(spark, sf_dir)


CATALOG_SQL = f"WITH {_CARDS} SELECT * FROM cc"


def catalog_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every card below its root; the second snapshot has lost its overview, so its subsystems are roots."""
    cards = _cards(spark, sf_dir).where("not (snapshot_id = 's1' and kind = 'overview')")
    return corpus_map.tree(cards).groupBy("root_id", "level").agg(F.count(F.lit(1)).alias("cards"), F.min("path_ids").alias("first"))


TREE_SQL = f"""WITH RECURSIVE {_CARDS}, ck AS (SELECT * FROM cc WHERE NOT (snapshot_id = 's1' AND kind = 'overview')),
t AS (SELECT card_id, card_id AS root_id, 0 AS level, card_id AS path_ids FROM ck WHERE parent_id IS NULL OR parent_id NOT IN (SELECT card_id FROM ck)
  UNION ALL SELECT ck.card_id, root_id, level + 1, path_ids || '/' || ck.card_id FROM t JOIN ck ON ck.parent_id = t.card_id)
SELECT root_id, level, count(*) AS cards, min(path_ids) AS first FROM t GROUP BY ALL"""


def navigation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the subsystem and overview cards."""
    top = F.regexp_extract("path", "^([^/]*)", 1)
    evidence = _symbols(spark, sf_dir).select("snapshot_id", top.alias("identity"), "unit_id")
    both = evidence.unionByName(evidence.withColumn("identity", F.lit("")))
    held = corpus_map.source_ids(both, "snapshot_id", "identity")
    cards = _cards(spark, sf_dir).where("kind in ('overview', 'subsystem')").join(held, ["snapshot_id", "identity"])
    return corpus_map.navigation_rows(cards)


NAVIGATION_SQL = f"""WITH {_CARDS}, e AS (SELECT snapshot_id, string_split(path, '/')[1] AS identity, 'u' || path AS unit_id FROM sy UNION ALL SELECT snapshot_id, '', 'u' || path FROM sy),
h AS (SELECT snapshot_id, identity, list(DISTINCT unit_id ORDER BY unit_id) AS ids FROM e GROUP BY ALL),
r AS (SELECT cc.snapshot_id, card_id, ids, row_number() OVER (PARTITION BY cc.snapshot_id ORDER BY kind, card_id) AS n FROM cc JOIN h ON h.snapshot_id = cc.snapshot_id AND h.identity = cc.identity WHERE kind IN ('overview', 'subsystem'))
SELECT snapshot_id, card_id, unnest(ids[1:4]) AS unit_id FROM r WHERE n <= 12"""


_CODE_LINES = ("y = Eval(x)", "subprocess.run(c, shell=True)", "PASSWORD = read()", "yaml.load(f); pickle.loads(b)", "evaluated")


def security_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, documents, and documents with a line of code below, that hold a term of any group."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), F.col("html").alias("content"))
    docs = chunks(spark, sf_dir).select(F.concat(F.lit("d"), F.col("chunk_id").cast("string")).alias("key"), "content")
    line = F.element_at(F.array(*map(F.lit, _CODE_LINES)), (F.col("chunk_id") % 5 + 1).cast("int"))
    code = chunks(spark, sf_dir).select(F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("key"), F.concat_ws("\n", "content", line).alias("content"))
    return findings.security_review(pages.unionByName(docs).unionByName(code), "key").select("key", F.array_join("rules", ",").alias("rules"))


_RULES = ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{x}{chr(39)})' for x in terms)} THEN '{title}' END" for title, terms in findings.SECURITY_TERMS.items())
SECURITY_SQL = f"""WITH u AS (SELECT 'p' || page_id AS key, lower(coalesce(html, '')) AS t FROM pages UNION ALL SELECT 'd' || doc_id, lower(coalesce(text, '')) FROM documents
  UNION ALL SELECT 'c' || doc_id, lower(concat_ws(chr(10), text, {list(_CODE_LINES)}[doc_id % 5 + 1])) FROM documents),
r AS (SELECT key, concat_ws(',', {_RULES}) AS rules FROM u) SELECT * FROM r WHERE rules <> ''"""


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and topics of pages and documents, headings by their first eight."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), F.regexp_replace("html", "<h[1-3]>", "\n# ").alias("content"))
    docs = chunks(spark, sf_dir).select(F.concat(F.lit("d"), F.col("chunk_id").cast("string")).alias("key"), "content")
    return findings.document_findings(pages.unionByName(docs), "key").select("key", F.array_join("headings", "|").alias("headings"), F.array_join("topics", ",").alias("topics"))


_TOPICS = ", ".join(f"CASE WHEN contains(lower(c), '{t}') THEN '{t}' END" for t in findings.TOPICS)
_SPLIT = "string_split(regexp_replace(regexp_replace(c, '\\r\\n|[\\n\\x0B\\f\\r\\x1C-\\x1E\\x85\\x{2028}\\x{2029}]', chr(10), 'g'), '\\n$', ''), chr(10))"
DOCUMENT_SQL = f"""WITH u AS (SELECT 'p' || page_id AS key, regexp_replace(coalesce(html, ''), '<h[1-3]>', chr(10) || '# ', 'g') AS c FROM pages UNION ALL SELECT 'd' || doc_id, coalesce(text, '') FROM documents)
SELECT key, array_to_string(list_transform(list_filter({_SPLIT}, lambda x: starts_with(ltrim(x), '#')), lambda x: regexp_replace(x, '^[# ]+|[# ]+$', '', 'g'))[1:8], '|') AS headings, concat_ws(',', {_TOPICS}) AS topics FROM u"""


def config_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' files: package.json of their number, requirements of their documents' lines, containers and broken JSON."""
    n = F.col("c_custkey") % 4
    name = F.when(n == 0, "package.json").when(n == 1, "requirements.txt").when(n == 2, "Dockerfile").otherwise("package.json")
    good = F.concat(F.lit('{"scripts": {"a": "x", "b": "y"}, "dependencies": {"d'), F.col("c_custkey").cast("string"), F.lit('": "1"}}'))
    content = F.when(n == 0, good).when(n == 1, F.concat(F.lit("# c\n\n"), F.col("c_name"), F.lit("\nx==1\n"))).when(n == 2, "FROM x").otherwise("{broken")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("app/"), name).alias("path"), content.alias("content"))
    return findings.config_findings(rows, "c_custkey").withColumn("scripts", F.array_join("scripts", ","))


CONFIG_SQL = """SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'python' WHEN 2 THEN 'container' ELSE 'node' END AS kind, CASE WHEN c_custkey % 4 = 0 THEN 'a,b' END AS scripts,
  CASE WHEN c_custkey % 4 = 0 THEN 1 END AS dependencies, CASE WHEN c_custkey % 4 = 0 THEN 0 END AS dev_dependencies, CASE WHEN c_custkey % 4 = 1 THEN 2 END AS lines FROM customer"""


def normalized_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as flattened configuration units."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), F.when(F.col("l_linenumber") == 1, "object").otherwise("value").alias("kind"), F.concat(F.lit("k"), (F.col("l_partkey") % 50).cast("string")).alias("name")
    )
    return findings.normalized_config(rows, "l_orderkey").withColumn("keys", F.array_join("keys", ","))


NORMALIZED_SQL = """WITH u AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS o, l_linenumber, 'k' || l_partkey % 50 AS name FROM lineitem),
n AS (SELECT l_orderkey, name, min(o) AS o FROM u GROUP BY ALL), k AS (SELECT l_orderkey, list(name ORDER BY o, name)[1:8] AS ks FROM n GROUP BY 1)
SELECT l_orderkey, count(*) FILTER (l_linenumber = 1) AS objects, count(*) FILTER (l_linenumber > 1) AS "values", array_to_string(any_value(ks), ',') AS keys FROM u JOIN k USING (l_orderkey) GROUP BY 1"""


def architecture_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return findings.architecture_findings(files, corpus_map.key_files(files))


ARCHITECTURE_SQL = f"""WITH {_F}, {_KEYS} SELECT snapshot_id, 'structure' AS title, count(*) || ' files: ' || string_agg(DISTINCT language, ', ' ORDER BY language) AS detail FROM f GROUP BY 1
UNION ALL SELECT snapshot_id, 'entry points', string_agg(path, ', ' ORDER BY position) FROM kr WHERE facet = 'entrypoints' AND position <= 8 GROUP BY 1"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings of a customer's report."""
    section = F.element_at(F.array(*map(F.lit, ("security", "architecture", "other", "documents", "configuration"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    severity = F.element_at(F.array(*map(F.lit, ("info", "medium", "high"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("report_id"), section.alias("section"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("t"), (F.col("o_orderkey") % 11).cast("string")).alias("title"), severity.alias("severity")
    )


_FOUND = """fd AS (SELECT o_custkey AS report_id, ['security', 'architecture', 'other', 'documents', 'configuration'][o_orderkey % 5 + 1] AS section, o_orderkey AS o, 't' || o_orderkey % 11 AS title,
  ['info', 'medium', 'high'][o_orderkey % 3 + 1] AS severity, [4, 1, 99, 2, 3][o_orderkey % 5 + 1] AS s FROM orders),
nb AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY s, section, o) AS n FROM fd)"""


def section_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.section_guide(_found(spark, sf_dir)).withColumn("reading", F.array_join("reading", ",")).withColumn("needs_review", F.array_join("needs_review", ","))


_GUIDE = """gd AS (SELECT report_id, section, s, count(*) AS findings, array_to_string(list(title ORDER BY n)[1:5], ',') AS reading, coalesce(string_agg(title, ',' ORDER BY n) FILTER (severity <> 'info'), '') AS needs_review FROM nb GROUP BY ALL),
gp AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY s, section)::INT AS position FROM gd)"""
GUIDE_SQL = f"WITH {_FOUND}, {_GUIDE} SELECT report_id, position, section, findings, reading, needs_review FROM gp"


def chief_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.chief_summary(_found(spark, sf_dir)).withColumn("reading", F.array_join("reading", ",")).withColumn("risks", F.array_join("risks", ","))


_CHIEF = """su AS (SELECT report_id, string_agg(section || ': ' || findings || ' findings', ', ' ORDER BY s, section) AS summary FROM gd GROUP BY 1),
rd AS (SELECT report_id, array_to_string(list(title ORDER BY n)[1:8], ',') AS reading FROM (SELECT report_id, title, min(n) AS n FROM nb GROUP BY ALL) GROUP BY 1),
rk AS (SELECT report_id, coalesce(list('[' || severity || '] ' || title ORDER BY n) FILTER (severity <> 'info'), [])[1:10] AS rs FROM nb GROUP BY 1)"""
CHIEF_SQL = f"WITH {_FOUND}, {_GUIDE}, {_CHIEF} SELECT report_id, summary, reading, array_to_string(rs, ',') AS risks FROM su JOIN rd USING (report_id) JOIN rk USING (report_id)"


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's report as Markdown; names that are paths are not shown."""
    alias = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("/home/"), F.col("c_name"))).otherwise(F.col("c_name"))
    return sources.markdown(findings.report_sections(_found(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("report_id"), alias.alias("alias"))))


MARKDOWN_SQL = f"""WITH {_FOUND}, {_GUIDE}, {_CHIEF}, se AS (SELECT report_id, 0 AS position, '## Summary' || chr(10) || chr(10) || array_to_string(list_transform(list_concat(['repository: ' ||
  CASE WHEN c_name IS NULL OR c_custkey % 3 = 0 THEN 'local-repository' ELSE c_name END, summary], rs), lambda x: '- ' || x), chr(10)) AS b FROM su JOIN rk USING (report_id) LEFT JOIN customer ON c_custkey = report_id
  UNION ALL SELECT report_id, position, '## ' || upper(left(section, 1)) || substr(section, 2) || chr(10) || chr(10) || '- ' || replace(reading, ',', chr(10) || '- ') FROM gp)
SELECT report_id, string_agg(b, chr(10) || chr(10) ORDER BY position) AS markdown FROM se GROUP BY 1"""


def trace_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traces of at most three steps of 80 characters, with the words of a turn as its references; all steps, redacted."""
    refs = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    steps = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("step"), "role", "text", refs.alias("refs"))
    found = findings.export_traces(steps, most_steps=3, width=80, refs_each=5, refs_all=12)
    texts = F.array_join(F.transform("steps", lambda s: F.concat_ws(" ", s["role"], F.size(s["refs"]).cast("string"), s["text"])), "\n")
    return found.select("trace_id", texts.alias("steps"), "dropped_steps", "cut_texts", "dropped_refs")


EXPORT_SQL = """WITH n AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''))::INT AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT *, CASE WHEN n <= 3 THEN least(words, 5) ELSE 0 END AS got FROM n),
k AS (SELECT *, least(got, greatest(12 - coalesce(sum(got) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0))::INT AS own FROM r)
SELECT conv_id AS trace_id, string_agg(role || ' ' || own || ' ' || left(text, 80), chr(10) ORDER BY turn) FILTER (n <= 3) AS steps, count(*) FILTER (n > 3) AS dropped_steps, count(*) FILTER (n <= 3 AND length(text) > 80) AS cut_texts,
  sum(words - CASE WHEN n <= 3 THEN own ELSE 0 END)::INT AS dropped_refs FROM k GROUP BY 1"""


def redact_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records with fields that may not leave."""
    pairs = [F.lit("name"), F.col("c_name"), F.lit("api_key"), F.col("c_mktsegment"), F.lit("note"), F.concat(F.lit("token="), F.col("c_name")), F.lit("userPassword"), F.lit("x")]
    clean = findings.redact_fields(F.create_map(*pairs))
    return table(spark, sf_dir, "customer").select("c_custkey", *[clean[k].alias(k) for k in ("name", "api_key", "note", "userPassword")])


FIELDS_SQL = "SELECT c_custkey, c_name AS name, '[redacted]' AS api_key, 'token=[redacted]' AS note, '[redacted]' AS \"userPassword\" FROM customer"


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every kind that redaction knows, around the data of customers and pages."""
    forms = F.array(
        F.concat(F.lit("see https://user:pw@"), F.col("host"), F.lit("/a?b=1&sig="), F.col("word"), F.lit("&c=2#frag end")),
        F.concat(F.lit("Authorization: Digest "), F.col("word")),
        F.concat(F.lit("authorization: Bearer "), F.col("word"), F.lit(", then")),
        F.concat(F.lit("api_key = "), F.col("word"), F.lit(" ok")),
        F.concat(F.lit("open /home/"), F.col("word"), F.lit(", done")),
        F.concat(F.lit("https://"), F.col("host"), F.lit("/x?token="), F.col("word")),
        F.concat(F.lit("https://"), F.col("host"), F.lit("/x?a=1&auth="), F.col("word"), F.lit(" next")),
        F.concat(F.lit("plain "), F.col("word")),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("word"))
    text = F.element_at(forms, (F.col("page_id") % 8 + 1).cast("int"))
    return rows.select("page_id", X.redact(text).alias("redacted"), (X.redact(text) != text).alias("changed"))


REDACT_SQL = """WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, 'w' || page_id AS w FROM pages)
SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'see https://[redacted]@' || host || '/a?b=1&c=2 end' WHEN 1 THEN 'Authorization: [redacted]' WHEN 2 THEN 'authorization: Bearer [redacted], then' WHEN 3 THEN 'api_key = [redacted] ok'
  WHEN 4 THEN 'open [local path], done' WHEN 5 THEN 'https://' || host || '/x' WHEN 6 THEN 'https://' || host || '/x?a=1 next' ELSE 'plain ' || w END AS redacted, page_id % 8 < 7 AS changed FROM p"""


def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and pages quoted with a local path and an address, that redaction would change."""
    docs = findings.leaks(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    quoted = F.concat(F.when(F.col("page_id") % 3 == 0, "saved in /home/").otherwise("seen at "), F.coalesce("url", F.lit("")), F.when(F.col("page_id") % 5 == 0, "?sig=1").otherwise(""))
    pages = findings.leaks(table(spark, sf_dir, "pages").select("page_id", quoted.alias("text")), "page_id", "text")
    return docs.unionByName(pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id")))


_KEYED = "(api[_-]?key|access[_-]?token|refresh[_-]?token|token|password|passwd|secret|credential)\\s*[:=]\\s*[^\\s,;\"''`<>]+"
_LOCAL = "([\"''`])([A-Za-z]:[\\\\/]|\\\\\\\\|/[^/])[^\\r\\n\"''`<>]*[\"''`]|(^|[\\s(\"''`=:])([A-Za-z]:[\\\\/]|\\\\\\\\[^\\r\\n,;\"''`<>]|/[^/\\r\\n,;\"''`<>])"
LEAK_SQL = f"""WITH d AS (SELECT 'document' AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL
  SELECT 'page', page_id, CASE WHEN page_id % 3 = 0 THEN 'saved in /home/' ELSE 'seen at ' END || coalesce(url, '') || CASE WHEN page_id % 5 = 0 THEN '?sig=1' ELSE '' END FROM pages)
SELECT kind, id FROM d WHERE regexp_matches(t, '(?i){_KEYED}') OR regexp_matches(t, '(?i)authorization\\s*[:=]\\s*[^\\r\\n,;\"''`<>]+') OR regexp_matches(t, '(?im){_LOCAL}')
  OR regexp_matches(t, '(?i)https?://[^\\s\"''`<>#]+#') OR regexp_matches(t, '(?i)https?://[^\\s/\"''`<>@]+@')
  OR regexp_matches(t, '(?i)[?&](api[_-]?key|access[_-]?token|refresh[_-]?token|token|auth(orization)?|password|passwd|secret|credential|signature|sig)=') OR regexp_matches(t, '(?i)https?://[^\\s\"''`<>?#]+[?]([\\s\"''`<>]|$)')
  OR regexp_matches(t, '(?i)https?://[^\\s\"''`<>#]+&([\\s\"''`<>]|$)')"""


def evidence_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence by their first 200 characters, every third one not exact: the length is the feature."""
    rows = chunks(spark, sf_dir).withColumn("exact", F.col("chunk_id") % 3 > 0)
    return findings.evidence_stub(rows, "sample", 200).select("path", "start_line", "end_line", F.md5("sample").alias("sample"))


STUB_SQL = f"""WITH d AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, left(coalesce(text, ''), 200) AS c FROM documents)
SELECT path, CASE WHEN doc_id % 3 > 0 THEN 1 END AS start_line, CASE WHEN doc_id % 3 > 0 THEN greatest(len({_SPLIT}), 1)::INT END AS end_line, md5(c) AS sample FROM d"""

QUERIES = {
    "key_files": key_files, "top_folders": top_folders, "overview_answer": overview_answer, "symbol_cards": symbol_cards, "file_cards": file_cards, "subsystem_cards": subsystem_cards,
    "catalog_cards": catalog_cards, "catalog_tree": catalog_tree, "navigation_rows": navigation_rows, "security_review": security_review, "document_topics": document_findings,
    "config_file_findings": config_findings, "normalized_config": normalized_config, "architecture_findings": architecture_findings, "section_guide": section_guide, "chief_summary": chief_summary,
    "report_markdown": report_markdown, "trace_export": trace_export, "redact_fields": redact_fields, "redact_forms": redact_text, "leak_check": leak_check, "evidence_stubs": evidence_stubs,
}
ORACLES = {
    "key_files": KEYS_SQL, "top_folders": FOLDERS_SQL, "overview_answer": OVERVIEW_ANSWER_SQL, "symbol_cards": SYMBOL_CARDS_SQL, "file_cards": FILE_CARDS_SQL, "subsystem_cards": SUBSYSTEM_SQL,
    "catalog_cards": CATALOG_SQL, "catalog_tree": TREE_SQL, "navigation_rows": NAVIGATION_SQL, "security_review": SECURITY_SQL, "document_topics": DOCUMENT_SQL,
    "config_file_findings": CONFIG_SQL, "normalized_config": NORMALIZED_SQL, "architecture_findings": ARCHITECTURE_SQL, "section_guide": GUIDE_SQL, "chief_summary": CHIEF_SQL,
    "report_markdown": MARKDOWN_SQL, "trace_export": EXPORT_SQL, "redact_fields": FIELDS_SQL, "redact_forms": REDACT_SQL, "leak_check": LEAK_SQL, "evidence_stubs": STUB_SQL,
}
