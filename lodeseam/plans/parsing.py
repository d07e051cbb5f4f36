"""Registered queries of parsing: customers are files of four kinds, one of them broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, findings
from ..sources.corpus import chunks, table
from .corpus import _EST, _LINES_CTE

_CODE = "import os\n\n\n@cached\ndef f{n}(a, b=1) -> int:\n    return os.getcwd()\n\n\nclass C{n}(Base):\n    async def m(self):\n        self.k()\n        return f{n}(1)\n"
_JSON = '{"b": [1, {"x": "y"}], "a": {n}}'
_MD = "# T{n}\ntext\n## U\n```\n# no\n```\n## U\n"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey").cast("string")
    kind = F.col("c_custkey") % 5
    pick = lambda *values: F.element_at(F.array(*values), (kind + 1).cast("int"))
    content = F.replace(pick(*map(F.lit, (_CODE, "def (", _JSON, _MD, "plain\nlines\n"))), F.lit("{n}"), n)
    path = F.concat(F.lit("d/c"), n, pick(*map(F.lit, (".py", ".py", ".json", ".md", ".txt"))))
    language = pick(*map(F.lit, ("python", "python", "json", "markdown", "text")))
    return table(spark, sf_dir, "customer").select(F.lit("s1").alias("snapshot_id"), path.alias("path"), language.alias("language"), content.alias("content"))


def parse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file's parser finds, the fallback's row for files that give nothing."""
    return chunking.parse(_docs(spark, sf_dir))


_P = "n AS (SELECT c_custkey AS k, c_custkey % 5 AS d FROM customer)"
_ROWS = """('python', 'symbol', 'module', 'd.c' || k, 1, 12, 0), ('python', 'symbol', 'function', 'd.c' || k || '.f' || k, 5, 6, 0), ('python', 'symbol', 'class', 'd.c' || k || '.C' || k, 9, 12, 0), ('python', 'symbol', 'method', 'd.c' || k || '.C' || k || '.m', 10, 12, 0),
  ('python', 'diagnostic', 'syntax_error', 'd.c' || k, 1, 1, 1), ('fallback', 'unit', 'file', 'd/c' || k || '.py', 1, 1, 1),
  ('config', 'unit', 'object', '$', 1, 1, 2), ('config', 'unit', 'value', '$.a', 1, 1, 2), ('config', 'unit', 'object', '$.b', 1, 1, 2), ('config', 'unit', 'value', '$.b[0]', 1, 1, 2), ('config', 'unit', 'object', '$.b[1]', 1, 1, 2), ('config', 'unit', 'value', '$.b[1].x', 1, 1, 2),
  ('markdown', 'unit', 'section', 'T' || k, 1, 1, 3), ('markdown', 'unit', 'section', 'T' || k || '/U', 3, 3, 3), ('markdown', 'unit', 'section', 'T' || k || '/U[2]', 7, 7, 3), ('fallback', 'unit', 'file', 'd/c' || k || '.txt', 1, 2, 4)"""
PARSE_SQL = f"""WITH {_P} SELECT 's1' AS snapshot_id, 'd/c' || k || ['.py', '.py', '.json', '.md', '.txt'][d + 1] AS path, parser, fact, kind, name, a AS start_line, b AS end_line
FROM n, LATERAL (VALUES {_ROWS}) AS v(parser, fact, kind, name, a, b, g) WHERE g = d"""


def python_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations and signatures of the Python files."""
    facts = chunking.python_symbols(_docs(spark, sf_dir).where("language = 'python'"))
    return facts.where("signature is not null or fact = 'relation'").select("path", "kind", "name", "target", "start_line", "is_async", "signature", "decorators", "confidence")


FACTS_SQL = f"""WITH {_P}, p AS (SELECT k, 'd/c' || k || '.py' AS path, 'd.c' || k AS m FROM n WHERE d = 0)
SELECT path, kind, name, target, l AS start_line, asy AS is_async, sig AS signature, dec AS decorators, conf::DOUBLE AS confidence FROM p, LATERAL (VALUES
  ('imports', m, 'os', 1, false, NULL, NULL, 1.0), ('function', m || '.f' || k, NULL, 5, false, 'def f' || k || '(a, b=1) -> int', 'cached', NULL), ('contains', m, m || '.f' || k, 5, false, NULL, NULL, 1.0), ('calls', m || '.f' || k, 'os.getcwd', 6, false, NULL, NULL, 0.95),
  ('class', m || '.C' || k, NULL, 9, false, 'class C' || k, '', NULL), ('contains', m, m || '.C' || k, 9, false, NULL, NULL, 1.0), ('inherits', m || '.C' || k, 'Base', 9, false, NULL, NULL, 1.0),
  ('method', m || '.C' || k || '.m', NULL, 10, true, 'def m(self)', '', NULL), ('contains', m || '.C' || k, m || '.C' || k || '.m', 10, false, NULL, NULL, 1.0), ('calls', m || '.C' || k || '.m', m || '.C' || k || '.k', 11, false, NULL, NULL, 0.95),
  ('calls', m || '.C' || k || '.m', m || '.f' || k, 12, false, NULL, NULL, 1.0)) AS v(kind, name, target, l, asy, sig, dec, conf)"""


def structure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, functions and imports of the Python files, and which failed to parse."""
    docs = _docs(spark, sf_dir).where("language = 'python'")
    found = findings.structure_findings(chunking.python_symbols(docs), docs)
    return found.withColumn("classes", F.array_join("classes", ",")).withColumn("functions", F.array_join("functions", ","))


STRUCTURE_FINDINGS_SQL = f"""WITH {_P} SELECT 'd/c' || k || '.py' AS path, CASE WHEN d = 0 THEN 'C' || k ELSE '' END AS classes, CASE WHEN d = 0 THEN 'f' || k ELSE '' END AS functions, (d = 0)::BIGINT AS imports, d = 1 AS parse_failed, false AS main_guard
FROM n WHERE d < 2"""


def top_level_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level nodes, and the files of other kinds that have none."""
    docs = _docs(spark, sf_dir)
    nodes, skipped = chunking.top_level_nodes(chunking.python_symbols(docs.where("language = 'python'")), docs)
    return nodes.select(F.col("kind").alias("what"), "name", F.lit(1).cast("long").alias("n")).unionByName(skipped.select(F.lit("skipped").alias("what"), F.col("extension").alias("name"), F.col("files").alias("n")))


TOP_SQL = f"""WITH {_P} SELECT 'function' AS what, 'd.c' || k || '.f' || k AS name, 1::BIGINT AS n FROM n WHERE d = 0 UNION ALL SELECT 'class', 'd.c' || k || '.C' || k, 1 FROM n WHERE d = 0
UNION ALL SELECT 'skipped', ['.json', '.md', '.txt'][d - 1], count(*) FROM n WHERE d > 1 GROUP BY d"""


def config_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of every event, flattened, with the line of each key."""
    docs = table(spark, sf_dir, "events").select(F.lit("s1").alias("snapshot_id"), F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.replace("props", F.lit(","), F.lit(",\n")).alias("content"))
    rows = chunking.config_rows(docs)
    at = chunking.key_lines(rows.select("path", "ord", "name"), docs.select("path", "content"), "path")
    return rows.join(at, ["path", "ord"], "left").select("path", "ord", "json_path", "kind", "value", "parent", "line_no")


CONFIG_ROWS_SQL = """WITH e AS (SELECT 'e' || event_id || '.json' AS path, regexp_extract(props, ':\\s*([0-9]+)', 1) AS v FROM events)
SELECT path, 0 AS ord, '$' AS json_path, 'object' AS kind, NULL AS value, NULL AS parent, NULL::INT AS line_no FROM e UNION ALL SELECT path, 1, '$.k', 'value', v, '$', 1 FROM e"""


def token_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 300 estimated tokens cut into slices that overlap by a short line."""
    docs = chunks(spark, sf_dir).withColumn("start_line", F.lit(1))
    return chunking.slices(docs, "chunk_id", 300, 60).withColumn("content", F.md5("content"))


#: Line by line: ``opened`` is the first line of the open slice, ``taken`` the last line; a full slice is emitted by the row after it.
SLICES_SQL = f"""WITH RECURSIVE {_LINES_CTE}, s AS (SELECT chunk_id, line_no, line, len(regexp_extract_all(line, '{_EST}')) AS n FROM ln),
tot AS (SELECT chunk_id, count(*) AS c, sum(n) AS t FROM s GROUP BY 1),
r(chunk_id, taken, opened, tokens, latest, e_from, e_to, e_tokens) AS (
  SELECT chunk_id, 0::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM tot WHERE t > 300 AND c > 1
  UNION ALL
  SELECT chunk_id, taken + 1, CASE WHEN back THEN taken WHEN is_full THEN taken + 1 ELSE opened END, CASE WHEN back THEN latest WHEN is_full THEN 0 ELSE tokens END + n, n,
    CASE WHEN is_full THEN opened END, CASE WHEN is_full THEN taken END, CASE WHEN is_full THEN tokens END
  FROM (SELECT *, is_full AND latest <= 60 AND latest + n <= 300 AND taken > opened AS back
    FROM (SELECT r.*, s.n, taken >= opened AND tokens + s.n > 300 AS is_full FROM r JOIN s ON s.chunk_id = r.chunk_id AND s.line_no = r.taken + 1))),
cut AS (SELECT chunk_id, e_from AS a, e_to AS b, e_tokens AS tokens FROM r WHERE e_from IS NOT NULL
  UNION ALL SELECT r.chunk_id, opened, taken, tokens FROM r JOIN tot ON tot.chunk_id = r.chunk_id AND r.taken = tot.c
  UNION ALL SELECT chunk_id, 1, c, t FROM tot WHERE t <= 300 OR c = 1)
SELECT cut.chunk_id, (dense_rank() OVER (PARTITION BY cut.chunk_id ORDER BY b) - 1)::INT AS slice, a::INT AS start_line, b::INT AS end_line, any_value(tokens)::INT AS tokens, md5(string_agg(line, chr(10) ORDER BY line_no)) AS content
FROM cut JOIN s ON s.chunk_id = cut.chunk_id AND line_no BETWEEN a AND b GROUP BY cut.chunk_id, a, b"""


def paragraph_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as paragraphs, cut at 1,500 characters."""
    docs = chunks(spark, sf_dir).withColumn("start_line", F.lit(1))
    return chunking.split_paragraphs(docs, "chunk_id").withColumn("content", F.md5("content"))


#: ``past`` counts the characters of earlier lines; ``far`` is the last line from which 120 characters lie before this one.
PARTS_SQL = """WITH RECURSIVE l AS (SELECT doc_id AS chunk_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT chunk_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM l),
y AS (SELECT *, length(line) + 1 AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS past FROM x),
s AS (SELECT y.*, coalesce(z.i, 0) AS far FROM y ASOF LEFT JOIN y z ON y.chunk_id = z.chunk_id AND y.past - 120 >= z.past),
r(chunk_id, taken, opened, size, e_from, e_to) AS (
  SELECT DISTINCT chunk_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM l
  UNION ALL
  SELECT chunk_id, taken + 1, CASE WHEN NOT is_full THEN opened WHEN got + n > 1500 THEN taken ELSE back END, CASE WHEN NOT is_full THEN size WHEN got + n > 1500 THEN 0 ELSE got END + n,
    CASE WHEN is_full THEN opened END, CASE WHEN is_full THEN taken - 1 END
  FROM (SELECT q.*, q.past - b.past AS got FROM (
    SELECT r.*, s.n, s.past, size > 0 AND size + s.n > 1500 AS is_full, least(taken, greatest(opened + 1, s.far)) AS back FROM r JOIN s ON s.chunk_id = r.chunk_id AND s.i = r.taken) q
    JOIN s b ON b.chunk_id = q.chunk_id AND b.i = q.back)),
cut AS (SELECT chunk_id, e_from AS a, e_to AS b FROM r WHERE e_from IS NOT NULL UNION ALL SELECT r.chunk_id, opened, taken - 1 FROM r JOIN l ON l.chunk_id = r.chunk_id AND r.taken = len(l.l))
SELECT cut.chunk_id, (dense_rank() OVER (PARTITION BY cut.chunk_id ORDER BY b) - 1)::INT AS part, (a + 1)::INT AS start_line, (b + 1)::INT AS end_line, md5(string_agg(line, chr(10) ORDER BY i)) AS content
FROM cut JOIN x ON x.chunk_id = cut.chunk_id AND i BETWEEN a AND b GROUP BY cut.chunk_id, a, b"""

QUERIES = {
    "parse_files": parse_files, "python_facts": python_facts, "structure_findings": structure_findings, "top_level_nodes": top_level_nodes, "config_rows": config_rows,
    "token_slices": token_slices, "paragraph_parts": paragraph_parts,
}
ORACLES = {
    "parse_files": PARSE_SQL, "python_facts": FACTS_SQL, "structure_findings": STRUCTURE_FINDINGS_SQL, "top_level_nodes": TOP_SQL, "config_rows": CONFIG_ROWS_SQL,
    "token_slices": SLICES_SQL, "paragraph_parts": PARTS_SQL,
}
