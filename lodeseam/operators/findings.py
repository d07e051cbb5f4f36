"""Rule findings over text: per-line patterns, capped in file order, and leak checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

#: Fixed values: (rule, severity, pattern).
CODE_RULES = (
    ("eval", "high", r"\beval\s*\("),
    ("exec", "high", r"\bexec\s*\("),
    ("pickle.loads", "high", r"\bpickle\.loads\s*\("),
    ("yaml.load", "medium", r"\byaml\.load\s*\("),
    ("shell=True", "medium", r"subprocess\.[A-Za-z_]+\([^\n]*shell\s*=\s*True"),
)
#: Fixed values.
SECRET_RULES = (
    ("hard-coded secret", "high", r"(?i)(api[_-]?key|secret|token|password)\s*=\s*['\"][^'\"]{8,}['\"]"),
    ("private key", "high", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
)


def line_findings(docs: DataFrame, key: str, rules=CODE_RULES + SECRET_RULES, sample: int | None = None) -> DataFrame:
    """key, line_no, rule, severity, snippet for each rule a line matches; lines that match none never leave the row.

    All of a text is read, unless ``sample`` names how many characters.
    """
    content = F.col("content") if sample is None else F.substring("content", 1, sample)
    lines = F.transform(X.split_lines(content), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    hits = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.lit(p).alias("pattern")) for n, s, p in rules])
    anything = lambda line: F.exists(hits, lambda r: F.rlike(line, r["pattern"]))
    near = docs.select(key, F.explode(F.filter(lines, lambda x: anything(x["line"]))).alias("x"))
    found = near.select(key, "x.line_no", "x.line", F.explode(F.filter(hits, lambda r: F.rlike(F.col("x.line"), r["pattern"]))).alias("r"))
    return found.select(key, "line_no", "r.rule", "r.severity", X.snippet(F.col("line"), 240).alias("snippet"))


def cap_findings(found: DataFrame, scope: str, order: list[str], most: int = 20) -> DataFrame:
    """In order, stop after the place that brings a scope to ``most`` findings; that place keeps all of its own.

    A scope's findings are cut in parts first, each to its own first places, so that a scope with most of the findings
    is no single task's: what stays of a scope is among what stays of its parts.
    """
    rank = lambda *by: F.rank().over(Window.partitionBy(scope, *by).orderBy(*order))
    parts = found.withColumn("_part", F.spark_partition_id()).withColumn("_rank", rank("_part")).where(F.col("_rank") <= most)
    return parts.withColumn("_rank", rank()).where(F.col("_rank") <= most).drop("_part", "_rank")


def leaks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows that redaction would change: what must not be in a capture."""
    clean = X.redact(F.col(text))
    return rows.where(clean != F.coalesce(F.col(text), F.lit(""))).select(key, clean.alias("redacted"))


#: Terms that mark a unit, by what they suggest.
SECURITY_TERMS = {
    "dynamic execution": ("eval(", "exec("),
    "command execution": ("shell=true", "subprocess."),
    "sensitive fields": ("api_key", "password", "private key", "secret"),
    "unsafe deserialization": ("pickle.loads", "yaml.load("),
}
#: Topics of a document.
TOPICS = ("install", "usage", "quickstart", "api", "test")


def security_review(units: DataFrame, key: str) -> DataFrame:
    """key, rules (array): units that hold a term of any group, whatever its case."""
    low = F.lower(F.coalesce("content", F.lit("")))
    met = []
    for title, terms in SECURITY_TERMS.items():
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(low, F.lit(t))
        met.append(F.when(hit, title))
    found = units.withColumn("rules", F.filter(F.array(*met), lambda x: x.isNotNull()))
    return found.where(F.size("rules") > 0).select(key, "rules")


def document_findings(docs: DataFrame, key: str, most: int = 8, sample: int | None = None) -> DataFrame:
    """key, headings (the first ``most`` lines that start with #), topics: what a document is about.  ``sample``: characters, all without it."""
    text = F.coalesce(F.col("content") if sample is None else F.left("content", F.lit(sample)), F.lit(""))
    marked = F.filter(X.split_lines(text), lambda x: F.startswith(F.ltrim(x), F.lit("#")))
    headings = F.slice(F.transform(marked, lambda x: F.regexp_replace(x, r"^[# ]+|[# ]+$", "")), 1, most)
    topics = F.filter(F.array(*[F.when(F.contains(F.lower(text), F.lit(t)), t) for t in TOPICS]), lambda x: x.isNotNull())
    return docs.select(key, headings.alias("headings"), topics.alias("topics"))


def config_findings(files: DataFrame, key: str) -> DataFrame:
    """key, kind, scripts (array), dependencies, dev_dependencies, lines: what a configuration file says, by its name.

    ``files``: key, path, content.  package.json (null counts if it does not parse), requirement and build files (lines that
    say something), container files, others.
    """
    name = X.file_name(F.lower("path"))
    kind = (
        F.when(name == "package.json", "node")
        .when(name.isin("requirements.txt", "pyproject.toml", "setup.py"), "python")
        .when(F.startswith(name, F.lit("docker")), "container")
        .otherwise("other")
    )
    parsed = F.from_json("content", "scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>")
    node = kind == "node"
    size = lambda c: F.when(node & F.try_parse_json("content").isNotNull(), F.coalesce(F.size(F.map_keys(c)), F.lit(0)))
    said = F.filter(X.split_lines(F.col("content")), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))
    rows = files.withColumn("_p", parsed).withColumn("_k", kind)
    return rows.select(
        key, F.col("_k").alias("kind"), F.when(node, F.slice(F.map_keys(F.col("_p.scripts")), 1, 8)).alias("scripts"), size(F.col("_p.dependencies")).alias("dependencies"),
        size(F.col("_p.devDependencies")).alias("dev_dependencies"), F.when(kind == "python", F.size(said)).alias("lines"),
    )


def normalized_config(units: DataFrame, key: str, most: int = 8) -> DataFrame:
    """key, objects, values, keys (the first ``most``): counts of flattened configuration units (key, ord, kind, name)."""
    of = lambda k: F.sum((F.col("kind") == k).cast("int")).alias(k + "s")
    first = units.where(F.trim("name") != "").groupBy(key, "name").agg(F.min("ord").alias("ord"))
    names = first.groupBy(key).agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), 1, most).alias("keys"))
    return units.groupBy(key).agg(of("object"), of("value")).join(names, key, "left")


def structure_findings(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """path, classes (6), functions (8), imports, main_guard, parse_failed of Python files.

    ``facts``: as ``chunking.python_symbols`` gives them; ``sources``: path, content.  Only top-level nodes count.
    """
    top = F.size(F.split(F.col("name"), r"\.")) == F.size(F.split(F.col("module"), r"\.")) + 1
    modules = facts.where("fact = 'symbol' and kind = 'module'").select("path", F.col("name").alias("module"))
    rows = facts.join(modules, "path", "left")
    own = lambda kind, n: F.transform(F.slice(F.sort_array(F.collect_list(F.when((F.col("fact") == "symbol") & (F.col("kind") == kind) & top, F.struct("start_line", F.element_at(F.split("name", r"\."), -1).alias("s"))))), 1, n), lambda x: x["s"])
    found = rows.groupBy("path").agg(
        own("class", 6).alias("classes"),
        own("function", 8).alias("functions"),
        F.count_distinct(F.when((F.col("fact") == "relation") & (F.col("kind") == "imports") & (F.col("name") == F.col("module")), F.col("start_line"))).alias("imports"),
        F.bool_or(F.col("fact") == "diagnostic").alias("parse_failed"),
    )
    guard = F.contains("content", F.lit("if __name__")) & F.contains("content", F.lit("__main__"))
    return found.join(sources.select("path", guard.alias("main_guard")), "path", "left")


def architecture_findings(files: DataFrame, keys: DataFrame) -> DataFrame:
    """snapshot_id, title, detail: the structure of a snapshot and its entry points.  ``keys``: as ``corpus_map.key_files`` gives them."""
    n = files.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.array_join(F.sort_array(F.collect_set("language")), ", ").alias("languages"))
    whole = n.select("snapshot_id", F.lit("structure").alias("title"), F.concat_ws(" ", F.col("files").cast("string"), F.lit("files:"), F.col("languages")).alias("detail"))
    paths = F.transform(F.sort_array(F.collect_list(F.struct("position", "path"))), lambda x: x["path"])
    entries = keys.where("facet = 'entrypoints' and position <= 8").groupBy("snapshot_id").agg(F.array_join(paths, ", ").alias("detail"))
    return whole.unionByName(entries.select("snapshot_id", F.lit("entry points").alias("title"), "detail"))


#: Sections of a report in reading order.
SECTIONS = ("architecture", "documents", "configuration", "security")


def _numbered(found: DataFrame) -> DataFrame:
    """``found``: report_id, section, ord, title, severity.  Adds _s (place of the section) and _n (place in the report)."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")), F.lit(99))
    rows = found.withColumn("_s", F.when(place == 0, 99).otherwise(place))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("report_id").orderBy("_s", "section", "ord")))


def section_guide(found: DataFrame, most: int = 5) -> DataFrame:
    """report_id, position, section, findings, reading (titles), needs_review (titles of medium and high ones)."""
    rows = _numbered(found)
    listed = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["title"])
    item = F.struct("_n", "title")
    guide = rows.groupBy("report_id", "_s", "section").agg(
        F.count(F.lit(1)).alias("findings"), F.slice(listed(item), 1, most).alias("reading"), listed(F.when(F.col("severity").isin("medium", "high"), item)).alias("needs_review")
    )
    position = F.row_number().over(Window.partitionBy("report_id").orderBy("_s", "section"))
    return guide.withColumn("position", position).select("report_id", "position", "section", "findings", "reading", "needs_review")


def chief_summary(found: DataFrame, titles: int = 8, risks: int = 10) -> DataFrame:
    """report_id, summary (findings of each section), reading (distinct titles), risks ([severity] title)."""
    rows = _numbered(found)
    counts = rows.groupBy("report_id", "_s", "section").agg(F.count(F.lit(1)).alias("n"))
    part = F.struct("_s", "section", F.concat("section", F.lit(": "), F.col("n").cast("string"), F.lit(" findings")).alias("t"))
    summary = counts.groupBy("report_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), ", ").alias("summary"))
    first = rows.where("title <> ''").groupBy("report_id", "title").agg(F.min("_n").alias("_n"))
    reading = first.groupBy("report_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("_n", "title"))), lambda x: x["title"]), 1, titles).alias("reading"))
    item = F.when(F.col("severity").isin("high", "medium") & (F.col("title") != ""), F.struct("_n", F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("title")).alias("t")))
    risky = rows.groupBy("report_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), 1, risks).alias("risks"))
    return summary.join(reading, "report_id", "left").join(risky, "report_id", "left")


def safe_alias(alias: Column) -> Column:
    """The name a report may show: never an absolute path."""
    name = F.trim(F.coalesce(alias, F.lit("")))
    return F.when((name == "") | F.rlike(name, F.lit(r"^([A-Za-z]:[\\/]|\\\\|/)")), "local-repository").otherwise(name)


def report_sections(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """report_id, position, title, lines: the report as ``sources.corpus.markdown`` and ``write_report`` take it.

    ``found``: report_id, section, ord, title, severity; ``aliases``: report_id, alias.
    """
    head = chief_summary(found).join(aliases, "report_id", "left")
    lines = F.concat(F.array(F.concat(F.lit("repository: "), safe_alias(F.col("alias"))), F.col("summary")), F.col("risks"))
    top = head.select("report_id", F.lit(0).alias("position"), F.lit("Summary").alias("title"), lines.alias("lines"))
    rest = section_guide(found).select("report_id", "position", F.initcap("section").alias("title"), F.col("reading").alias("lines"))
    return top.unionByName(rest)


#: Names of fields whose values are never exported.
SENSITIVE_KEYS = r"(?i)(api[_-]?key|token|auth|password|passwd|secret|credential)"


def redact_fields(fields: Column) -> Column:
    """A map of a record's fields with sensitive ones replaced and the texts of all others redacted."""
    return F.transform_values(fields, lambda k, v: F.when(F.rlike(k, F.lit(SENSITIVE_KEYS)), F.lit("[redacted]")).otherwise(X.redact(v)))


def export_traces(steps: DataFrame, most_steps: int = 200, width: int = 2000, refs_each: int = 50, refs_all: int = 500) -> DataFrame:
    """trace_id, steps (array of step, role, text), dropped_steps, cut_texts, dropped_refs: bounded and redacted traces.

    ``steps``: trace_id, step, role, text, refs (array).  Texts are redacted whole, then cut to ``width`` characters; a step
    keeps ``refs_each`` references and a trace ``refs_all``, earlier steps first.
    """
    order = Window.partitionBy("trace_id").orderBy("step")
    clean = X.redact(F.col("text"))
    refs = F.coalesce(F.slice("refs", 1, refs_each), F.expr("cast(array() as array<string>)"))
    rows = steps.withColumn("_n", F.row_number().over(order)).withColumn("_clean", F.when(F.col("_n") <= most_steps, clean)).withColumn("_refs", F.when(F.col("_n") <= most_steps, refs))
    ahead = F.coalesce(F.sum(F.size("_refs")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.slice("_refs", 1, F.greatest(F.lit(refs_all) - ahead, F.lit(0)).cast("int"))
    rows = rows.withColumn("_own", own)
    kept = F.col("_n") <= most_steps
    item = F.when(kept, F.struct("step", "role", F.left("_clean", F.lit(width)).alias("text"), F.col("_own").alias("refs")))
    return rows.groupBy("trace_id").agg(
        F.sort_array(F.collect_list(item)).alias("steps"),
        F.sum((~kept).cast("int")).alias("dropped_steps"),
        F.sum((kept & (F.char_length("_clean") > width)).cast("int")).alias("cut_texts"),
        F.sum(F.coalesce(F.size("refs"), F.lit(0)) - F.coalesce(F.size("_own"), F.lit(0))).cast("int").alias("dropped_refs"),
    )


def evidence_stub(files: DataFrame, reason: str, sample: int = 12_000) -> DataFrame:
    """path, start_line, end_line, reason, sample: a file as evidence; a text that is not the source itself has no lines.

    ``files``: path, content, exact.  The sample's length is the point of a stub.
    """
    text = F.left(F.coalesce("content", F.lit("")), F.lit(sample))
    line = lambda c: F.when(F.col("exact"), c)
    return files.select("path", line(F.lit(1)).alias("start_line"), line(F.greatest(F.size(X.split_lines(text)), F.lit(1))).alias("end_line"), F.lit(reason).alias("reason"), text.alias("sample"))
