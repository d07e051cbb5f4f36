"""Assembling context for a question: its intents, the evidence's overlap with it, and a merge with reserved slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph

from .locate import LOCATION_STOP_WORDS, identifier_terms

#: Words that signal an intent; those of letters only must be whole terms, the others may stand anywhere.
INTENT_MARKERS = {
    "behavior": (
        "behavior", "flow", "works", "called", "invoked", "returns", "logic", "process", "how does", "what happens",
        "实现", "行为", "流程", "逻辑", "如何", "怎么", "调用", "返回",
    ),
    "impact": (
        "impact", "affected", "affects", "caller", "callers", "reference", "references", "depend", "depends", "dependency", "modify", "modifies",
        "change", "changes", "changing", "break", "breaks", "callers are affected", "depends on",
        "影响", "受影响", "修改", "变更", "改动", "依赖", "调用方", "引用", "哪些文件",
    ),
    "test": (
        "test", "tests", "testing", "coverage", "verify", "validation", "pytest", "unittest", "which tests",
        "测试", "测试用例", "验证", "覆盖", "单测", "单元测试",
    ),
}
#: Requests for an output format.
FORMAT_MARKERS = ("return json", "return only json", "return a json", "respond with json", "reply with json", "output json", "json only")


def without_format_request(question: Column) -> Column:
    """The question without sentences that ask for an output format; the whole of it if nothing else is left."""
    flat = F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " "))
    kept = F.filter(F.split(flat, r"(?<=[.!?;])\s+"), lambda s: ~F.exists(F.array(*map(F.lit, FORMAT_MARKERS)), lambda m: F.contains(F.lower(s), m)))
    joined = F.trim(F.array_join(kept, " "))
    return F.when(joined != "", joined).otherwise(flat)


def intents(question: Column) -> Column:
    """Sorted intents of a question."""
    plain = without_format_request(question)
    terms, low = identifier_terms(plain), F.lower(plain)
    found = []
    for intent, markers in INTENT_MARKERS.items():
        words = [m for m in markers if m.isascii() and m.replace("_", "").isalnum()]
        met = F.arrays_overlap(terms, F.array(*map(F.lit, words)))
        for m in markers:
            if m not in words:
                met = met | F.contains(low, F.lit(m))
        found.append(F.when(met, intent))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def question_terms(question: Column) -> Column:
    return F.filter(identifier_terms(without_format_request(question)), lambda t: (F.char_length(t) >= 3) & ~t.isin(*LOCATION_STOP_WORDS))


def is_test_evidence(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.startswith(low, F.lit("tests/")) | F.contains(low, F.lit("/tests/")) | F.startswith(low, F.lit("test_")) | F.contains(low, F.lit(".test.")) | F.contains(low, F.lit(".spec."))


def merge_evidence(evidence: DataFrame, most: int = 8, phrase_slots: int = 2) -> DataFrame:
    """The rows that stay and their position.

    ``evidence``: query_id, intents (array), origin (phrase, primary, supplement), ord (order within the origin), path,
    start_line, end_line, overlap, is_impact, is_definition.  A range counts once.  Phrase rows come first, supplements
    before primary rows only for impact and test questions.  Slots are reserved in turn: two phrase rows, one impact row, one
    test and one other row, a definition, one other row for behaviour; the rest go by overlap.  All windows share one
    partitioning.
    """
    has = lambda x: F.array_contains("intents", x)
    pointed = has("impact") | has("test")
    late = F.when(F.col("origin") == "phrase", 0).when((F.col("origin") == "supplement") == pointed, 1).otherwise(2)
    by_query = Window.partitionBy("query_id")
    rows = evidence.where(F.trim("path") != "").withColumn("_late", late)
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("query_id", "path", "start_line", "end_line").orderBy("_late", "ord"))).where("_copy = 1")
    rows = rows.withColumn("_n", F.row_number().over(by_query.orderBy("_late", "ord", "path", "start_line")))
    test = is_test_evidence(F.col("path"))
    steps = [(F.lit(True), F.col("origin") == "phrase", phrase_slots), (has("impact"), F.col("is_impact"), 1), (has("test"), test, 1), (has("test"), ~test, 1)]
    steps += [(~pointed, F.col("is_definition") & ~test, 1), (has("behavior") & ~pointed, ~test, 1)]
    rows = rows.withColumn("_slot", F.lit(None).cast("int"))
    for k, (asked, fits, n) in enumerate(steps):
        free = asked & fits & F.col("_slot").isNull()
        rows = rows.withColumn("_free", free).withColumn("_r", F.row_number().over(by_query.orderBy(F.desc("_free"), "_n")))
        rows = rows.withColumn("_slot", F.when(F.col("_free") & (F.col("_r") <= n), k * 10 + F.col("_r")).otherwise(F.col("_slot")))
    order = by_query.orderBy(F.col("_slot").asc_nulls_last(), F.desc("overlap"), "_n")
    ranked = rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    return ranked.drop("_late", "_copy", "_n", "_slot", "_free", "_r")


def is_definition(*described: Column) -> Column:
    """Evidence whose role, reason, title or symbol says that it is a definition."""
    text = F.lower(F.concat_ws(" ", *described))
    return F.contains(text, F.lit("definition")) | F.contains(text, F.lit("implementation")) | F.contains(text, F.lit("target symbol"))


def is_impact(*described: Column) -> Column:
    """Evidence whose role or reason speaks of callers, callees, references or impact."""
    return F.rlike(F.lower(F.concat_ws(" ", *described)), F.lit("impact|caller|callee|reference"))


def overlap(question: Column, path: Column, symbol: Column, title: Column) -> Column:
    """Terms of the question that the path, symbol or title of a row has."""
    return F.size(F.array_intersect(question_terms(question), identifier_terms(F.concat_ws(" ", path, symbol, title))))


def coverage(evidence: DataFrame) -> DataFrame:
    """query_id, evidence, files, test_files, definitions, impacts, off_topic, test_shown, source_shown.

    ``evidence``: query_id, path, overlap, is_impact, is_definition.  A batch is off topic if no row shares a term with the
    question; a test is shown by a term in common, source by two.
    """
    path = F.when(F.trim("path") != "", F.col("path"))
    test = is_test_evidence(F.coalesce(path, F.lit("")))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return evidence.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("evidence"),
        F.count_distinct(path).alias("files"),
        F.count_distinct(F.when(test, path)).alias("test_files"),
        F.sum(F.col("is_definition").cast("int")).alias("definitions"),
        F.sum(F.col("is_impact").cast("int")).alias("impacts"),
        (F.max("overlap") == 0).alias("off_topic"),
        any_(path.isNotNull() & test & (F.col("overlap") >= 1)).alias("test_shown"),
        any_(path.isNotNull() & ~test & (F.col("overlap") >= 2)).alias("source_shown"),
    )


def needs_more(questions: DataFrame, covered: DataFrame) -> DataFrame:
    """query_id, needs_more: whether what was found is too shallow for the question's intents.

    ``questions``: query_id, intents (array).  Nothing found or nothing on topic always needs more; a question without an
    intent needs no more; others need two rows of two files, three rows for impact and tests, a definition for behaviour,
    an impact row for impact, and a related test and source for tests.
    """
    has = lambda x: F.array_contains("intents", x)
    thin = (
        (F.col("evidence") < 2)
        | (F.col("files") < 2)
        | ((has("impact") | has("test")) & (F.col("evidence") < 3))
        | (has("behavior") & (F.col("definitions") == 0))
        | (has("impact") & (F.col("impacts") == 0))
        | (has("test") & ~(F.col("test_shown") & F.col("source_shown")))
    )
    rows = questions.join(covered, "query_id", "left")
    need = F.when(F.col("evidence").isNull() | F.col("off_topic"), True).when(F.size("intents") == 0, False).otherwise(thin)
    return rows.select("query_id", need.alias("needs_more"))


def phrase_recall(ranked: DataFrame, per_phrase: int = 2) -> DataFrame:
    """The first rows of each key phrase's search that name lines: query_id, position (of the phrase), phrase, ord, chunk_id, path.

    ``ranked``: query_id, position, phrase, rank, chunk_id, path, start_line, end_line.
    """
    checkable = ranked.where("start_line >= 0 and end_line >= 0")
    ord_ = F.row_number().over(Window.partitionBy("query_id", "position").orderBy("rank", "chunk_id"))
    return checkable.withColumn("ord", ord_).where(F.col("ord") <= per_phrase).select("query_id", "position", "phrase", "ord", "chunk_id", "path", "start_line", "end_line")


def target_location(locations: DataFrame) -> DataFrame:
    """query_id and the location a follow-up starts from: label, path, chunk_id.

    ``locations``: query_id, rank, label, path, chunk_id, kind, basis, query, intents.  In turn: it has a symbol, is the
    first, suits the intent, matches outright, is a function, shares terms with the question, is no test, has a low rank.
    """
    test = is_test_evidence(F.col("path"))
    terms = F.array_union(identifier_terms(F.coalesce("label", F.lit(""))), identifier_terms(F.col("path")))
    suits = (F.array_contains("intents", "test") & test).cast("int") + (F.array_contains("intents", "impact") & ~test).cast("int")
    of = lambda c, names: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), F.lit(0))
    key = F.struct(
        (F.coalesce(F.trim("label"), F.lit("")) != "").cast("int").alias("symbol"),
        (F.col("rank") == 1).cast("int").alias("first"),
        suits.alias("suits"),
        of(F.col("basis"), {"exact_symbol": 3, "body_match": 2, "symbol_match": 1}).alias("basis"),
        of(F.col("kind"), {"function": 3, "method": 3, "class": 2, "module": 1}).alias("kind"),
        F.size(F.array_intersect(question_terms(F.col("query")), terms)).alias("overlap"),
        (~test).cast("int").alias("source"),
        (-F.col("rank")).alias("rank"),
    )
    return locations.groupBy("query_id").agg(F.max_by(F.struct("label", "path", "chunk_id"), key).alias("x")).select("query_id", "x.*")


def structured_answers(anchors: DataFrame, definitions: DataFrame, edges: DataFrame, references: DataFrame, units: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """impact, tests and symbol rows, as ``supplement`` takes them, of the symbol that each question is about.

    ``anchors``: query_id, snapshot_id, symbol; ``definitions``, ``edges`` and ``references`` as ``graph.impact_evidence`` takes
    them; ``units``: unit_id, path, start_line, end_line; ``files``: snapshot_id, path, is_test.  Impact is what calls or names
    the symbol, best score first; tests are test and entry files on the symbol's impact paths, or the snapshot's; the
    symbol is its definition.
    """
    asked, place = anchors.select("query_id", "symbol"), units.select("unit_id", "start_line", "end_line")
    known = definitions.join(asked.select("symbol").distinct(), "symbol", "left_semi")
    reached = graph.impact_evidence(known, edges, references, units).join(asked, "symbol")
    nth = lambda *by: F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    shape = lambda rows: rows.select("query_id", "ord", F.col("unit_id").alias("chunk_id"), "path", "start_line", "end_line")
    impact = reached.where(F.col("group") != "definition").join(place, "unit_id").withColumn("ord", nth(F.desc("score"), "path", "unit_id"))
    tests = graph.related_tests(reached.select("query_id", "path"), files, anchors.select("query_id", "snapshot_id"))
    first = units.groupBy("path").agg(F.min(F.struct("start_line", "end_line", "unit_id")).alias("x")).select("path", "x.*")
    tests = tests.join(first, "path").withColumn("ord", nth("basis", "path"))
    symbol = asked.join(definitions, "symbol").join(units.select("unit_id", "path", "start_line", "end_line"), "unit_id").withColumn("ord", nth("path", "unit_id"))
    return {"impact": shape(impact), "tests": shape(tests), "symbol": shape(symbol)}


def supplement(asked: DataFrame, plans: dict[str, DataFrame], each: int = 4) -> DataFrame:
    """Rows of the structured answers that a question's gap calls for, at most ``each`` of an answer.

    ``asked``: query_id, intents, has_definition, has_source of questions that need more; ``plans``: impact, tests and
    symbol, each with query_id, ord, chunk_id, path, start_line, end_line.  Impact questions get impact rows, and tests or
    (without a definition) the symbol; test questions tests, and the symbol if no source is shown; all others the symbol.
    """
    has = lambda x: F.array_contains("intents", x)
    wanted = {
        "impact": has("impact"),
        "tests": has("test"),
        "symbol": F.when(has("impact"), ~has("test") & ~F.col("has_definition")).when(has("test"), ~F.col("has_source")).otherwise(F.lit(True)),
    }
    role = {"impact": F.lit("static_impact_evidence"), "tests": F.lit("related_test"), "symbol": F.when(has("impact") | has("test"), "symbol_definition").otherwise("symbol_behavior_evidence")}
    rows = None
    for name, answer in plans.items():
        n = F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "chunk_id"))
        own = answer.withColumn("ord", n).where(F.col("ord") <= each)
        found = own.join(asked.where(wanted[name]).select("query_id", role[name].alias("role")), "query_id").select("query_id", "role", "ord", "chunk_id", "path", "start_line", "end_line")
        rows = found if rows is None else rows.unionByName(found)
    return rows


def recover(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of the first stage that answers each question, with the stage's name: search, retry, symbol, structure."""
    rows, answered = None, None
    for name, found in stages:
        own = found if answered is None else found.join(answered, "query_id", "left_anti")
        own = own.withColumn("stage", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
        ids = found.select("query_id").distinct()
        answered = ids if answered is None else answered.unionByName(ids).distinct()
    return rows


def assemble(questions: DataFrame, primary: DataFrame, phrases: DataFrame, plans: dict[str, DataFrame], most: int = 8) -> DataFrame:
    """query_id, position, origin, chunk_id, path, start_line, end_line: the context of each question.

    ``questions``: query_id, query; ``primary``: query_id, ord, chunk_id, path, start_line, end_line, symbol, title, role;
    ``phrases``: as ``phrase_recall`` gives them; ``plans``: as ``supplement`` takes them.  Questions whose primary rows are
    too shallow get phrase rows and a supplement; all rows then share the slots.
    """
    asked = questions.select("query_id", "query", intents(F.col("query")).alias("intents"))
    seen = primary.join(asked, "query_id").withColumn("overlap", overlap(F.col("query"), F.col("path"), F.col("symbol"), F.col("title")))
    seen = seen.withColumn("is_definition", is_definition(F.col("role"), F.col("title"), F.col("symbol"))).withColumn("is_impact", is_impact(F.col("role")))
    covered = coverage(seen)
    short = needs_more(asked, covered).where("needs_more").select("query_id")
    gap = asked.join(short, "query_id").join(covered, "query_id", "left").select(
        "query_id", "intents", (F.coalesce("definitions", F.lit(0)) > 0).alias("has_definition"), F.coalesce("source_shown", F.lit(False)).alias("has_source")
    )
    more = supplement(gap, plans)
    shape = ["query_id", "origin", "ord", "chunk_id", "path", "start_line", "end_line", "overlap", "is_impact", "is_definition"]
    none = F.lit(None).cast("string")

    def shaped(rows: DataFrame, origin: str) -> DataFrame:
        rows = rows.join(asked.select("query_id", "query"), "query_id").withColumn("overlap", overlap(F.col("query"), F.col("path"), none, none))
        return rows.withColumn("origin", F.lit(origin)).withColumn("is_definition", is_definition(F.col("role"))).withColumn("is_impact", is_impact(F.col("role"))).select(*shape)

    recalled = phrases.join(short, "query_id", "left_semi").withColumn("ord", F.col("position") * 100 + F.col("ord")).withColumn("role", F.lit("keyphrase_recall"))
    rows = seen.withColumn("origin", F.lit("primary")).select(*shape).unionByName(shaped(recalled, "phrase")).unionByName(shaped(more, "supplement"))
    merged = merge_evidence(rows.join(asked.select("query_id", "intents"), "query_id"), most)
    return merged.select("query_id", "position", "origin", "chunk_id", "path", "start_line", "end_line")
