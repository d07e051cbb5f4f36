"""Locating line ranges for a question: its terms, hints, sub-questions and key phrases, windows around matching lines,
and the units that enclose them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from . import ranges

#: Words that say nothing about a place in code.
LOCATION_STOP_WORDS = (
    "a", "after", "an", "and", "another", "are", "as", "asks", "at", "be", "before", "by", "code", "decide", "does", "for", "from", "function",
    "functions", "generates", "how", "in", "into", "is", "it", "its", "locate", "location", "of", "on", "or", "proceeds", "report", "result",
    "results", "successful", "that", "the", "this", "to", "two", "waits", "when", "whether", "where", "with", "agent", "agents", "workflow",
    "workflows",
)
_WORD = r"([A-Za-z_][A-Za-z0-9_]*)"
_PARTS = r"_|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def identifier_terms(text: Column) -> Column:
    """Distinct lower-case parts of words, snake_case and camelCase names, sorted."""
    words = F.regexp_extract_all(text, F.lit(_WORD))
    parts = F.flatten(F.transform(words, lambda w: F.filter(F.split(w, _PARTS), lambda p: p != "")))
    return F.sort_array(F.array_distinct(F.transform(parts, lambda p: F.lower(p))))


def location_terms(text: Column) -> Column:
    kept = F.filter(identifier_terms(text), lambda t: (F.char_length(t) >= 3) & ~t.isin(*LOCATION_STOP_WORDS))
    return F.when(F.array_contains(kept, "handler"), F.sort_array(F.array_distinct(F.concat(kept, F.array(F.lit("adapter")))))).otherwise(kept)


def hints(text: Column) -> Column:
    """class_names, methods (Class.method) and symbols (three parts or more) named outright, lower case, sorted."""
    tidy = lambda found: F.sort_array(F.array_distinct(F.transform(found, lambda x: F.lower(x))))
    names = F.filter(F.regexp_extract_all(text, F.lit(_WORD)), lambda w: F.rlike(w, F.lit("[A-Z]")))
    methods = F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*)\b"))
    symbols = F.regexp_extract_all(text, F.lit(r"\b((?:[A-Za-z_][A-Za-z0-9_]*\.){2,}[A-Za-z_][A-Za-z0-9_]*)\b"))
    return F.struct(tidy(names).alias("class_names"), tidy(methods).alias("methods"), tidy(symbols).alias("symbols"))


def sub_questions(text: Column, most: int = 4) -> Column:
    """The question, then the clauses of a paired question that say enough, at most ``most``."""
    whole = F.trim(F.regexp_replace(text, r"\s+", " "))
    parts = F.transform(F.split(whole, r"(?i)\s*,?\s+and\s+(?=(?:where|the|how|a|an)\b)"), lambda p, i: F.struct(F.regexp_replace(p, r"^[ ,.;]+|[ ,.;]+$", "").alias("p"), i.alias("i")))
    enough = F.filter(parts, lambda x: (F.size(parts) > 1) & (F.size(location_terms(x["p"])) >= F.when(x["i"] == 0, 2).otherwise(3)))
    clauses = F.array_distinct(F.concat(F.array(whole), F.transform(enough, lambda x: x["p"])))
    expanded = F.array_except(F.transform(clauses, lambda c: F.regexp_replace(c, r"(?i)\bhandler\b", "adapter")), clauses)
    return F.slice(F.concat(clauses, expanded), 1, most)


def keyphrases(questions: DataFrame, most: int = 6) -> DataFrame:
    """query_id, position, phrase: runs of content words and their right-hand ends, longest run first.

    Runs are islands between stop words, found with windows over each question's words.
    """
    words = questions.select("query_id", F.posexplode(F.regexp_extract_all("query", F.lit(_WORD))).alias("at", "word"))
    content = words.where((F.char_length("word") >= 3) & ~F.lower("word").isin(*LOCATION_STOP_WORDS))
    order = Window.partitionBy("query_id").orderBy("at")
    runs = content.withColumn("run", F.col("at") - F.row_number().over(order)).groupBy("query_id", "run").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    runs = runs.where(F.size("w") >= 2).select("query_id", F.size("w").alias("n"), F.col("w")[0]["at"].alias("at"), F.transform("w", lambda x: x["word"]).alias("w"))
    ends = runs.select("query_id", "n", "at", "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("start"))
    phrases = ends.select("query_id", F.struct((-F.col("n")).alias("n"), "at", "start").alias("place"), F.array_join(F.slice("w", F.col("start"), F.col("n")), " ").alias("phrase"))
    first = phrases.groupBy("query_id", F.lower("phrase").alias("_folded")).agg(F.min(F.struct("place", "phrase")).alias("x"))
    ranked = first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("x.place")))
    return ranked.where(F.col("position") <= most).select("query_id", "position", F.col("x.phrase").alias("phrase"))


#: File types that hold source code.
SOURCE_SUFFIXES = (".c", ".cc", ".cpp", ".cs", ".go", ".java", ".js", ".jsx", ".py", ".rb", ".rs", ".ts", ".tsx")


def executable_hits(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, line_no (from 1), hits: terms of the question on each executable line, 0 included.

    ``rows``: key, content, terms (array).  Blank lines, comments, docstrings and block comments are not executable; which
    a line is depends on those before it, so a text is read in order, in an Arrow batch.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                *keys, content = row
                quote, block = None, False
                for n, line in enumerate((content or "").splitlines(), 1):
                    text = line.strip()
                    if quote:
                        quote = None if quote in text else quote
                        continue
                    if block:
                        block = "*/" not in text
                        continue
                    if text[:3] in ("'''", '"""'):
                        quote = text[:3] if text.count(text[:3]) < 2 else None
                    elif text.startswith("/*"):
                        block = "*/" not in text[2:]
                    elif text and not text.startswith(("#", "//", "*")):
                        out.append((*keys, n, line))
            yield pd.DataFrame(out, columns=[*key, "line_no", "line"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*key).dtypes) + ", line_no int, line string"
    code = rows.select(*key, "content").mapInPandas(each, schema)
    terms = rows.select(*key, "terms")
    return code.join(terms, key).select(*key, "line_no", F.size(F.array_intersect(identifier_terms(F.col("line")), F.col("terms"))).alias("hits"))


def structural_locations(candidates: DataFrame, allow_class: bool = False) -> DataFrame:
    """Candidates that are functions or methods (or classes) as locations: query_id, chunk_id, path, start_line, end_line, kind, symbol, score, matched, executable.

    ``candidates``: query_id, chunk_id, path, start_line, end_line, kind, symbol, score, content, terms.
    """
    kinds = ("function", "method", "class") if allow_class else ("function", "method")
    rows = candidates.where(F.col("kind").isin(*kinds) & (F.coalesce("path", F.lit("")) != "") & F.col("start_line").isNotNull() & F.col("end_line").isNotNull())
    hits = executable_hits(rows, ["query_id", "chunk_id"]).groupBy("query_id", "chunk_id").agg(F.sum("hits").cast("int").alias("executable"))
    matched = F.size(F.array_intersect(identifier_terms(F.col("content")), F.col("terms")))
    return rows.join(hits, ["query_id", "chunk_id"], "left").select(
        "query_id", "chunk_id", "path", "start_line", "end_line", "kind", "symbol", "score", matched.alias("matched"), F.coalesce("executable", F.lit(0)).alias("executable")
    )


def symbol_matches(questions: DataFrame, symbols: DataFrame, relations: DataFrame, least: int = 1) -> DataFrame:
    """query_id, symbol, exact (terms matched), class_hit, method_hit, symbol_hit, corroborated.

    ``questions``: query_id, terms (array), hints (struct of class_names, methods, symbols); ``symbols``: symbol, name,
    qualified, kind; ``relations``: source, target of resolved and observed calls.  A symbol matches by ``least`` terms of
    its names, or because the question names its class or itself.  It is corroborated if a call links it, either way, with
    one that matches two terms or more.

    A symbol that shares ``least`` of a question's terms shares one of its rarest, all but ``least`` - 1: only those are
    joined, and the others are counted in the pairs that are found.
    """
    own = written(symbols.where(F.col("kind").isin("function", "method", "class")).select("symbol", "name", "qualified", "kind"), "symbols")  # each way of matching reads them
    parts = F.transform(F.split("qualified", r"\."), lambda p: F.lower(p))
    named = own.select("symbol", F.array_distinct(identifier_terms(F.concat_ws(" ", "name", "qualified"))).alias("own_terms"))
    terms = named.select("symbol", F.explode("own_terms").alias("term"))
    asked = questions.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).join(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term")
    asked = asked.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "term"))).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    rare = asked.where(F.col("nth") <= F.col("of") - (least - 1)).select("query_id", "term")
    by_term = terms.join(rare, "term").select("query_id", "symbol", F.lit("term").alias("way")).distinct()

    def by_hint(way: str, hint: str, names: Column) -> DataFrame:
        wanted = questions.select("query_id", F.explode(f"hints.{hint}").alias("value"))
        return own.select("symbol", F.explode(names).alias("value")).join(wanted, "value").select("query_id", "symbol", F.lit(way).alias("way"))

    method = F.col("kind") == "method"
    none = F.expr("cast(array() as array<string>)")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))
    rows = (
        by_term.unionByName(by_hint("class", "class_names", F.when(method & (n > 1), F.array_distinct(F.slice(parts, 1, n - 1))).otherwise(none)))
        .unionByName(by_hint("method", "methods", F.when(method & (n > 1), F.array(F.array_join(F.slice(parts, n - 1, F.lit(2)), "."))).otherwise(none)))
        .unionByName(by_hint("symbol", "symbols", suffixes))
    )
    has = lambda way: F.max((F.col("way") == way).cast("int"))
    found = rows.groupBy("query_id", "symbol").agg(
        has("class").alias("class_hit"), has("method").alias("method_hit"), has("symbol").alias("symbol_hit")
    )
    found = found.join(named, "symbol").join(questions.select("query_id", "terms"), "query_id").withColumn("exact", F.size(F.array_intersect("own_terms", F.coalesce("terms", none))))
    found = found.select("query_id", "symbol", "exact", "class_hit", "method_hit", "symbol_hit")
    found = found.where((F.col("exact") >= least) | (F.col("class_hit") == 1) | (F.col("symbol_hit") == 1))
    anchors = found.where("exact >= 2").select("query_id", F.col("symbol").alias("at"))
    both = relations.select(F.col("source").alias("at"), F.col("target").alias("symbol")).unionByName(relations.select(F.col("target").alias("at"), F.col("source").alias("symbol")))
    backed = anchors.join(both, "at").select("query_id", "symbol").distinct().withColumn("corroborated", F.lit(1))
    return found.join(backed, ["query_id", "symbol"], "left").withColumn("corroborated", F.coalesce("corroborated", F.lit(0)))


def location_rank(locations: DataFrame) -> DataFrame:
    """Adds rank: source before tests before prose, then symbol, method and class named outright, exact terms, score, executable
    hits, corroboration, compactness, coverage; then by path and line."""
    path = F.lower("path")
    test = F.lit(False)
    for part in ("/test", ".test.", ".spec.", "/e2e/"):
        test = test | F.contains(path, F.lit(part))
    source = F.rlike(path, F.lit("(" + "|".join(x.replace(".", r"\.") for x in SOURCE_SUFFIXES) + ")$"))
    kind = F.when(source & test, 1).when(source, 2).otherwise(0)
    keys = [kind, *map(F.col, ("symbol_hit", "method_hit", "class_hit", "exact", "score", "executable", "corroborated", "compactness", "coverage"))]
    order = Window.partitionBy("query_id").orderBy(*[F.coalesce(k.cast("double"), F.lit(0.0)).desc() for k in keys], F.desc(path), "start_line", "end_line")
    return locations.withColumn("rank", F.row_number().over(order))


def location_labels(locations: DataFrame) -> DataFrame:
    """Adds label (the symbol, at most 160 characters), kind and basis: exact_symbol, body_match, symbol_match or retrieval."""
    label = F.left(F.trim(F.regexp_replace(F.coalesce("qualified", "symbol"), r"\s+", " ")), F.lit(160))
    label = F.when(label != "", label)
    kind = F.when(F.lower("kind").isin("function", "method", "class", "module"), F.lower("kind")).otherwise("unknown")
    outright = (F.col("symbol_hit") > 0) | (F.col("method_hit") > 0) | (F.col("class_hit") > 0) | (F.col("exact") >= 2)
    basis = F.when(outright, "exact_symbol").when(F.col("executable") > 0, "body_match").when(label.isNotNull() | (kind != "unknown"), "symbol_match").otherwise("retrieval")
    return locations.withColumn("basis", F.coalesce(basis, F.lit("retrieval"))).withColumn("label", label).withColumn("kind", kind)


def retry_queries(questions: DataFrame, found: DataFrame, least: int = 2, longest: int = 12) -> DataFrame:
    """query_id, attempt, terms: narrower queries for questions with fewer than ``least`` locations.

    ``questions``: query_id, terms; ``found``: query_id, term that a location already matched.  The first attempt asks for
    the terms nothing matched, the second for the ``longest`` longest of all.
    """
    seen = found.groupBy("query_id").agg(F.collect_set("term").alias("seen"), F.count_distinct("place").alias("places"))
    thin = questions.join(seen, "query_id", "left").where(F.coalesce("places", F.lit(0)) < least)
    none = F.expr("cast(array() as array<string>)")
    rest = F.array_except("terms", F.coalesce("seen", none))
    by_length = F.array_sort("terms", lambda a, b: F.when(F.char_length(a) != F.char_length(b), F.char_length(b) - F.char_length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    asked = F.array(F.struct(F.lit(1).alias("attempt"), rest.alias("terms")), F.struct(F.lit(2).alias("attempt"), F.slice(by_length, 1, longest).alias("terms")))
    rows = thin.select("query_id", F.explode(asked).alias("a")).select("query_id", "a.attempt", "a.terms").where(F.size("terms") > 0)
    return rows


def recall(questions: DataFrame, units: DataFrame, search: Callable[[DataFrame], DataFrame], least: int = 2) -> DataFrame:
    """query_id, chunk_id, score: the best score of each chunk over a question's sub-questions, and over retries where fewer than ``least`` places came.

    ``search`` answers a table of query_id, query with query_id, chunk_id, score; all sub-questions are one table, and all
    retries another, whatever their number.  ``units``: unit_id, content.
    """
    parts = questions.select("query_id", F.posexplode(sub_questions(F.col("query"))).alias("part", "query"))
    first = _asked_as_one(parts, search)
    best = written(first.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), "location-candidates")
    asked = questions.select("query_id", location_terms(F.col("query")).alias("terms"))
    thin = asked.join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < least).drop("n")
    own = best.join(thin, "query_id").join(units.select(F.col("unit_id").alias("chunk_id"), "content"), "chunk_id")
    seen = own.select("query_id", F.col("chunk_id").cast("string").alias("place"), F.explode(F.array_intersect("terms", location_terms(F.col("content")))).alias("term"))
    again = retry_queries(thin, seen, least).select("query_id", F.col("attempt").alias("part"), F.array_join("terms", " ").alias("query"))
    if again.isEmpty():
        return best
    return best.unionByName(_asked_as_one(again, search)).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def _asked_as_one(parts: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Hits of every part (query_id, part, query) under its question."""
    named = written(parts.withColumn("_key", F.concat_ws("#", F.col("query_id").cast("string"), F.col("part").cast("string"))), "location-parts")
    hits = search(named.select(F.col("_key").alias("query_id"), "query"))
    return hits.withColumnRenamed("query_id", "_key").join(named.select("_key", "query_id"), "_key").select("query_id", "chunk_id", "score")


def locate(questions: DataFrame, candidates: DataFrame, symbols: DataFrame, relations: DataFrame, units: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, rank, path, start_line, end_line, chunk_id, label, kind, basis: the places that answer a question.

    ``questions``: query_id, query; ``candidates``: query_id, chunk_id, score of a retrieval over the questions or their
    sub-questions (repeats count by their best score); ``symbols``: symbol, name, qualified, kind, unit_id; ``units``:
    unit_id, path, kind, start_line, end_line, content, symbol.  Retrieved functions and methods, windows of other units,
    and definitions whose names match are ranked together; in rank order a place that overlaps a better one is dropped.
    """
    asked = questions.select("query_id", location_terms(F.col("query")).alias("terms"), hints(F.col("query")).alias("hints"))
    best = candidates.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    own = units.withColumnRenamed("unit_id", "chunk_id")
    rows = written(best.join(own, "chunk_id").join(asked.select("query_id", "terms"), "query_id"), "location-rows")  # units that were retrieved, read by every step
    whole = structural_locations(rows)
    loose = rows.where(~F.coalesce(F.col("kind").isin("function", "method"), F.lit(False)))
    cut = windows(loose).join(loose.select("query_id", "chunk_id", "path", "kind", "symbol", F.col("score").alias("_s")), ["query_id", "chunk_id"])
    cut = cut.select("query_id", "chunk_id", "path", "start_line", "end_line", "kind", "symbol", (F.col("hits") * 100 + F.col("_s")).alias("score"), F.col("hits").alias("matched"), F.col("hits").alias("executable"))
    named = symbol_matches(asked, symbols, relations).where("exact >= 2 or class_hit = 1 or method_hit = 1 or symbol_hit = 1")
    placed = named.join(symbols.select("symbol", "qualified", F.col("unit_id").alias("chunk_id")), "symbol").join(own.select("chunk_id", "path", "start_line", "end_line", "kind"), "chunk_id")
    zero = [F.lit(0).alias(c) for c in ("exact", "class_hit", "method_hit", "symbol_hit", "corroborated")]
    found = whole.unionByName(cut).select("*", F.col("symbol").alias("qualified"), *zero).withColumn("coverage", F.col("matched"))
    more = placed.select(
        "query_id", "chunk_id", "path", "start_line", "end_line", "kind", F.col("qualified").alias("symbol"), F.lit(1000.0).alias("score"), F.col("exact").alias("matched"), F.lit(0).alias("executable"),
        "qualified", "exact", "class_hit", "method_hit", "symbol_hit", "corroborated", F.col("exact").alias("coverage"),
    )
    every = found.unionByName(more).withColumn("compactness", 1 / F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1)))
    ranked = written(location_labels(location_rank(every)), "location-ranks")
    chosen = drop_overlaps(ranked, limit, 2, 3 if limit >= 6 else 2).select("query_id", F.col("rank").alias("_at"))
    kept = ranked.join(chosen, (ranked["query_id"] == chosen["query_id"]) & (F.col("rank") == F.col("_at")), "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "path", "start_line", "end_line", "chunk_id", "label", "kind", "basis")


def windows(candidates: DataFrame, before: int = 6, after: int = 1, whole: int = 24) -> DataFrame:
    """query_id, chunk_id, start_line, end_line, hits: line windows around the lines that share terms with the question.

    ``candidates``: query_id, chunk_id, terms (array), content, start_line.  Lines with more terms choose first; a window
    that overlaps one already chosen is left out.  A unit of at most ``whole`` lines stays whole.  All inside the row.
    """
    lines = F.split("content", r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]")
    scored = F.filter(
        F.transform(lines, lambda x, i: F.struct((-F.size(F.array_intersect(identifier_terms(x), F.col("terms")))).alias("score"), (F.col("start_line") + i).alias("line"))),
        lambda x: x["score"] < 0,
    )
    rows = candidates.select("query_id", "chunk_id", "start_line", (F.col("start_line") + F.size(lines) - 1).alias("last"), F.sort_array(scored).alias("found")).where(F.size("found") > 0)
    window = F.struct(F.greatest(F.col("start_line"), F.lit(0)).alias("start_line"), F.col("last").alias("end_line"), (-F.col("found")[0]["score"]).alias("hits"))
    none = F.expr("cast(array() as array<struct<start_line: int, end_line: int, hits: int>>)")

    def step(chosen: Column, x: Column) -> Column:
        a, b = F.greatest(F.col("start_line"), x["line"] - before).cast("int"), F.least(F.col("last"), x["line"] + after).cast("int")
        clash = F.exists(chosen, lambda w: (a <= w["end_line"]) & (w["start_line"] <= b))
        new = F.struct(a.alias("start_line"), b.alias("end_line"), (-x["score"]).cast("int").alias("hits"))
        return F.when(clash, chosen).otherwise(F.concat(chosen, F.array(new)))

    small = F.col("last") - F.col("start_line") < whole
    picked = F.when(small, F.array(window.cast("struct<start_line: int, end_line: int, hits: int>"))).otherwise(F.aggregate("found", none, step))
    return rows.select("query_id", "chunk_id", F.explode(picked).alias("w")).select("query_id", "chunk_id", "w.*")


def enclosing(windows_: DataFrame, units: DataFrame) -> DataFrame:
    """Windows with every unit of their file whose lines overlap, joined by bins of lines, so a large file is no single task's.

    ``windows_``: key, start_line, end_line and more; ``units``: key, unit, unit_start, unit_end.
    """
    return ranges.overlapping(windows_, units, ["key"], ("start_line", "end_line"), ("unit_start", "unit_end"))


def drop_overlaps(ranked: DataFrame, limit: int, per_file: int = 2, first_file: int | None = None) -> DataFrame:
    """In rank order, ranges that overlap no earlier one of their file, at most ``per_file`` of a file (``first_file`` of the
    first one) and ``limit`` of a question.

    ``ranked``: query_id, path, start_line, end_line, rank.  A fold over a question's ranges, of which there are as many as
    its candidates have windows.
    """
    item = F.struct("rank", "path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))
    listed = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    none = F.slice("items", 1, 0)

    def step(chosen: Column, x: Column) -> Column:
        same = F.filter(chosen, lambda w: w["path"] == x["path"])
        clash = F.exists(same, lambda w: (x["start_line"] <= w["end_line"]) & (w["start_line"] <= x["end_line"]))
        most = F.when(F.get(chosen, F.lit(0))["path"] == x["path"], F.lit(first_file or per_file)).otherwise(F.lit(per_file))
        return F.when(clash | (F.size(same) >= most) | (F.size(chosen) >= limit), chosen).otherwise(F.concat(chosen, F.array(x)))

    return listed.select("query_id", F.explode(F.aggregate("items", none, step)).alias("x")).select("query_id", "x.*")
