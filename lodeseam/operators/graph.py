"""Graph operators over edge tables: degrees, neighbourhoods, breadth-first call chains, impact groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.shared import written


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: incident edges, a self-loop once.  ``edges``: edge_id, source, target."""
    ends = edges.select("edge_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, paths, functions, classes (0 without a ``kind``), edges."""
    kind = F.col("kind") if "kind" in nodes.columns else F.lit("")
    of = lambda *names: F.sum(kind.isin(*names).cast("long"))
    names = ("nodes", "paths", "functions", "classes", "edges")
    a = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("path").alias("paths"), of("function", "method").alias("functions"), of("class").alias("classes"))
    b = edges.agg(F.count(F.lit(1)).alias("edges"))
    return a.withColumn("edges", F.lit(0).cast("long")).unionByName(b, allowMissingColumns=True).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def call_chain(edges: DataFrame, roots: DataFrame, direction: str = "callees", depth: int = 3) -> DataFrame:
    """root, source, target, depth: each edge seen from a node at distance depth - 1 of the root.

    ``roots``: root.  Levels are joins of the frontier; a level is written before the next is planned.
    """
    ways = []
    if direction in ("callees", "both"):
        ways.append(edges.select(F.col("source").alias("at"), F.col("target").alias("to"), "source", "target"))
    if direction in ("callers", "both"):
        ways.append(edges.select(F.col("target").alias("at"), F.col("source").alias("to"), "source", "target"))
    steps = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    frontier = visited = roots.select("root", F.col("root").alias("at")).distinct()
    found = None
    for level in range(1, depth + 1):
        seen = written(frontier.join(steps, "at").select("root", "to", "source", "target").distinct(), "chain")
        rows = seen.select("root", "source", "target", F.lit(level).alias("depth"))
        found = rows if found is None else found.unionByName(rows)
        frontier = written(seen.select("root", F.col("to").alias("at")).distinct().join(visited, ["root", "at"], "left_anti"), "frontier")
        if not frontier.limit(1).count():
            break
        visited = visited.unionByName(frontier)
    return found.distinct()


def neighbourhood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, edge_id, other, direction for each of ``nodes`` (node)."""
    out = edges.select(F.col("source").alias("node"), "edge_id", F.col("target").alias("other"), F.lit("out").alias("direction"))
    back = edges.select(F.col("target").alias("node"), "edge_id", F.col("source").alias("other"), F.lit("in").alias("direction"))
    return out.unionByName(back).join(nodes.select("node"), "node", "left_semi")


def impact_groups(definitions: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """symbol, group (definition, caller, reference), item: three equi-joins on the symbol."""
    callers = edges.join(definitions.select(F.col("symbol").alias("target")), "target", "left_semi").select(F.col("target").alias("symbol"), F.lit("caller").alias("group"), F.col("source").alias("item"))
    own = definitions.select("symbol", F.lit("definition").alias("group"), "item")
    refs = mentions.join(definitions.select("symbol"), "symbol", "left_semi").select("symbol", F.lit("reference").alias("group"), "item")
    return own.unionByName(callers).unionByName(refs).distinct()


def search_nodes(nodes: DataFrame, pattern: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes whose name, signature or path holds ``pattern`` (case does not count, % and _ are wildcards), by name."""
    met = F.lit(False)
    for c in ("name", "signature", "path"):
        met = met | F.coalesce(F.ilike(c, F.lit(f"%{pattern}%")), F.lit(False))
    found = nodes.where(met if kind is None else met & (F.col("kind") == kind)).orderBy("name", "node")
    return found if limit is None else found.limit(limit)


def _grams(text: Column, size: int = 3) -> Column:
    """Distinct substrings of one to ``size`` characters."""
    at = lambda n: F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: text.substr(i, F.lit(n))))
    none = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(at(n), none) for n in range(1, size + 1)])))


def rarest_gram(asked: DataFrame, held: DataFrame, size: int = 3) -> DataFrame:
    """``asked`` (query_id, q) with gram: of the substrings of ``size`` characters of q, the one that fewest rows of ``held`` (gram) have.

    A shorter q is its own gram.  A query with a substring that nothing has can match nothing, and goes.  So a query meets
    the rows of its rarest substring only, not those of a prefix that all names share.
    """
    n = F.char_length("q")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.col("q").substr(i, F.lit(size)))
    grams = asked.select("query_id", "q", F.explode(F.array_distinct(cut)).alias("gram"))
    counted = grams.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")), "gram", "left")
    best = counted.groupBy("query_id", "q").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("best"))
    return best.where("best.n > 0").select("query_id", "q", F.col("best.gram").alias("gram"))


def symbol_lookup(queries: DataFrame, symbols: DataFrame, top: int = 5) -> DataFrame:
    """query_id, position, symbol, method for symbols whose name or qualified name holds the query, ``top`` of each.

    ``queries``: query_id, query; ``symbols``: symbol, name, qualified.  The order is: the qualified name itself, a dotted
    suffix of it, the short name, any other; then by qualified name, last first.

    Equal questions and equal names are searched once: what meets are different texts, and of the symbols that share one
    only the first ``top`` can be placed.
    """
    asked = queries.where("query <> ''").select("query_id", F.lower("query").alias("q"))
    alike = Window.partitionBy("n", "u").orderBy("symbol")
    first = symbols.select("symbol", F.lower("name").alias("n"), F.lower("qualified").alias("u")).withColumn("_k", F.row_number().over(alike)).where(F.col("_k") <= top)
    first = written(first.select("symbol", "n", "u"), "symbol-names")
    text = F.concat_ws("\n", "n", "u")
    own = first.select("n", "u").distinct().select("n", "u", F.explode(_grams(text)).alias("gram"))
    hits = own.join(rarest_gram(asked.select(F.col("q").alias("query_id"), "q").distinct(), own), "gram").where(F.contains("n", F.col("q")) | F.contains("u", F.col("q")))
    short = F.element_at(F.split("q", r"\."), -1)
    method = F.when(F.col("u") == F.col("q"), "exact").when(F.endswith("u", F.concat(F.lit("."), F.col("q"))), "suffix").when(F.col("n") == short, "short_name").otherwise("substring")
    rank = F.array_position(F.array(*map(F.lit, ("exact", "suffix", "short_name", "substring"))), F.col("method"))
    # every text has a symbol, so one that as many as ``top`` precede has none to place
    texts = hits.withColumn("method", method).withColumn("_t", F.rank().over(Window.partitionBy("q").orderBy(rank, F.desc("u")))).where(F.col("_t") <= top)
    rows = texts.alias("t").join(first.alias("f"), F.col("t.n").eqNullSafe(F.col("f.n")) & F.col("t.u").eqNullSafe(F.col("f.u"))).select("q", "method", "t.u", "symbol")
    placed = rows.withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy(rank, F.desc("u"), "symbol"))).where(F.col("position") <= top)
    return asked.join(placed, "q").select("query_id", "position", "symbol", "method")


def hydrate(hits: DataFrame, units: DataFrame, reason: str, score: float, priority: int) -> DataFrame:
    """Hits (query_id, unit_id) with their stored path and content, as candidates; those without either are dropped."""
    own = units.where((F.trim("path") != "") & (F.trim("content") != ""))
    return hits.join(own, "unit_id").select(
        "query_id", F.col("unit_id").alias("chunk_id"), "path", "start_line", "end_line", "content", F.lit(reason).alias("reason"), F.lit(score).alias("score"), F.lit(priority).alias("priority")
    )


def is_app_or_test(path: Column) -> Column:
    """Python files of an application or of tests."""
    slashed = F.concat(F.lit("/"), path)
    return F.endswith(path, F.lit(".py")) & (F.contains(slashed, F.lit("/app/")) | F.contains(slashed, F.lit("/tests/")))


def reference_candidates(targets: DataFrame, units: DataFrame, most: int = 20) -> DataFrame:
    """symbol, unit_id, path, score, position: units that call a name, without a resolved edge to it.

    ``targets``: symbol, name, unit_id (of the definition); ``units``: unit_id, path, content.  A unit's called names are
    exploded and joined on the name.  Tests score 900, others 950; at most ``most`` of a symbol, by path and unit.
    """
    called = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*+)\s*+\(")))
    calls = units.where(is_app_or_test(F.col("path"))).select("unit_id", "path", F.explode(called).alias("name"))
    found = calls.join(targets.select("symbol", "name", F.col("unit_id").alias("_own")), "name").where(~F.col("unit_id").eqNullSafe(F.col("_own")))
    order = Window.partitionBy("symbol").orderBy("path", "unit_id")
    placed = found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    score = F.when(F.contains(F.lower("path"), F.lit("test")), 900.0).otherwise(950.0)
    return placed.select("symbol", "unit_id", "path", score.alias("score"), "position")


#: What a path of a test, build or entry file holds.
RUNTIME_MARKS = ("test", "spec", "package.json", "pyproject", "requirements", "main", "app")


def related_tests(impact: DataFrame, files: DataFrame, queries: DataFrame, most: int = 30) -> DataFrame:
    """query_id, path, basis: test, build and entry files among a query's impact paths; for a query without any, its snapshot's first ``most``.

    ``queries``: query_id, snapshot_id; ``impact``: query_id, path; ``files``: snapshot_id, path, is_test.
    """
    low = F.lower("path")
    marked = F.col("is_test")
    for mark in RUNTIME_MARKS:
        marked = marked | F.contains(low, F.lit(mark))
    runtime = files.where(marked).select("snapshot_id", "path")
    hits = queries.join(impact.distinct(), "query_id").join(runtime, ["snapshot_id", "path"]).select("query_id", "path", F.lit("impact").alias("basis"))
    first = runtime.withColumn("_n", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("path"))).where(F.col("_n") <= most)
    rest = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").join(first, "snapshot_id").select("query_id", "path", F.lit("snapshot").alias("basis"))
    return hits.unionByName(rest)


def _ends(relations: DataFrame) -> DataFrame:
    """symbol, relation_id, kind, direction, other: each relation at either end."""
    out = relations.select(F.col("source").alias("symbol"), "relation_id", "kind", F.lit("out").alias("direction"), F.col("target").alias("other"))
    back = relations.select(F.col("target").alias("symbol"), "relation_id", "kind", F.lit("in").alias("direction"), F.col("source").alias("other"))
    return out.unionByName(back)


def listed_symbols(queries: DataFrame, symbols: DataFrame, most: int = 20) -> DataFrame:
    """query_id, position, symbol: the symbols that the term of a question lists, the first ``most`` by qualified name and symbol.

    ``queries``: query_id, query (a question); ``symbols``: symbol, name, qualified and, where there is one, signature.  The
    term (``text.symbol_term``) is sought in all three; case does not count, % and _ are wildcards, and none lists every symbol.

    As in ``symbol_lookup`` equal terms and equal names are searched once.  A term enters by its longest run without
    wildcards; one without such a run meets every name, under the empty substring.
    """
    if "signature" not in symbols.columns:
        symbols = symbols.withColumn("signature", F.lit(None).cast("string"))
    fields = ["name", "qualified", "signature"]
    asked = queries.select("query_id", F.lower(F.trim(F.coalesce(X.symbol_term(F.col("query")), F.lit("")))).alias("q"))
    alike = Window.partitionBy(*fields).orderBy("symbol")
    first = symbols.select("symbol", *fields).withColumn("_k", F.row_number().over(alike)).where(F.col("_k") <= most)
    first = written(first.drop("_k"), "listed-names")
    grams = F.array_union(_grams(F.lower(F.concat_ws("\n", *fields))), F.array(F.lit("")))
    own = first.select(*fields).distinct().select(*fields, F.explode(grams).alias("gram"))
    runs = F.array_sort(F.split("q", "[%_]"), lambda a, b: F.char_length(b) - F.char_length(a))
    entries = rarest_gram(asked.select(F.col("q").alias("query_id"), F.element_at(runs, 1).alias("q")).distinct(), own).select(F.col("query_id").alias("q"), "gram")
    pattern = F.concat(F.lit("%"), F.replace("q", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    met = F.col("q") == ""
    for c in fields:
        met = met | F.coalesce(F.ilike(c, pattern), F.lit(False))
    # every text has a symbol, so one that as many as ``most`` precede has none to place
    texts = own.join(entries, "gram").where(met).withColumn("_t", F.rank().over(Window.partitionBy("q").orderBy("qualified"))).where(F.col("_t") <= most)
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}"))
    rows = texts.alias("t").join(first.alias("f"), same).select("q", "t.qualified", "symbol")
    placed = rows.withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy("qualified", "symbol"))).where(F.col("position") <= most)
    return asked.join(placed, "q").select("query_id", "position", "symbol")


#: Rows of ``structure_view`` that a task makes, about: they are written, not grouped or ranked.
VIEW_ROWS = 2_000_000


def structure_view(queries: DataFrame, symbols: DataFrame, relations: DataFrame, most: int = 20) -> DataFrame:
    """query_id, position, symbol, its place, relation_id, kind, direction, other: the symbols of a question (``listed_symbols``)
    and every relation at each of them (null without any).

    The place is what ``symbols`` has of unit_id, path, start_line and end_line.  A relation between two symbols of a
    question, or of one with itself, has a row at either end.
    """
    place = [c for c in ("unit_id", "path", "start_line", "end_line") if c in symbols.columns]
    hits = written(listed_symbols(queries, symbols, most).join(symbols.select("symbol", *place), "symbol"), "structure-hits")
    ends = written(_ends(relations).join(hits.select("symbol").distinct(), "symbol", "left_semi"), "structure-ends")
    counted = hits.groupBy("symbol").agg(F.count(F.lit(1)).alias("_q")).join(ends.groupBy("symbol").agg(F.count(F.lit(1)).alias("_r")), "symbol", "left")
    n = F.col("_q") * F.coalesce("_r", F.lit(1))
    # a symbol whose rows are too many for a task is dealt to several by its questions, each with all of its relations
    shares = F.greatest(F.least("_q", F.ceil(n / VIEW_ROWS)), F.lit(1))
    counted = written(counted.select("symbol", n.alias("n"), shares.alias("_k")), "structure-counts")
    tasks = max(8, -(-(counted.agg(F.sum("n").alias("n")).first()["n"] or 0) // VIEW_ROWS))
    asked = hits.join(counted.select("symbol", "_k"), "symbol").withColumn("_s", F.pmod(F.xxhash64("query_id"), "_k")).repartition(tasks, "symbol", "_s")
    told = ends.join(counted.select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("_s")), "symbol").repartition(tasks, "symbol", "_s")
    found = asked.join(told, ["symbol", "_s"], "left")
    return found.select("query_id", "position", "symbol", *place, "relation_id", "kind", "direction", "other")


def structure_summary(queries: DataFrame, symbols: DataFrame, relations: DataFrame, most: int = 20) -> DataFrame:
    """query_id, symbol, direction, relations, least: ``structure_view`` counted, with the least symbol at the other end.

    A symbol's relations are counted once, however many queries it answers.
    """
    hits = written(listed_symbols(queries, symbols, most).select("query_id", "symbol"), "structure-hits")
    counted = _ends(relations).join(hits.select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol", "direction").agg(F.count("relation_id").alias("relations"), F.min("other").alias("least"))
    return hits.join(counted, "symbol", "left").select("query_id", "symbol", "direction", F.coalesce("relations", F.lit(0)).alias("relations"), "least")


def impact_evidence(definitions: DataFrame, edges: DataFrame, references: DataFrame, units: DataFrame) -> DataFrame:
    """symbol, group (definition, caller, reference), unit_id, path, score, n: an impact answer with its groups' sizes.

    ``definitions``: symbol, unit_id; ``edges``: source_unit, target (symbol), observed and resolved ones; ``references``:
    as ``reference_candidates`` gives them; ``units``: unit_id, path.
    """
    own = definitions.select("symbol", F.lit("definition").alias("group"), "unit_id", F.lit(1000.0).alias("score"))
    callers = edges.join(definitions.select(F.col("symbol").alias("target")), "target", "left_semi").select(F.col("target").alias("symbol"), F.lit("caller").alias("group"), F.col("source_unit").alias("unit_id"), F.lit(980.0).alias("score"))
    others = references.select("symbol", F.lit("reference").alias("group"), "unit_id", "score")
    rows = own.unionByName(callers).unionByName(others).dropDuplicates(["symbol", "group", "unit_id"]).join(units.select("unit_id", "path"), "unit_id")
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol", "group"))).select("symbol", "group", "unit_id", "path", "score", "n")
