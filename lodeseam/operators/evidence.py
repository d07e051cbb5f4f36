"""Packing evidence for questions under token budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.shared import dealt, written
from . import graph


@dataclass(frozen=True)
class Budget:
    total: int = 2400
    file_share: float = 0.5
    item: int = 600
    min_sources: int = 2
    items: int = 12
    #: Candidates of a question that are looked at: the retrieval channels return no more.
    candidates: int = 200

    @property
    def file(self) -> int:
        return max(1, int(self.total * self.file_share))


def selection_order(candidates: DataFrame, min_sources: int) -> DataFrame:
    """Adds selection_rank: the best row of each of the first ``min_sources`` files leads, then priority, score, path, id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("priority"), F.desc("score"), "path", "chunk_id")
    own = Window.partitionBy("query_id", "path")
    placed = candidates.withColumn("_n", F.row_number().over(best))
    placed = placed.withColumn("_k", F.row_number().over(own.orderBy("_n"))).withColumn("_f", F.min("_n").over(own))
    placed = placed.withColumn("_s", F.dense_rank().over(Window.partitionBy("query_id").orderBy("_f")))
    leads = F.when((F.col("_k") == 1) & (F.col("_s") <= min_sources), 0).otherwise(1)
    return placed.withColumn("selection_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(leads, "_n"))).drop("_n", "_k", "_f", "_s")


def normalize_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with tidy paths and content, each place once.

    ``candidates``: query_id, ord (input order), chunk_id, path, start_line, end_line, content, snippet.  Backslashes and
    doubled slashes go, rows without a path are dropped, the snippet stands in for missing content.  Rows of one chunk, or
    without a chunk id of one place (case of the path aside), are one: the first with content, else the first.
    """
    path = F.regexp_replace(F.replace(F.trim("path"), F.lit("\\"), F.lit("/")), "/{2,}", "/")
    content = F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.coalesce("snippet", F.lit("")))
    chunk = F.trim(F.col("chunk_id").cast("string"))
    place = F.concat_ws("\0", F.lower("path"), F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    rows = candidates.withColumn("path", path).withColumn("content", content).where(F.coalesce(F.col("path"), F.lit("")) != "")
    rows = rows.withColumn("_place", F.when(F.coalesce(chunk, F.lit("")) != "", F.concat(F.lit("c"), chunk)).otherwise(F.concat(F.lit("p"), place)))
    order = Window.partitionBy("query_id", "_place").orderBy(F.when(F.trim("content") != "", 0).otherwise(1), "ord")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_place", "snippet")


def _folded(candidates: DataFrame, budget: Budget) -> DataFrame:
    """query_id, all (candidates), looked (at), a (items, left, files, dropped, cut)."""
    ranked = selection_order(candidates, budget.min_sources)
    first = F.col("selection_rank") <= budget.candidates
    item = F.when(first, F.struct("selection_rank", "chunk_id", "path", "tokens"))
    listed = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("all"), F.sort_array(F.collect_list(item)).alias("c"))
    kind = dict(candidates.dtypes)["chunk_id"]
    start = (
        f"named_struct('items', cast(array() as array<struct<chunk_id: {kind}, tokens: bigint, cut: boolean>>), 'left', {budget.total}L, "
        "'files', cast(map() as map<string,bigint>), 'dropped', 0, 'cut', 0)"
    )
    room = f"least(a.left, {budget.item}L, {budget.file}L - coalesce(try_element_at(a.files, x.path), 0L))"
    step = (
        f"if(size(a.items) >= {budget.items} or {room} <= 0, "
        "named_struct('items', a.items, 'left', a.left, 'files', a.files, 'dropped', a.dropped + 1, 'cut', a.cut), "
        f"named_struct('items', concat(a.items, array(named_struct('chunk_id', x.chunk_id, 'tokens', least(x.tokens, {room}), 'cut', x.tokens > {room}))), "
        f"'left', a.left - least(x.tokens, {room}), "
        f"'files', map_concat(map_filter(a.files, (k, v) -> k <> x.path), map(x.path, coalesce(try_element_at(a.files, x.path), 0L) + least(x.tokens, {room}))), "
        f"'dropped', a.dropped, 'cut', a.cut + if(x.tokens > {room}, 1, 0)))"
    )
    return listed.select("query_id", "all", F.size("c").alias("looked"), F.expr(f"aggregate(c, {start}, (a, x) -> {step})").alias("a"))


def pack(candidates: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """query_id, items, tokens, sources, dropped, truncated and the packed chunk ids, in order.

    A greedy pass that skips what does not fit; an item is cut to the item limit and to what total and file have left.  The
    pass is a fold over the question's first candidates, whose number the budget bounds; those beyond count as dropped.
    """
    return _folded(candidates, budget).select(
        "query_id", F.size("a.items").alias("items"), (F.lit(budget.total) - F.col("a.left")).alias("tokens"), F.size(F.map_keys("a.files")).alias("sources"),
        (F.col("a.dropped") + F.col("all") - F.col("looked")).cast("int").alias("dropped"), F.col("a.cut").alias("truncated"),
        F.array_join(F.transform("a.items", lambda i: i["chunk_id"].cast("string")), ",").alias("chunk_ids"),
    )


def pack_texts(candidates: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """query_id, position, chunk_id, path, tokens, cut, text: the packed items with their texts, cut to their allowance."""
    items = _folded(candidates.drop("content"), budget).select("query_id", F.posexplode("a.items").alias("position", "i")).select("query_id", "position", "i.*")
    texts = candidates.select("query_id", "chunk_id", "path", "content")
    text = F.when(F.col("cut"), X.truncate_tokens(F.col("content"), F.col("tokens"))).otherwise(F.col("content"))
    return items.join(texts, ["query_id", "chunk_id"]).select("query_id", (F.col("position") + 1).alias("position"), "chunk_id", "path", "tokens", "cut", text.alias("text"))


def merge_specialists(existing: DataFrame, additions: DataFrame, most: int = 3) -> DataFrame:
    """Candidates with up to ``most`` specialist rows added to each query's.

    Both: query_id, chunk_id, path, start_line, end_line, priority, score, content.  Additions go by priority, score and
    path, the first of each path before all others; those without path or content are passed over.  An addition that is
    there already takes no slot; it replaces the row if its priority is higher.  All of a query's rows meet once.
    """
    columns, key = existing.columns, ["query_id", "chunk_id", "path", "start_line", "end_line"]
    within = lambda *by: Window.partitionBy("query_id", *by)
    best = [F.desc("priority"), F.desc("score"), "path", "chunk_id", "start_line", "end_line"]
    some = additions.where((F.coalesce(F.trim("path"), F.lit("")) != "") & (F.coalesce(F.trim("content"), F.lit("")) != ""))
    both = existing.withColumn("_new", F.lit(False)).unionByName(some.select(*columns).withColumn("_new", F.lit(True)))
    rows = dealt(both, existing.count() + additions.count(), "query_id")
    # rows of a place side by side, its best addition first; the others of its additions go
    place, first = within(*key[1:]), within(*key[1:]).orderBy(F.desc("_new"), *best[:2])
    rows = rows.withColumn("_r", F.row_number().over(first)).withColumn("_add", F.first(F.when(F.col("_new"), F.struct(*columns))).over(first))
    rows = rows.withColumn("_seen", F.bool_or(~F.col("_new")).over(place)).where(~F.col("_new") | (F.col("_r") == 1))
    rows = rows.withColumn("_up", F.coalesce(~F.col("_new") & (F.col("_add.priority") > F.coalesce("priority", F.lit(0))), F.lit(False)))
    rows = rows.withColumn("_any", F.bool_or("_up").over(place))
    rows = rows.withColumn("_k", F.row_number().over(within("_new", "path").orderBy(*best)))
    rows = rows.withColumn("_free", F.col("_new") & ~F.col("_seen"))
    rows = rows.withColumn("_slot", F.row_number().over(within("_free").orderBy(F.when(F.col("_k") == 1, 0).otherwise(1), *best)))
    mine = ~F.col("_new") & (F.col("_up") | ~F.col("_any"))
    kept = rows.where(mine | (F.col("_free") & (F.col("_slot") <= most)))
    return kept.select(*[F.when(F.col("_up"), F.col("_add")[c]).otherwise(F.col(c)).alias(c) for c in columns])


def named_definitions(questions: DataFrame, symbols: DataFrame, units: DataFrame) -> DataFrame:
    """query_id and the stored definition of the symbol that a question names outright, as a candidate.

    Dotted, underscored and inner-capital terms are looked up (exact, dotted suffix, short name), by their last part where
    the whole finds nothing; the first hit with content counts.  ``symbols``: symbol, name, qualified, unit_id.
    """
    term = X.symbol_term(F.col("query"))
    asked = questions.select("query_id", term.alias("query")).where(F.rlike("query", F.lit("[._]|^.+[A-Z]")))
    hits = written(graph.symbol_lookup(asked, symbols, 20), "named-symbols")
    rest = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    short = rest.where(F.contains("query", F.lit("."))).select("query_id", F.element_at(F.split("query", r"\."), -1).alias("query"))
    hits = hits.unionByName(graph.symbol_lookup(short, symbols, 20)).join(symbols.select("symbol", "unit_id"), "symbol")
    found = graph.hydrate(hits.select("query_id", "unit_id", "position"), units, "symbol definition", 1000.0, 2)
    place = hits.select("query_id", F.col("unit_id").alias("chunk_id"), "position").groupBy("query_id", "chunk_id").agg(F.min("position").alias("_p"))
    ranked = found.dropDuplicates(["query_id", "chunk_id"]).join(place, ["query_id", "chunk_id"]).withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("_p", "chunk_id")))
    return ranked.where("_n = 1").drop("_n", "_p")


def references(evidence: DataFrame) -> DataFrame:
    """query_id, refs: array of chunk_id, path, start_line, end_line, reason in order of ``rank``."""
    ref = F.struct("chunk_id", "path", "start_line", "end_line", "reason")
    listed = F.sort_array(F.collect_list(F.struct("rank", ref.alias("ref"))))
    return evidence.groupBy("query_id").agg(F.transform(listed, lambda x: x["ref"]).alias("refs"))
