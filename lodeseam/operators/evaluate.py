"""Scores of retrieval runs: recall, reciprocal rank, citations, completion, tools, durations, calibration, gates, A/B."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.shared import dealt, written
from . import ranges


def rank_quality(ranked: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Per query with gold: recall at each cut (share of its distinct relevant items) and reciprocal rank.

    ``ranked``: query_id, item, rank; ``gold``: query_id, item.  A duplicate in a ranking uses up a position.
    """
    gold = gold.select("query_id", "item").distinct()
    size = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    hits = ranked.join(gold, ["query_id", "item"]).groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    found = hits.groupBy("query_id").agg(F.min("rank").alias("first"), *[F.sum((F.col("rank") <= k).cast("int")).alias(f"hits_{k}") for k in cuts])
    return size.join(found, "query_id", "left").select(
        "query_id",
        "relevant",
        *[F.round(F.coalesce(f"hits_{k}", F.lit(0)) / F.col("relevant"), 9).alias(f"recall_{k}") for k in cuts],
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("reciprocal_rank"),
    )


#: Bytes of questions that are sent to every task; more of them meet the chunks by shuffle.
HELD_BYTES = 8 << 20


def holders(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, item: chunks (chunk_id, content) that hold a question's (query_id, query) whole text; a null holds and asks nothing.

    The longest word between two blanks of a question is a word between blanks wherever the question stands, so it finds the
    candidates; a question without one is looked for everywhere.
    """
    words = F.split("query", " ")
    inner = F.array_sort(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda a, b: F.char_length(b) - F.char_length(a))
    asked = questions.where("query is not null").select("query_id", "query", F.get(inner, F.lit(0)).alias("word"))
    texts = chunks.where("content is not null").select(F.col("chunk_id").alias("item"), "content")
    if (asked.agg(F.sum(F.octet_length("query") + 64)).first()[0] or 0) > HELD_BYTES:
        held = F.contains("content", F.col("query"))
        near = texts.select("item", F.explode(F.array_distinct(F.split("content", " "))).alias("word")).join(asked, "word").join(texts, "item").where(held)
        return near.select("query_id", "item").unionByName(texts.join(asked.where("word is null"), held).select("query_id", "item")).distinct()
    of_word: dict[str | None, list[tuple[object, str]]] = {}
    for r in asked.collect():  # at most HELD_BYTES
        of_word.setdefault(r["word"], []).append((r["query_id"], r["query"]))
    anywhere = of_word.pop(None, [])
    out = to_arrow_schema(T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("item", texts.schema["item"].dataType)]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = [], []
            for k, text in enumerate(batch["content"]):
                text = text.as_py()
                for q, query in chain(anywhere, *(of_word[w] for w in of_word.keys() & set(text.split(" ")))):
                    if query in text:
                        ids.append(q)
                        places.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, out.field(0).type), batch["item"].take(pa.array(places, pa.int64())).cast(out.field(1).type)], schema=out)

    return written(texts.mapInArrow(find, from_arrow_schema(out)).distinct(), "holders")


def by_category(scores: DataFrame, category: str, measures: tuple[str, ...]) -> DataFrame:
    """Means per category and over all ('all'), in one pass."""
    grouped = scores.groupingSets([[category], []], category).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 9).alias(m) for m in measures], F.grouping(category).alias("_total"))
    return grouped.select(F.when(F.col("_total") == 1, "all").otherwise(F.col(category).cast("string")).alias(category), "n", *measures)


def citations(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query with gold: distinct citations, those that are relevant, hit flag and precision."""
    cited = cited.select("query_id", "item").distinct()
    both = cited.join(gold.select("query_id", "item").distinct().withColumn("ok", F.lit(1)), ["query_id", "item"], "left")
    counted = both.groupBy("query_id").agg(F.count(F.lit(1)).alias("cited"), F.count("ok").alias("relevant_cited"))
    return gold.select("query_id").distinct().join(counted, "query_id", "left").select(
        "query_id",
        F.coalesce("cited", F.lit(0)).alias("cited"),
        F.coalesce("relevant_cited", F.lit(0)).alias("relevant_cited"),
        (F.coalesce("relevant_cited", F.lit(0)) > 0).alias("hit"),
        F.round(F.coalesce(F.col("relevant_cited") / F.col("cited"), F.lit(0.0)), 9).alias("precision"),
    )


def completion(tasks: DataFrame, evidence: DataFrame, known: DataFrame, gold: DataFrame) -> DataFrame:
    """Per task a status: refused, citation_path_missing, relevant_evidence_missing or completed."""
    missing = evidence.join(known, "item", "left_anti").select("query_id").distinct().withColumn("unknown", F.lit(True))
    met = evidence.join(gold, ["query_id", "item"], "left_semi").select("query_id").distinct().withColumn("met", F.lit(True))
    has = evidence.select("query_id").distinct().withColumn("has", F.lit(True))
    joined = tasks.select("query_id").distinct().join(has, "query_id", "left").join(missing, "query_id", "left").join(met, "query_id", "left")
    status = F.when(F.col("has").isNull(), "refused").when(F.col("unknown"), "citation_path_missing").when(F.col("met").isNull(), "relevant_evidence_missing").otherwise("completed")
    return joined.select("query_id", status.alias("status"))


def tool_selection(rows: DataFrame) -> DataFrame:
    """Adds missing, extra and exact for array columns ``expected`` and ``chosen``."""
    return rows.withColumn("missing", F.sort_array(F.array_except("expected", "chosen"))).withColumn("extra", F.sort_array(F.array_except("chosen", "expected"))).withColumn(
        "exact", (F.size("missing") == 0) & (F.size("extra") == 0)
    )


def durations(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, min, max and nearest-rank p50 and p95 per key.

    Distinct values are counted first and ranked by running counts, so that no task holds a key's rows.
    """
    by = [F.col(k) for k in keys]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*by).orderBy("_v")
    placed = counts.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_c").over(Window.partitionBy(*by)))
    at = lambda q: F.min(F.when(F.col("_upto") >= F.ceil(q * F.col("_all")), F.col("_v")))
    return placed.groupBy(*by).agg(F.max("_all").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), at(F.lit(0.5)).alias("p50"), at(F.lit(0.95)).alias("p95"))


def floor_index_percentile(rows: DataFrame, value: str, q: float, *keys: str) -> DataFrame:
    """The value at index floor((n - 1) q) of the sorted values."""
    order, all_ = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    at = rows.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(all_))
    return at.where(F.col("_i") == F.floor((F.col("_n") - 1) * q)).select(*keys, F.col(value).alias("percentile"))


def sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: false refusals of positives and false accepts of negatives.  ``scored``: score, positive."""
    each = scored.select("positive", "score", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    ok = F.col("score") >= F.col("threshold")
    return each.groupBy("threshold").agg(
        F.sum((F.col("positive") & ~ok).cast("int")).alias("false_refusals"),
        F.sum((~F.col("positive") & ok).cast("int")).alias("false_accepts"),
        F.round(F.avg((F.col("positive") == ok).cast("int")), 9).alias("accuracy"),
    )


def located(returned: DataFrame, gold: DataFrame) -> DataFrame:
    """Per gold location the first rank of a returned range on its path that holds its start line.

    ``returned``: task_id, path, first_line, last_line, rank; ``gold``: task_id, path, line.
    """
    inside = F.col("g.line").between(F.col("r.first_line"), F.col("r.last_line"))
    on = (F.col("g.task_id") == F.col("r.task_id")) & (F.col("g.path") == F.col("r.path")) & inside
    return gold.alias("g").join(returned.alias("r"), on, "left").groupBy("g.task_id", "g.path", "g.line").agg(F.min("r.rank").alias("rank"))


def percent_change(before: Column, after: Column) -> Column:
    return F.bround(F.try_divide((after - before) * 100.0, before), 2)


def paired(rows: DataFrame) -> DataFrame:
    """One row per benchmark and task with both cohorts side by side: ``rows`` has benchmark_id, task_id, mode, passed, tokens."""
    side = lambda mode, c: F.max(F.when(F.col("mode") == mode, F.col(c)))
    return rows.groupBy("benchmark_id", "task_id").agg(
        *[side(m, c).alias(f"{m}_{c}") for m in ("baseline", "treatment") for c in ("passed", "tokens")],
        F.sum((F.col("mode") == "baseline").cast("int")).alias("baselines"),
        F.sum((F.col("mode") == "treatment").cast("int")).alias("treatments"),
    )


def paired_report(pairs: DataFrame) -> DataFrame:
    """Per benchmark and over all: pass rates, tokens where both passed, change in percent."""
    pairs = pairs.where("baselines = 1 and treatments = 1")
    both = F.col("baseline_passed") & F.col("treatment_passed")
    grouped = pairs.groupingSets([["benchmark_id"], []], "benchmark_id").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.bround(F.avg(F.col("baseline_passed").cast("int")) * 100, 2).alias("baseline_pass_rate"),
        F.bround(F.avg(F.col("treatment_passed").cast("int")) * 100, 2).alias("treatment_pass_rate"),
        F.sum(F.when(both, F.col("baseline_tokens"))).alias("baseline_tokens"),
        F.sum(F.when(both, F.col("treatment_tokens"))).alias("treatment_tokens"),
        F.grouping("benchmark_id").alias("_total"),
    )
    return grouped.select(
        F.when(F.col("_total") == 1, "all").otherwise(F.col("benchmark_id").cast("string")).alias("benchmark_id"),
        "tasks", "baseline_pass_rate", "treatment_pass_rate", "baseline_tokens", "treatment_tokens",
        percent_change(F.col("baseline_tokens"), F.col("treatment_tokens")).alias("token_change"),
    )


def outcome_matrix(pairs: DataFrame) -> DataFrame:
    word = lambda c: F.when(F.col(c), "passed").otherwise("failed")
    return pairs.groupBy(word("baseline_passed").alias("baseline"), word("treatment_passed").alias("treatment")).agg(F.count(F.lit(1)).alias("tasks"))


def gates(actual: DataFrame, minima: dict[str, float]) -> DataFrame:
    """One row per gate for a one-row frame of measures: gate, actual, minimum, passed."""
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("actual"), F.lit(float(m)).alias("minimum")) for g, m in minima.items()])
    return actual.select(F.explode(rows).alias("g")).select("g.*", (F.col("g.actual") >= F.col("g.minimum")).alias("passed"))


def mismatches(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Conditions with more than one value within a key: key, field, n_values."""
    pairs = ", ".join(f"'{f}', cast({f} as string)" for f in fields)
    return rows.selectExpr(key, f"stack({len(fields)}, {pairs}) as (field, value)").groupBy(key, "field").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def regression(actual: DataFrame, frozen: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """metric, actual, frozen and ok for two frames of metric, value."""
    a, b = actual.select("metric", F.col("value").alias("actual")), frozen.select("metric", F.col("value").alias("frozen"))
    return a.join(b, "metric", "full_outer").withColumn("ok", F.coalesce(F.abs(F.col("actual") - F.col("frozen")) <= tolerance, F.lit(False)))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two captures has, with multiplicity: side and the row."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def cohort_report(rows: DataFrame) -> DataFrame:
    """Per benchmark and mode: runs, infrastructure failures, pass rate without them, tokens, and p50 latency if every run has one.

    ``rows``: benchmark_id, mode, passed, infrastructure_failure, tokens, elapsed_ms.
    """
    counted = ~F.col("infrastructure_failure")
    p50 = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY elapsed_ms)")
    return rows.groupBy("benchmark_id", "mode").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(F.col("infrastructure_failure").cast("int")).alias("infrastructure_failures"),
        F.bround(F.avg(F.when(counted, F.col("passed").cast("int"))) * 100, 2).alias("pass_rate"),
        F.sum(F.when(counted, F.col("tokens"))).alias("tokens"),
        F.when(F.count("elapsed_ms") == F.count(F.lit(1)), p50).alias("p50_ms"),
    )


def percent_saving(report: DataFrame) -> DataFrame:
    """benchmark_id and the percent of tokens that the treatment saves, null on a zero base."""
    side = lambda m: F.sum(F.when(F.col("mode") == m, F.col("tokens")))
    both = report.groupBy("benchmark_id").agg(side("baseline").alias("b"), side("treatment").alias("t"))
    return both.select("benchmark_id", F.bround(F.try_divide((F.col("b") - F.col("t")) * 100.0, F.col("b")), 2).alias("saving"))


def parameter_pass_rate(calls: DataFrame, *keys: str) -> DataFrame:
    """keys, calls, valid, rate: share of tool calls whose parameters were valid; rate 0 without calls.  ``calls``: keys, valid."""
    ok = F.sum(F.coalesce(F.col("valid"), F.lit(False)).cast("long"))
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), ok.alias("valid"), F.round(ok / F.count(F.lit(1)), 9).alias("rate"))


def location_summary(scored: DataFrame, *keys: str) -> DataFrame:
    """keys, tasks, pass_rate, coverage, mrr, p50_ms, p95_ms.  ``scored``: keys, passed, coverage, reciprocal_rank, duration_ms.

    Percentiles are the value at index floor((n - 1) q).
    """
    means = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks"), F.round(F.avg(F.col("passed").cast("int")), 9).alias("pass_rate"), F.round(F.avg("coverage"), 9).alias("coverage"), F.round(F.avg("reciprocal_rank"), 9).alias("mrr")
    )
    timed = scored.where("duration_ms is not null")
    for q, name in ((0.5, "p50_ms"), (0.95, "p95_ms")):
        means = means.join(floor_index_percentile(timed, "duration_ms", q, *keys).withColumnRenamed("percentile", name), list(keys), "left")
    return means


def group_coverage(required: DataFrame, returned: DataFrame) -> DataFrame:
    """task_id, groups, covered, passed: evidence groups of a task of which any alternative overlaps a returned range.

    ``required``: task_id, group_id, path, start_line, end_line (alternatives); ``returned``: task_id, path, start_line,
    end_line.  Joined by task, path and bins of lines.
    """
    r = returned.select("task_id", "path", F.col("start_line").alias("_from"), F.col("end_line").alias("_to"))
    hits = ranges.overlapping(required, r, ["task_id", "path"], ("start_line", "end_line"), ("_from", "_to"))
    hits = hits.select("task_id", "group_id").distinct().withColumn("_hit", F.lit(True))
    groups = required.select("task_id", "group_id").distinct().join(hits, ["task_id", "group_id"], "left")
    covered = F.sum(F.coalesce("_hit", F.lit(False)).cast("int"))
    return groups.groupBy("task_id").agg(F.count(F.lit(1)).alias("groups"), covered.alias("covered"), (covered == F.count(F.lit(1))).alias("passed"))


def tool_audit(required: DataFrame, evidence: DataFrame) -> DataFrame:
    """tool, task_id, groups, covered, passed for each tool's evidence and for their union, side by side.

    ``evidence``: tool, task_id, path, start_line, end_line.  A task without any evidence of a tool is not covered by it.
    """
    tools = evidence.select("tool").distinct().unionByName(evidence.sparkSession.range(1).select(F.lit("union").alias("tool"))).distinct()
    both = evidence.unionByName(evidence.withColumn("tool", F.lit("union")))
    task = lambda df: df.withColumn("task_id", F.concat_ws("\0", "tool", F.col("task_id").cast("string")))
    each = required.withColumn("_k", F.lit(1)).join(tools.withColumn("_k", F.lit(1)), "_k").drop("_k")  # a handful of tools
    scored = group_coverage(task(each), task(both))
    parts = F.split("task_id", "\0")
    return scored.select(parts[0].alias("tool"), parts[1].alias("task_id"), "groups", "covered", "passed")


def symbol_checks(tasks: DataFrame, returned: DataFrame) -> DataFrame:
    """task_id, paths_met, symbol_met, roles_met.  ``tasks``: task_id, paths, symbol, roles; ``returned``: task_id, path, symbol, role.

    Every required path and role must occur; a symbol is met by one that is it or ends in it after a dot.
    """
    seen = returned.groupBy("task_id").agg(F.collect_set("path").alias("_p"), F.collect_set("symbol").alias("_s"), F.collect_set("role").alias("_r"))
    rows = tasks.join(seen, "task_id", "left")
    none = F.expr("cast(array() as array<string>)")
    met = lambda want, got: F.size(F.array_except(want, F.coalesce(got, none))) == 0
    symbol = F.exists(F.coalesce("_s", none), lambda s: (s == F.col("symbol")) | F.endswith(s, F.concat(F.lit("."), F.col("symbol"))))
    return rows.select("task_id", met("paths", "_p").alias("paths_met"), F.when(F.coalesce("symbol", F.lit("")) == "", True).otherwise(symbol).alias("symbol_met"), met("roles", "_r").alias("roles_met"))


def status_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """benchmark_id, mode, field, value, n: how often each value of each column occurs in a cohort; nulls are not counted."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select("benchmark_id", "mode", named.alias("x")).where("x.value is not null").groupBy("benchmark_id", "mode", "x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def violations(rows: DataFrame, known: DataFrame | None = None, counters: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """code, benchmark_id, task_id: what makes result rows unfit for a report.

    duplicate_row (a mode twice), missing_cohort, negative_or_missing_<counter>, unsafe_path, and, where ``known`` lists the
    tasks (benchmark_id, task_id), unknown_task and missing_task.
    """
    key = ["benchmark_id", "task_id"]
    n = rows.count()
    modes = dealt(rows.select(*key, "mode"), n, *key).groupBy(*key, "mode").agg(F.count(F.lit(1)).alias("n"))
    tasks = modes.groupBy(*key).agg(F.collect_set("mode").alias("m"), F.sum((F.col("n") > 1).cast("long")).alias("twice"))
    has, codes = F.col("twice").isNotNull(), [F.array_repeat(F.lit("duplicate_row"), F.coalesce("twice", F.lit(0)).cast("int"))]
    lacking = has & ~(F.array_contains("m", "baseline") & F.array_contains("m", "treatment"))
    met = [(lacking, "missing_cohort")]
    if known is not None:
        tasks = tasks.join(dealt(known.select(*key), n, *key).distinct().withColumn("_known", F.lit(True)), key, "full_outer")
        met += [(F.col("_known").isNull(), "unknown_task"), (~has, "missing_task")]
    codes.append(F.filter(F.array(*[F.when(some, F.lit(code)) for some, code in met]), lambda c: c.isNotNull()))
    out = tasks.select(F.explode(F.concat(*codes)).alias("code"), *key)
    for c in counters:
        out = out.unionByName(rows.where(F.coalesce(F.col(c), F.lit(-1)) < 0).select(F.lit(f"negative_or_missing_{c}").alias("code"), *key))
    if path is not None:
        out = out.unionByName(rows.where(F.col(path).isNotNull() & X.safe_path(F.col(path)).isNull()).select(F.lit("unsafe_path").alias("code"), *key))
    return out


def before_after(before: DataFrame, after: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """metric, before, after, change: two frames of per-query measures, by their means."""

    def means(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.round(F.avg(m), 9).alias(m) for m in measures])
        listed = ", ".join(f"'{m}', {m}" for m in measures)
        return one.selectExpr(f"stack({len(measures)}, {listed}) as (metric, `{name}`)")

    return means(before, "before").join(means(after, "after"), "metric").withColumn("change", F.round(F.col("after") - F.col("before"), 6))


def trace_shape(steps: DataFrame) -> DataFrame:
    """trace_id, kinds (in order), tools, paths (sorted sets): what two captures of one trace must share.  ``steps``: trace_id, step, kind, tool, path."""
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("step", "kind"))), lambda x: x["kind"])
    return steps.groupBy("trace_id").agg(
        F.array_join(kinds, ">").alias("kinds"), F.array_join(F.sort_array(F.collect_set("tool")), ",").alias("tools"), F.array_join(F.sort_array(F.collect_set("path")), ",").alias("paths")
    )


def cited_files(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, files (sorted, comma-joined), passed (all relevant ones cited) for every query with gold."""
    own = cited.groupBy("query_id").agg(F.collect_set("path").alias("_c"))
    rows = gold.groupBy("query_id").agg(F.collect_set("path").alias("_g")).join(own, "query_id", "left")
    none = F.expr("cast(array() as array<string>)")
    have = F.coalesce("_c", none)
    return rows.select("query_id", F.array_join(F.sort_array(have), ",").alias("files"), (F.size(F.array_except("_g", have)) == 0).alias("passed"))


def stage_times(stages: DataFrame, totals: DataFrame) -> DataFrame:
    """run_id, stage, ms, share (percent of the run), with a row for what no stage accounts for.  ``stages``: run_id, stage, ms; ``totals``: run_id, ms."""
    named = stages.groupBy("run_id", "stage").agg(F.sum("ms").alias("ms"))
    known = named.groupBy("run_id").agg(F.sum("ms").alias("_k"))
    whole = totals.select("run_id", F.col("ms").alias("_all"))
    rest = whole.join(known, "run_id", "left").select("run_id", F.lit("unattributed").alias("stage"), F.greatest(F.col("_all") - F.coalesce("_k", F.lit(0)), F.lit(0)).alias("ms"))
    rows = named.unionByName(rest.select("run_id", "stage", F.col("ms").cast(dict(named.dtypes)["ms"]).alias("ms"))).join(whole, "run_id")
    return rows.select("run_id", "stage", "ms", F.bround(F.try_divide(100 * F.col("ms").cast("double"), F.col("_all")), 2).alias("share"))


def capture_metrics(queries: DataFrame) -> DataFrame:
    """capture_id, queries, recall_5, recall_10, mrr, hit_rate, tool_match, p50_ms, complete: one row per capture.

    ``queries``: capture_id, query_id, ranked, relevant, cited, chosen, expected (arrays) and duration_ms.  cited, the pair
    chosen and expected, and duration_ms may be absent, but for all queries of a capture or none; ``complete`` tells whether
    that holds, and a member that some queries lack gives no measure.
    """
    n = F.count(F.lit(1))
    share = lambda k: F.try_divide(F.size(F.array_intersect(F.slice("ranked", 1, k), "relevant")), F.size(F.array_distinct("relevant")))
    first = F.array_min(F.transform(F.array_distinct("relevant"), lambda r: F.when(F.array_position("ranked", r) > 0, F.array_position("ranked", r))))
    every = lambda c: F.count(c) == n
    all_or_none = lambda c: F.count(c).isin(0) | every(c)
    mean = lambda c: F.round(F.avg(c), 9)
    hit = F.arrays_overlap("cited", "relevant").cast("int")
    match = (F.sort_array(F.array_distinct("chosen")) == F.sort_array(F.array_distinct("expected"))).cast("int")
    return queries.groupBy("capture_id").agg(
        n.alias("queries"), mean(F.coalesce(share(5), F.lit(0.0))).alias("recall_5"), mean(F.coalesce(share(10), F.lit(0.0))).alias("recall_10"), mean(F.coalesce(1 / first, F.lit(0.0))).alias("mrr"),
        F.when(every("cited"), mean(hit)).alias("hit_rate"), F.when(every("chosen") & every("expected"), mean(match)).alias("tool_match"),
        F.when(every("duration_ms"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_ms)")).alias("p50_ms"),
        (all_or_none("cited") & all_or_none("chosen") & all_or_none("expected") & (F.count("chosen") == F.count("expected")) & all_or_none("duration_ms")).alias("complete"),
    )


def provenance_gaps(rows: DataFrame) -> DataFrame:
    """benchmark_id, task_id, mode, code: rows of a token report without a known origin of their counters or a digest of their trace."""
    code = F.when(~F.coalesce("usage_provenance", F.lit("")).isin("provider", "tokenizer"), "unknown_provenance").when(~F.rlike(F.coalesce("raw_trace_sha256", F.lit("")), F.lit("^[0-9a-f]{64}$")), "no_trace_digest")
    return rows.select("benchmark_id", "task_id", "mode", code.alias("code")).where("code is not null")
