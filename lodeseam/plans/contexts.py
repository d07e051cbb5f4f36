"""Registered queries of context assembly and cohort reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, evaluate, phrases
from ..sources.corpus import chunks, questions, table
from ..sources.shared import written
from . import retrieval


def context_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(context.intents(F.col("text")), ",").alias("intents"))


def _intent_sql() -> str:
    parts = []
    for intent, markers in context.INTENT_MARKERS.items():
        words = [m for m in markers if m.isascii() and m.isalnum()]
        rest = [m for m in markers if m not in words]
        whole = ", ".join(f"'{w}'" for w in words)
        anywhere = " OR ".join(f"contains(low, '{m}')" for m in rest)
        parts.append(f"CASE WHEN list_has_any(terms, [{whole}]) OR {anywhere} THEN ',{intent}' ELSE '' END")
    return " || ".join(parts)


_FORMATS = " OR ".join(f"contains(lower(x), '{m}')" for m in context.FORMAT_MARKERS)
INTENTS_SQL = rf"""WITH f AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS flat FROM conversations),
s AS (SELECT *, string_split(regexp_replace(flat, '([.!?;]) ', '\1' || chr(1), 'g'), chr(1)) AS ss FROM f),
k AS (SELECT conv_id, turn, flat, trim(array_to_string(list_filter(ss, lambda x: NOT ({_FORMATS})), ' ')) AS kept FROM s),
p AS (SELECT conv_id, turn, CASE WHEN kept <> '' THEN kept ELSE flat END AS plain FROM k),
t AS (SELECT conv_id, turn, lower(plain) AS low, string_split(lower(array_to_string(regexp_extract_all(
  regexp_replace(regexp_replace(plain, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '[A-Za-z_][A-Za-z0-9_]*'), '_')), '_') AS terms FROM p)
SELECT conv_id, turn, substr({_intent_sql()}, 2) AS intents FROM t"""


def merge_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels of each question merged into eight rows, the co-occurrence channel as phrases, intents from the question's number."""
    asked = questions(spark, sf_dir).select("query_id", context.question_terms(F.col("query")).alias("terms"))
    kinds = F.array(F.array(F.lit("impact")), F.array(F.lit("test")), F.array(F.lit("behavior")), F.expr("cast(array() as array<string>)"))
    shape = lambda df, origin: df.select("query_id", "chunk_id", "path", F.col("rank").alias("ord"), F.lit(origin).alias("origin"))
    any_term, cooccurring = retrieval.bm25_both_topk(spark, sf_dir)
    both = written(shape(any_term, "primary").unionByName(shape(cooccurring, "phrase")), "merge-candidates")
    found = phrases.sent(both.select("chunk_id").distinct(), both.count())  # only texts of candidates are cut into terms, and none shuffles
    text = chunks(spark, sf_dir).join(found, "chunk_id", "left_semi").select("chunk_id", context.identifier_terms(F.col("content")).alias("own"))
    rows = both.join(asked, "query_id").join(text, "chunk_id").select(
        "query_id", "chunk_id", "path", "ord", "origin", F.element_at(kinds, (F.col("query_id") % 4 + 1).cast("int")).alias("intents"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        F.size(F.array_intersect("terms", "own")).alias("overlap"), (F.col("chunk_id") % 3 == 0).alias("is_impact"), (F.col("chunk_id") % 2 == 0).alias("is_definition"),
    )
    return context.merge_evidence(rows).select("query_id", "position", "chunk_id", "origin", "overlap")


def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as runs: return flag = benchmark, line status = mode, air freight = infrastructure failure."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("benchmark_id"), F.when(F.col("l_linestatus") == "O", "baseline").otherwise("treatment").alias("mode"), (F.col("l_quantity") > 25).alias("passed"),
        (F.col("l_linenumber") == 1).alias("infrastructure_failure"), F.col("l_quantity").cast("long").alias("tokens"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("double")).alias("elapsed_ms"),
    )


_C = """c AS (SELECT l_returnflag AS benchmark_id, CASE WHEN l_linestatus = 'O' THEN 'baseline' ELSE 'treatment' END AS mode, l_quantity > 25 AS passed, l_linenumber = 1 AS infra,
  l_quantity::BIGINT AS tokens, CASE WHEN l_returnflag <> 'R' THEN l_quantity::DOUBLE END AS ms FROM lineitem),
r AS (SELECT benchmark_id, mode, count(*) AS runs, count(*) FILTER (infra) AS infrastructure_failures, round_even(avg(passed::INT) FILTER (NOT infra) * 100, 2) AS pass_rate,
  (sum(tokens) FILTER (NOT infra))::BIGINT AS tokens, CASE WHEN count(ms) = count(*) THEN quantile_disc(ms, 0.5) END AS p50_ms FROM c GROUP BY ALL)"""


def cohort_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cohort_report(_cohorts(spark, sf_dir))


def token_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.percent_saving(evaluate.cohort_report(_cohorts(spark, sf_dir)))


SAVING_SQL = f"""WITH {_C}, b AS (SELECT benchmark_id, sum(tokens) FILTER (mode = 'baseline')::DOUBLE AS b, sum(tokens) FILTER (mode = 'treatment')::DOUBLE AS t FROM r GROUP BY 1)
SELECT benchmark_id, CASE WHEN b <> 0 THEN round_even((b - t) * 100.0 / b, 2) END AS saving FROM b"""


def config_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the JSON properties per event type: rows, distinct keys, the commonest."""
    keys = table(spark, sf_dir, "events").select("event_type", F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("k"))
    each = keys.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("event_type").agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("keys"), F.min(F.struct((-F.col("n")).alias("m"), "k"))["k"].alias("commonest"))


CONFIG_SQL = """WITH k AS (SELECT event_type, unnest(json_keys(props)) AS k FROM events), e AS (SELECT event_type, k, count(*) AS n FROM k GROUP BY ALL)
SELECT event_type, sum(n)::BIGINT AS entries, count(*) AS keys, arg_min(k, (-n, k)) AS commonest FROM e GROUP BY 1"""

QUERIES = {"context_intents": context_intents, "merge_slots": merge_slots, "cohort_report": cohort_report, "token_saving": token_saving, "config_findings": config_findings}
ORACLES = {"context_intents": INTENTS_SQL, "cohort_report": f"WITH {_C} SELECT * FROM r", "token_saving": SAVING_SQL, "config_findings": CONFIG_SQL}
