"""Registered queries: phrases by position, tables published together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import phrases
from ..sources import publish
from ..sources.corpus import chunks, questions, table
from ..sources.shared import folder, written


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage word by word, how often and where first."""
    return phrases.phrase_hits(questions(spark, sf_dir), phrases.positions(chunks(spark, sf_dir))).drop("snapshot_id")


_TOKENS = f"regexp_extract_all(translate(lower(coalesce(text, '')), '{X.ACCENTED}', '{X.FOLDED}'), '[\\p{{L}}\\p{{N}}]+')"
PHRASE_SQL = f"""WITH d AS (SELECT doc_id AS chunk_id, {_TOKENS} AS t FROM documents), q AS (SELECT item_id AS query_id, {_TOKENS} AS t FROM benchmark),
p AS (SELECT query_id, chunk_id, q.t AS qt, unnest(range(1, len(d.t) - len(q.t) + 2)) AS i, d.t AS dt FROM d, q WHERE len(q.t) > 0 AND contains(' ' || array_to_string(d.t, ' ') || ' ', ' ' || array_to_string(q.t, ' ') || ' '))
SELECT query_id, chunk_id, count(*) AS hits, (min(i) - 1)::INT AS first FROM p WHERE dt[i : i + len(qt) - 1] = qt GROUP BY ALL"""


def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of two adjoining words of each document's start: hits by the joined word, which no text has, then by phrase."""
    own = chunks(spark, sf_dir)
    words = F.slice(phrases.phrase_tokens(F.col("content")), 1, 2)
    some = own.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), words.alias("words"))
    asked = written(some.where(F.size("words") == 2).select("query_id", F.array_join("words", " ").alias("query")), "phrase-questions")
    held = phrases.positions(own)
    joined = asked.select("query_id", F.replace("query", F.lit(" "), F.lit("")).alias("term"))
    found = written(held.join(phrases.sent(joined, joined.count()), "term").select("query_id", "snapshot_id", "chunk_id").distinct(), "joined-hits")
    return phrases.retry_as_phrase(found, asked, held).select("query_id", "chunk_id", "channel")


FIRST_SQL = f"""WITH d AS (SELECT doc_id AS chunk_id, {_TOKENS} AS t FROM documents), q AS (SELECT chunk_id AS query_id, t[1:2] AS t FROM d WHERE len(t) >= 2 AND chunk_id % 20 = 0),
e AS (SELECT query_id, chunk_id FROM q JOIN d ON list_contains(d.t, q.t[1] || q.t[2])),
p AS (SELECT query_id, chunk_id FROM q JOIN d ON contains(' ' || array_to_string(d.t, ' ') || ' ', ' ' || array_to_string(q.t, ' ') || ' ') WHERE query_id NOT IN (SELECT query_id FROM e))
SELECT query_id, chunk_id, 'terms' AS channel FROM e UNION ALL SELECT query_id, chunk_id, 'phrase' FROM p"""


def published_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their words published as one snapshot a language; one language is then replaced by its upper-case texts."""
    root = f"{folder(spark)}/published-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").withColumn("lang", F.coalesce("lang", F.lit("none")))
    langs = sorted(r[0] for r in docs.select("lang").distinct().collect())  # a handful
    for lang in [*langs, langs[0]] if langs else []:
        own = docs.where(F.col("lang") == lang).select("doc_id", F.when(F.lit(lang == langs[0]), F.upper("text")).otherwise(F.col("text")).alias("text"))
        sizes = own.select("doc_id", F.size(X.index_tokens(F.col("text"))).alias("n_words"))
        publish.publish(spark, {"texts": own, "sizes": sizes}, root, lang)
    texts, sizes = (publish.read_published(spark, root, name) for name in ("texts", "sizes"))
    both = texts.join(sizes, ["snapshot_id", "doc_id"])
    return both.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"), F.sum((F.col("text") == F.upper("text")).cast("long")).alias("n_upper"))


PUBLISHED_SQL = f"""WITH d AS (SELECT coalesce(lang, 'none') AS snapshot_id, text, len({_TOKENS}) AS n FROM documents)
SELECT snapshot_id, count(*) AS n_docs, sum(n) AS n_words, sum((text = upper(text) OR snapshot_id = (SELECT min(snapshot_id) FROM d) AND text IS NOT NULL)::BIGINT) AS n_upper FROM d GROUP BY 1"""

QUERIES = {"phrase_hits": phrase_hits, "phrase_retry": first_match, "published_snapshots": published_snapshots}
ORACLES = {"phrase_hits": PHRASE_SQL, "phrase_retry": FIRST_SQL, "published_snapshots": PUBLISHED_SQL}
