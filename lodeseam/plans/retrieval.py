"""Registered queries of retrieval and evaluation: lexical, semantic, fusion, scores, paired reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluate, fusion, lexical, semantic
from ..sources.corpus import chunks, questions, table

K = 10
_WORDS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", "query", X.query_terms(F.col("query")).alias("terms"))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised and meaningful terms of every question."""
    meaningful = X.meaningful_terms(F.col("terms"))
    return _terms(spark, sf_dir).select(
        "query_id",
        F.array_join("terms", " ").alias("terms"),
        F.array_join(meaningful, " ").alias("meaningful"),
        X.wants_cooccurrence(F.col("query"), F.col("terms")).alias("cooccurrence"),
    )


_SPLIT = r"regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
_TERMS_CTE = f"""
q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
raw AS (SELECT query_id, query, regexp_extract_all(replace(query, chr(92), '/'), '[㐀-鿿]+|[A-Za-z]+|[0-9]+') AS ts FROM q),
pieces AS (SELECT query_id, query, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM raw),
expanded AS (SELECT query_id, i, 0 AS j, lower(t) AS term FROM pieces
  UNION ALL
  SELECT query_id, i, generate_subscripts(string_split({_SPLIT}, ' '), 1) AS j, lower(unnest(string_split({_SPLIT}, ' '))) AS term
  FROM pieces WHERE contains({_SPLIT}, ' ')),
firsts AS (SELECT query_id, term, min(i * 1000 + j) AS o FROM expanded GROUP BY ALL),
terms AS (SELECT q.query_id, q.query, coalesce(list(term ORDER BY o) FILTER (term IS NOT NULL), []) AS terms
  FROM q LEFT JOIN firsts USING (query_id) GROUP BY ALL)"""
QUERY_TERMS_SQL = f"""
WITH {_TERMS_CTE},
m AS (SELECT *, list_filter(terms, lambda t: length(t) >= 3 AND t NOT IN ({_WORDS})) AS mean FROM terms)
SELECT query_id, array_to_string(terms, ' ') AS terms, array_to_string(mean, ' ') AS meaningful,
  NOT regexp_matches(query, '[_/\\\\.]|\\b[a-z]+[A-Z][A-Za-z0-9]*\\b') AND strlen(query) = length(query) AND len(mean) >= 4 AS cooccurrence
FROM m
"""


def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and weight of every term of the corpus."""
    found = lexical.postings(chunks(spark, sf_dir))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("weight").alias("weight"))


_PATH = "source || '/' || lang || '/' || doc_id || '.txt'"
_CHUNKS_CTE = f"""
ch AS (SELECT doc_id AS chunk_id, {_PATH} AS path, lang AS language, text AS content FROM documents),
fields AS (SELECT chunk_id, content AS v, 4.0 AS w FROM ch UNION ALL SELECT chunk_id, path, 1.0 FROM ch UNION ALL SELECT chunk_id, language, 1.0 FROM ch),
toks AS (SELECT chunk_id, w, unnest(regexp_extract_all(translate(lower(v), '{X.ACCENTED}', '{X.FOLDED}'), '[\\p{{L}}\\p{{N}}]+')) AS term FROM fields),
len AS (SELECT chunk_id, count(*) AS length FROM toks GROUP BY 1),
post AS (SELECT chunk_id, term, sum(w)::DOUBLE AS weight FROM toks GROUP BY ALL)"""
POSTINGS_SQL = f"WITH {_CHUNKS_CTE} SELECT term, count(*) AS n_chunks, sum(weight) AS weight FROM post GROUP BY 1"


def _cooccurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without their full stops, which choose co-occurrence; the first eight meaningful terms count."""
    plain = questions(spark, sf_dir).withColumn("query", F.replace("query", F.lit("."), F.lit("")))
    return plain.select("query_id", F.slice(X.meaningful_terms(X.query_terms(F.col("query"))), 1, 8).alias("terms"))


def _ranked(spark: SparkSession, sf_dir: str, *searches: tuple[DataFrame, int]) -> list[DataFrame]:
    """The ten best chunks of each search (terms, least); the documents are read once for all of them."""
    corpus = chunks(spark, sf_dir)
    paths = corpus.select("snapshot_id", "chunk_id", "path")
    found = [scored.join(paths, ["snapshot_id", "chunk_id"]) for scored in lexical.bm25_tops(list(searches), corpus, 250)]
    return [lexical.two_stage_top_k(scored, F.lit(0.0), K).select("query_id", "rank", "chunk_id", "path", "score") for scored in found]


def bm25_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each question under field-weighted BM25, any term."""
    return _ranked(spark, sf_dir, (_terms(spark, sf_dir), 1))[0]


def bm25_cooccur_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_or_topk where four of the first eight meaningful terms must occur."""
    return _ranked(spark, sf_dir, (_cooccurring(spark, sf_dir), 4))[0]


def bm25_both_topk(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """bm25_or_topk and bm25_cooccur_topk from one reading of the documents."""
    return _ranked(spark, sf_dir, (_terms(spark, sf_dir), 1), (_cooccurring(spark, sf_dir), 4))


def _bm25_sql(asked: str, least: int) -> str:
    times = "1" if least == 1 else "(count(*) - 1) * (count(*) - 2) * (count(*) - 3) / 6.0"
    return f"""
WITH {_TERMS_CTE}, {_CHUNKS_CTE},
asked AS (SELECT query_id, unnest(ts) AS term FROM ({asked}) AS x(query_id, ts)),
st AS (SELECT count(*) AS n_chunks, avg(coalesce(length, 0)) AS mean_length FROM ch LEFT JOIN len USING (chunk_id)),
fr AS (SELECT term, count(*) AS n FROM post GROUP BY 1),
idf AS (SELECT term, CASE WHEN ln((n_chunks - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_chunks - n + 0.5) / (n + 0.5)) END AS idf, mean_length FROM fr, st),
sc AS (SELECT query_id, chunk_id, round(sum(idf * weight * 2.2 / (weight + 1.2 * (0.25 + 0.75 * length / mean_length))) * {times}, 6) AS score
  FROM post JOIN idf USING (term) JOIN asked USING (term) JOIN len USING (chunk_id) GROUP BY ALL HAVING count(*) >= {least}),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, chunk_id) AS rank FROM sc JOIN ch USING (chunk_id))
"""


_MEANINGFUL8 = (
    f"SELECT query_id, list_filter(list(term ORDER BY o), lambda t: length(t) >= 3 AND t NOT IN ({_WORDS}))[1:8] FROM firsts GROUP BY 1"
)
_OUT = " SELECT query_id, rank::INT AS rank, chunk_id, path, score FROM rk WHERE rank <= 10"
BM25_OR_SQL = _bm25_sql("SELECT query_id, terms FROM terms", 1) + _OUT
BM25_COOCCUR_SQL = _bm25_sql(_MEANINGFUL8, 4).replace("SELECT item_id AS query_id, text AS query", "SELECT item_id AS query_id, replace(text, '.', '') AS query") + _OUT


def exact_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boost of every document when asked for by its path, its file name, or its first word."""
    c = chunks(spark, sf_dir)
    word = F.regexp_extract("content", r"^([A-Za-z]+)", 1)
    ask = lambda kind, query: F.struct(F.lit(kind).alias("kind"), query.alias("query"))
    asked = F.array(ask("path", F.col("path")), ask("name", X.file_name(F.col("path"))), ask("word", word))
    rows = c.select("chunk_id", "path", word.alias("symbol"), F.explode(asked).alias("a"))
    boost = lexical.exact_boost(F.col("a.query"), F.col("symbol"), F.lit(""), F.col("path"))
    return rows.select("chunk_id", F.col("a.kind").alias("kind"), boost.alias("boost"))


EXACT_BOOST_SQL = f"""
WITH c AS (SELECT doc_id AS chunk_id, {_PATH} AS path, regexp_extract(text, '^([A-Za-z]+)', 1) AS symbol FROM documents)
SELECT chunk_id, 'path' AS kind, 14.0::DOUBLE AS boost FROM c
UNION ALL SELECT chunk_id, 'name', 10.0::DOUBLE FROM c
UNION ALL SELECT chunk_id, 'word', CASE WHEN symbol = '' THEN 0.0 WHEN regexp_matches(symbol, '[a-z][A-Z]|[A-Z][A-Z][a-z]') THEN 12.0 ELSE 16.0 END::DOUBLE FROM c
"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, item: documents that hold a question's whole text."""
    return evaluate.holders(questions(spark, sf_dir), chunks(spark, sf_dir))


_GOLD_SQL = "SELECT b.item_id AS query_id, d.doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 5 and 10 and reciprocal rank of bm25_or_topk, for questions that some document holds."""
    ranked = bm25_or_topk(spark, sf_dir).select("query_id", F.col("chunk_id").alias("item"), "rank")
    return evaluate.rank_quality(ranked, _gold(spark, sf_dir))


_QUALITY = f"""
gold AS (SELECT DISTINCT * FROM ({_GOLD_SQL})),
sz AS (SELECT query_id, count(*) AS relevant FROM gold GROUP BY 1),
h AS (SELECT g.query_id, rk.rank FROM gold g JOIN rk ON rk.query_id = g.query_id AND rk.chunk_id = g.item AND rk.rank <= 10),
qual AS (SELECT query_id, any_value(relevant) AS relevant, round(count(*) FILTER (rank <= 5) / any_value(relevant), 9) AS recall_5,
  round(count(*) FILTER (rank <= 10) / any_value(relevant), 9) AS recall_10, round(coalesce(1 / min(rank), 0), 9) AS reciprocal_rank
  FROM sz LEFT JOIN h USING (query_id) GROUP BY query_id)"""
RECALL_SQL = BM25_OR_SQL[: -len(_OUT)].rstrip() + "," + _QUALITY + " SELECT * FROM qual"


def recall_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of recall_mrr by the parity of the question and over all."""
    scores = recall_mrr(spark, sf_dir).withColumn("category", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    return evaluate.by_category(scores, "category", ("recall_5", "recall_10", "reciprocal_rank"))


RECALL_CATEGORY_SQL = BM25_OR_SQL[: -len(_OUT)].rstrip() + "," + _QUALITY + """
SELECT coalesce(CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END, 'all') AS category, count(*) AS n, round(avg(recall_5), 9) AS recall_5,
  round(avg(recall_10), 9) AS recall_10, round(avg(reciprocal_rank), 9) AS reciprocal_rank
FROM qual GROUP BY GROUPING SETS ((CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END), ())"""


def citation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of a source's three lowest documents against those of good quality."""
    labels = table(spark, sf_dir, "labels").where("quality = 1")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    gold = docs.join(labels.select("doc_id"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item"))
    low = docs.groupBy("source").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    cited = low.select(F.col("source").alias("query_id"), F.explode(F.slice("ids", 1, 3)).alias("item"))
    return evaluate.citations(cited, gold)


CITATION_SQL = """
WITH r AS (SELECT source AS query_id, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
cited AS (SELECT query_id, item FROM r WHERE n <= 3),
gold AS (SELECT DISTINCT d.source AS query_id, d.doc_id AS item FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1),
c AS (SELECT cited.query_id, count(*) AS cited, count(gold.item) AS rel FROM cited LEFT JOIN gold USING (query_id, item) GROUP BY 1)
SELECT q.query_id, coalesce(cited, 0) AS cited, coalesce(rel, 0) AS relevant_cited, coalesce(rel, 0) > 0 AS hit, round(coalesce(rel / cited, 0), 9) AS precision
FROM (SELECT DISTINCT query_id FROM gold) q LEFT JOIN c USING (query_id)
"""


def task_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every conversation: cited ids are the numbers in its texts, known ids are documents, gold ones are labelled good."""
    turns = table(spark, sf_dir, "conversations")
    numbers = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b([0-9]{1,6})\b")), lambda x: x.cast("long"))
    evidence = turns.select(F.col("conv_id").alias("query_id"), F.explode(numbers).alias("item")).distinct()
    gold = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("item")).distinct()
    return evaluate.completion(
        turns.select(F.col("conv_id").alias("query_id")), evidence, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item")), evidence.join(gold, "item", "left_semi")
    )


COMPLETION_SQL = r"""
WITH ev AS (SELECT DISTINCT conv_id AS query_id, unnest(regexp_extract_all(coalesce(text, ''), '\b([0-9]{1,6})\b', 1))::BIGINT AS item FROM conversations),
s AS (SELECT query_id, bool_or(d.doc_id IS NULL) AS unknown, bool_or(l.doc_id IS NOT NULL) AS met
  FROM ev LEFT JOIN documents d ON d.doc_id = ev.item LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = ev.item GROUP BY 1)
SELECT t.query_id, CASE WHEN s.query_id IS NULL THEN 'refused' WHEN unknown THEN 'citation_path_missing' WHEN NOT met THEN 'relevant_evidence_missing' ELSE 'completed' END AS status
FROM (SELECT DISTINCT conv_id AS query_id FROM conversations) t LEFT JOIN s USING (query_id)
"""


def tool_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user on even events (expected) against odd ones (chosen)."""
    e = table(spark, sf_dir, "events")
    kinds = lambda parity: F.sort_array(F.collect_set(F.when(F.col("event_id") % 2 == parity, F.col("event_type"))))
    found = evaluate.tool_selection(e.groupBy("user_id").agg(kinds(0).alias("expected"), kinds(1).alias("chosen")))
    return found.select("user_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "exact")


TOOLS_SQL = """
WITH u AS (SELECT user_id, event_type, bool_or(event_id % 2 = 0) AS e, bool_or(event_id % 2 = 1) AS c FROM events GROUP BY ALL)
SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (e AND NOT c), '') AS missing,
  coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (c AND NOT e), '') AS extra, bool_and(e = c) AS exact
FROM u GROUP BY 1
"""


def duration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.durations(table(spark, sf_dir, "events"), "value", "event_type")


DURATIONS_SQL = """SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95
FROM events GROUP BY 1"""


def floor_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.floor_index_percentile(table(spark, sf_dir, "events").where("value is not null"), "value", 0.95, "user_id", "event_type")


FLOOR_SQL = """WITH r AS (SELECT user_id, event_type, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n
FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type ORDER BY value))
SELECT user_id, event_type, value AS percentile FROM r WHERE i = floor((n - 1) * 0.95)"""


def calibration_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds on a document's length against its quality label."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.sweep(rows.select((F.col("quality") == 1).alias("positive"), F.col("n_chars").cast("double").alias("score")), [100.0, 500.0, 1000.0, 2000.0, 5000.0])


SWEEP_SQL = """SELECT threshold, count(*) FILTER (quality = 1 AND n_chars < threshold) AS false_refusals, count(*) FILTER (quality <> 1 AND n_chars >= threshold) AS false_accepts,
  round(avg(CASE WHEN (quality = 1) = (n_chars >= threshold) THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM labels JOIN documents USING (doc_id), (VALUES (100.0::DOUBLE), (500.0), (1000.0), (2000.0), (5000.0)) AS t(threshold) GROUP BY 1"""


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return semantic.cosine_top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector"), e, 5)


COSINE_SQL = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0)
SELECT query_id, vec_id, score, rank::INT AS rank FROM r WHERE rank <= 5"""


def embedding_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether an earlier one has the same text: its vector would be reused."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    stored = docs.where("doc_id % 3 = 0").select("content_hash", F.col("doc_id").alias("vector"), F.col("doc_id").alias("created_at"))
    hits, misses = semantic.reuse_cached(docs.where("doc_id % 3 <> 0"), stored)
    return hits.select("doc_id", "content_hash", "vector").unionByName(misses.select(F.lit(None).cast("long").alias("doc_id"), "content_hash", F.lit(None).cast("long").alias("vector")))


CACHE_SQL = """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents),
s AS (SELECT content_hash, max(doc_id) AS vector FROM d WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT doc_id, content_hash, vector FROM d JOIN s USING (content_hash) WHERE doc_id % 3 <> 0
UNION ALL SELECT DISTINCT NULL, content_hash, NULL FROM d WHERE doc_id % 3 <> 0 AND content_hash NOT IN (SELECT content_hash FROM s)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's vector is the one of its number; half of the documents have none."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty documents nearest to each question, whose vector is the one of its number, too."""
    asked = questions(spark, sf_dir).select("query_id").join(_vectors(spark, sf_dir), F.col("query_id") == F.col("vec_id")).select("query_id", "vector")
    own = chunks(spark, sf_dir).select("chunk_id", "path")
    held = own.select("chunk_id").join(_vectors(spark, sf_dir), F.col("chunk_id") == F.col("vec_id")).select(F.col("chunk_id").alias("vec_id"), "vector")
    found = semantic.cosine_top_k(asked, held, 40).withColumnRenamed("vec_id", "chunk_id")
    return found.join(own, "chunk_id").select("query_id", "rank", "chunk_id", "path", "score")


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty best documents of each question, after the boost that an exact hit of its path or first word adds."""
    asked = _terms(spark, sf_dir)
    corpus = chunks(spark, sf_dir)
    named = corpus.select("snapshot_id", "chunk_id", "path", F.regexp_extract("content", r"^([A-Za-z]+)", 1).alias("symbol"))
    scored = lexical.bm25_top(asked, corpus, 250).join(named, ["snapshot_id", "chunk_id"]).join(questions(spark, sf_dir), "query_id")
    boost = lexical.exact_boost(F.col("query"), F.col("symbol"), F.lit(""), F.col("path"))
    found = lexical.two_stage_top_k(scored, boost, 40)
    return found.select("query_id", "rank", "chunk_id", "path", F.col("total").alias("score"), "boost")


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical and the semantic channel of the questions."""
    return fusion.channels(_lexical(spark, sf_dir), _semantic(spark, sf_dir))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(_channels(spark, sf_dir))


_LEXICAL_SQL = BM25_OR_SQL[: -len(_OUT)].rstrip() + """,
sy AS (SELECT query_id, rk.chunk_id, rk.path, rk.score, CASE WHEN lower(trim(q.query)) = lower(regexp_extract(content, '^([A-Za-z]+)', 1)) AND trim(q.query) <> '' THEN 12.0 ELSE 0.0 END::DOUBLE AS boost
  FROM rk JOIN q USING (query_id) WHERE rk.rank <= 200),
bo AS (SELECT *, round(score + boost, 6) AS total FROM sy), lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, path, chunk_id) AS r FROM bo)
SELECT query_id, r::INT AS rank, chunk_id, path, total AS score, boost FROM lr WHERE r <= 40"""
_SEMANTIC_SQL = f"""WITH cs AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings v JOIN documents ON doc_id = v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM cs WHERE score > 0)
SELECT query_id, rank, chunk_id, {_PATH} AS path, score, 0.0::DOUBLE AS boost FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 40"""


def _two_channels(tail: str) -> str:
    return f"""WITH lexi AS ({_LEXICAL_SQL}), sema AS ({_SEMANTIC_SQL}),
channels AS (SELECT 'lexical' AS channel, query_id, rank, chunk_id, path, score, boost FROM lexi UNION ALL SELECT 'semantic', query_id, rank, chunk_id, path, score, boost FROM sema),
fu AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 9) AS rrf, any_value(path) AS path, string_agg(channel, ',' ORDER BY channel) AS signals,
  max(score) FILTER (channel = 'lexical') AS lexical_score, max(score) FILTER (channel = 'semantic') AS semantic_score, max(boost) AS boost FROM channels GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, path, chunk_id)::INT AS position FROM fu){tail}"""


RRF_SQL = _two_channels(" SELECT * FROM fused")


def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision on every question that has a hit."""
    return fusion.gate(fusion.observe(rrf_fuse(spark, sf_dir)), 100.0, 0.51)


_GATE = """, ob AS (SELECT query_id, count(lexical_score) AS lexical_hits, count(semantic_score) AS semantic_hits, max(lexical_score) AS top_lexical,
  max(semantic_score) AS top_semantic, max(rrf) AS top_rrf, max(boost) AS top_boost FROM fused GROUP BY 1),
gated AS (SELECT *, CASE WHEN lexical_hits + semantic_hits = 0 THEN 'not_found' WHEN (lexical_hits > 0 AND (top_boost > 0 OR coalesce(top_lexical, 0) >= LEAST_LEXICAL)) OR (semantic_hits > 0 AND coalesce(top_semantic, -1) >= 0.51) THEN 'accepted' ELSE 'low_relevance' END AS decision,
  CASE WHEN lexical_hits + semantic_hits = 0 THEN 'no_channel_hits' WHEN NOT ((lexical_hits > 0 AND (top_boost > 0 OR coalesce(top_lexical, 0) >= LEAST_LEXICAL)) OR (semantic_hits > 0 AND coalesce(top_semantic, -1) >= 0.51))
  THEN concat_ws('+', CASE WHEN lexical_hits > 0 THEN 'lexical_below_threshold' END, CASE WHEN semantic_hits > 0 THEN 'semantic_below_threshold' END) END AS reason FROM ob)"""
GATE_SQL = _two_channels(_GATE.replace("LEAST_LEXICAL", "100") + " SELECT * FROM gated")


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ten rows of each question over both channels, with their neighbours: a document is linked to the one of twice its number."""
    own = chunks(spark, sf_dir).select("chunk_id", "path")
    links = own.select(F.concat(F.lit("r"), F.col("chunk_id").cast("string")).alias("relation_id"), F.lit("calls").alias("kind"), F.col("chunk_id").alias("source"), (F.col("chunk_id") * 2).alias("target"))
    return fusion.hybrid(_lexical(spark, sf_dir), _semantic(spark, sf_dir), links.join(own.select(F.col("chunk_id").alias("target")), "target", "left_semi"), own, 10)


def hybrid_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels, fusion, gate and expansion with the thresholds that the scores were calibrated for."""
    return _hybrid(spark, sf_dir)[0].withColumn("score", F.round("score", 6))


_EXPANDED = _GATE.replace("LEAST_LEXICAL", "31.4") + """, se AS (SELECT query_id, chunk_id, path, rrf, signals, position FROM fused WHERE position <= 10 AND query_id IN (SELECT query_id FROM gated WHERE decision = 'accepted')),
li AS (SELECT 'r' || doc_id AS relation_id, doc_id AS s, doc_id * 2 AS t FROM documents WHERE doc_id * 2 IN (SELECT doc_id FROM documents)), both_ AS (SELECT relation_id, s AS a, t AS b FROM li UNION ALL SELECT relation_id, t, s FROM li),
re AS (SELECT query_id, b AS chunk_id, min(relation_id) AS relation_id FROM se JOIN both_ ON a = chunk_id WHERE (query_id, b) NOT IN (SELECT (query_id, chunk_id) FROM se) GROUP BY ALL),
le AS (SELECT query_id, min(rrf) AS least, max(position) AS n FROM se GROUP BY 1),
ex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relation_id, chunk_id)::INT AS p FROM re),
al AS (SELECT query_id, position, chunk_id, path, rrf AS score, signals FROM se UNION ALL SELECT query_id, n + p, chunk_id, source || '/' || lang || '/' || doc_id || '.txt', round(0.5 * least / p, 9), 'structural' FROM ex JOIN le USING (query_id) JOIN documents ON doc_id = chunk_id WHERE p <= 40 - n)"""
HYBRID_SQL = _two_channels(_EXPANDED + " SELECT * REPLACE (round(score, 6) AS score) FROM al")


def hybrid_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of the hybrid search gave."""
    return _hybrid(spark, sf_dir)[1]


HYBRID_AUDIT_SQL = _two_channels(_EXPANDED + """, n AS (SELECT query_id, count(*) FILTER (channel = 'lexical') AS lexical, count(*) FILTER (channel = 'semantic') AS semantic FROM channels GROUP BY 1),
c AS (SELECT n.query_id, lexical, semantic, (SELECT count(*) FROM fused f WHERE f.query_id = n.query_id) AS fused, (SELECT count(*) FROM al WHERE al.query_id = n.query_id AND signals = 'structural') AS expanded, (SELECT count(*) FROM al WHERE al.query_id = n.query_id) AS returned FROM n)
SELECT *, 'lexical=' || lexical || ';semantic=' || semantic || ';fused=' || fused || ';expanded=' || expanded || ';returned=' || returned AS events FROM c""")


def fused_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused rows with their fields merged; the semantic channel lacks paths and has the snippets."""
    n = lambda df, path, content: df.withColumn("path", path).withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(2)).withColumn("content", content)
    none = F.lit(None).cast("string")
    a = n(_lexical(spark, sf_dir).where("rank <= 12"), F.col("path"), F.lit("")).withColumn("channel", F.lit("lexical")).drop("boost")
    b = n(_semantic(spark, sf_dir).where("rank <= 12"), none, F.concat(F.lit("text "), F.col("chunk_id").cast("string"))).withColumn("channel", F.lit("semantic"))
    found = fusion.fuse_rows(a.unionByName(b))
    return found.withColumn("source_ranks", F.to_json("source_ranks"))


FIELDS_SQL = _two_channels(""", c AS (SELECT channel, query_id, rank, chunk_id, CASE WHEN channel = 'lexical' THEN path END AS path, CASE WHEN channel = 'semantic' THEN 'text ' || chunk_id END AS content FROM channels WHERE rank <= 12),
g AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 9) AS rrf, max(path) AS path, max(content) AS content, string_agg(channel, ',' ORDER BY channel) AS signals, '{' || string_agg('"' || channel || '":' || rank, ',' ORDER BY channel) || '}' AS source_ranks FROM c GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, path NULLS FIRST, 'c' || chunk_id)::INT AS position, 'c' || chunk_id AS identity, chunk_id, path, 1 AS start_line, content, rrf, signals, source_ranks FROM g""")


def _ab_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cohort rows: benchmark = event type, task = user, one per cohort (the first event of each parity)."""
    e = table(spark, sf_dir, "events").where("value is not null")
    rows = e.groupBy("event_type", "user_id", (F.col("event_id") % 2).alias("parity")).agg(F.min_by(F.struct("value"), "event_id").alias("f"))
    return rows.select(
        F.col("event_type").alias("benchmark_id"),
        F.col("user_id").alias("task_id"),
        F.when(F.col("parity") == 0, "baseline").otherwise("treatment").alias("mode"),
        (F.col("f.value") >= 10).alias("passed"),
        F.floor(F.col("f.value") * 100).alias("tokens"),
    )


def paired_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.paired_report(evaluate.paired(_ab_rows(spark, sf_dir)))


_AB = """WITH r AS (SELECT event_type AS benchmark_id, user_id AS task_id, event_id % 2 AS parity, arg_min(value, event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL),
p AS (SELECT benchmark_id, task_id, bool_or(v >= 10) FILTER (parity = 0) AS bp, bool_or(v >= 10) FILTER (parity = 1) AS tp,
  max(floor(v * 100)::BIGINT) FILTER (parity = 0) AS bt, max(floor(v * 100)::BIGINT) FILTER (parity = 1) AS tt FROM r GROUP BY ALL HAVING count(*) = 2)"""
PAIRED_SQL = _AB + """, g AS (SELECT coalesce(benchmark_id, 'all') AS benchmark_id, count(*) AS tasks, avg(bp::INT) * 100 AS b, avg(tp::INT) * 100 AS t,
  sum(bt) FILTER (bp AND tp)::BIGINT AS bt, sum(tt) FILTER (bp AND tp)::BIGINT AS tt FROM p GROUP BY GROUPING SETS ((benchmark_id), ()))
SELECT benchmark_id, tasks, round_even(b, 2) AS baseline_pass_rate, round_even(t, 2) AS treatment_pass_rate, bt AS baseline_tokens, tt AS treatment_tokens,
  CASE WHEN bt <> 0 THEN round_even((tt - bt) * 100.0::DOUBLE / bt, 2) END AS token_change FROM g"""


def ab_outcome_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = evaluate.paired(_ab_rows(spark, sf_dir)).where("baselines = 1 and treatments = 1")
    return evaluate.outcome_matrix(pairs)


MATRIX_SQL = _AB + " SELECT CASE WHEN bp THEN 'passed' ELSE 'failed' END AS baseline, CASE WHEN tp THEN 'passed' ELSE 'failed' END AS treatment, count(*) AS tasks FROM p GROUP BY ALL"


def acceptance_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = evaluate.paired(_ab_rows(spark, sf_dir)).where("baselines = 1 and treatments = 1")
    actual = pairs.agg(F.count(F.lit(1)).alias("tasks"), F.count_distinct("benchmark_id").alias("benchmarks"), F.round(F.avg(F.col("treatment_passed").cast("int")), 9).alias("pass_rate"))
    return evaluate.gates(actual, {"tasks": 100, "benchmarks": 5, "pass_rate": 0.9})


GATES_SQL = _AB + """, a AS (SELECT count(*)::DOUBLE AS tasks, count(DISTINCT benchmark_id)::DOUBLE AS benchmarks, round(avg(tp::INT), 9) AS pass_rate FROM p)
SELECT 'tasks' AS gate, tasks AS actual, 100.0::DOUBLE AS minimum, tasks >= 100 AS passed FROM a UNION ALL SELECT 'benchmarks', benchmarks, 5.0, benchmarks >= 5 FROM a
UNION ALL SELECT 'pass_rate', pass_rate, 0.9, pass_rate >= 0.9 FROM a"""


def condition_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer that differ in status or priority."""
    return evaluate.mismatches(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


MISMATCH_SQL = """SELECT o_custkey, 'o_orderstatus' AS field, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1
UNION ALL SELECT o_custkey, 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1"""


def location_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as lines of a customer's file: the first rank of a range of ten that holds each gold key."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    lines = o.select(F.col("o_custkey").alias("task_id"), (F.col("o_custkey") % 7).cast("string").alias("path"), "o_orderkey")
    start = F.col("o_orderkey") - F.col("o_orderkey") % 10
    ranges = lines.where("o_orderkey % 2 = 0").select("task_id", "path", start.alias("first_line"), (start + 9).alias("last_line")).distinct()
    from pyspark.sql.window import Window

    ranked = ranges.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("first_line")))
    gold = lines.where("o_orderkey % 2 = 1").select("task_id", "path", F.col("o_orderkey").alias("line"))
    return evaluate.located(ranked, gold)


LOCATION_SQL = """WITH l AS (SELECT o_custkey AS task_id, (o_custkey % 7)::VARCHAR AS path, o_orderkey FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY first_line) AS rank FROM (SELECT DISTINCT task_id, path, o_orderkey - o_orderkey % 10 AS first_line FROM l WHERE o_orderkey % 2 = 0)),
g AS (SELECT task_id, path, o_orderkey AS line FROM l WHERE o_orderkey % 2 = 1)
SELECT g.task_id, g.path, g.line, min(r.rank)::INT AS rank FROM g LEFT JOIN r ON g.task_id = r.task_id AND g.path = r.path AND g.line BETWEEN r.first_line AND r.first_line + 9 GROUP BY ALL"""


def capture_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types and users of even days against odd days, with multiplicity."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", (F.dayofmonth("ts") % 2).alias("odd"))
    side = lambda n: e.where(F.col("odd") == n).select("event_type", "user_id")
    return evaluate.differences(side(0), side(1)).groupBy("side", "event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


DIFF_SQL = """WITH c AS (SELECT event_type, user_id, count(*) FILTER (day(ts) % 2 = 0) AS l, count(*) FILTER (day(ts) % 2 = 1) AS r FROM events GROUP BY ALL)
SELECT 'left' AS side, event_type, user_id, l - r AS n FROM c WHERE l > r UNION ALL SELECT 'right', event_type, user_id, r - l FROM c WHERE r > l"""

QUERIES = {
    "query_terms": query_terms, "postings_stats": postings_stats, "bm25_or_topk": bm25_or_topk, "bm25_cooccur_topk": bm25_cooccur_topk,
    "exact_boost": exact_boost, "recall_mrr": recall_mrr, "recall_by_category": recall_by_category, "citation_quality": citation_quality,
    "task_completion": task_completion, "tool_selection": tool_selection, "duration_summary": duration_summary, "floor_percentile": floor_percentile,
    "calibration_sweep": calibration_sweep, "cosine_topk": cosine_topk, "embedding_cache_join": embedding_cache_join, "rrf_fuse": rrf_fuse,
    "relevance_gate": relevance_gate, "hybrid_end_to_end": hybrid_end_to_end, "hybrid_audit": hybrid_audit, "fused_fields": fused_fields, "paired_ab": paired_ab, "ab_outcome_matrix": ab_outcome_matrix,
    "acceptance_gates": acceptance_gates, "condition_mismatch": condition_mismatch, "location_score": location_score, "capture_diff": capture_diff,
}
ORACLES = {
    "query_terms": QUERY_TERMS_SQL, "postings_stats": POSTINGS_SQL, "bm25_or_topk": BM25_OR_SQL, "bm25_cooccur_topk": BM25_COOCCUR_SQL,
    "exact_boost": EXACT_BOOST_SQL, "recall_mrr": RECALL_SQL, "recall_by_category": RECALL_CATEGORY_SQL, "citation_quality": CITATION_SQL,
    "task_completion": COMPLETION_SQL, "tool_selection": TOOLS_SQL, "duration_summary": DURATIONS_SQL, "floor_percentile": FLOOR_SQL,
    "calibration_sweep": SWEEP_SQL, "cosine_topk": COSINE_SQL, "embedding_cache_join": CACHE_SQL, "rrf_fuse": RRF_SQL,
    "relevance_gate": GATE_SQL, "hybrid_end_to_end": HYBRID_SQL, "hybrid_audit": HYBRID_AUDIT_SQL, "fused_fields": FIELDS_SQL, "paired_ab": PAIRED_SQL, "ab_outcome_matrix": MATRIX_SQL,
    "acceptance_gates": GATES_SQL, "condition_mismatch": MISMATCH_SQL, "location_score": LOCATION_SQL, "capture_diff": DIFF_SQL,
}
