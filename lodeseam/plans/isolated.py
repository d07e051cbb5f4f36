"""Registered searches over several snapshots at once: each language's documents are a snapshot of their own.

Ranks, frequencies, lengths, fusion, gate and expansion of one snapshot must not see another's rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, fusion, lexical, semantic
from ..sources.corpus import chunks, questions
from ..sources.shared import folder
from . import retrieval as R


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).withColumn("snapshot_id", F.coalesce("language", F.lit("")))


def _found(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    own = _chunks(spark, sf_dir)
    scored = lexical.bm25_top(R._terms(spark, sf_dir), own, 250).join(own.select("snapshot_id", "chunk_id", "path"), ["snapshot_id", "chunk_id"])
    return lexical.two_stage_top_k(scored, F.lit(0.0), k).select("snapshot_id", "query_id", "rank", "chunk_id", "path", "score")


def bm25_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each question in each snapshot."""
    return _found(spark, sf_dir, 10)


_SCORED_SQL = f"""
WITH {R._TERMS_CTE}, {R._CHUNKS_CTE},
sn AS (SELECT doc_id AS chunk_id, coalesce(lang, '') AS snapshot_id FROM documents),
asked AS (SELECT query_id, unnest(terms) AS term FROM terms),
st AS (SELECT snapshot_id, count(*) AS n_chunks, avg(coalesce(length, 0)) AS mean_length FROM sn LEFT JOIN len USING (chunk_id) GROUP BY 1),
fr AS (SELECT snapshot_id, term, count(*) AS n FROM post JOIN sn USING (chunk_id) GROUP BY ALL),
idf AS (SELECT snapshot_id, term, CASE WHEN ln((n_chunks - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_chunks - n + 0.5) / (n + 0.5)) END AS idf, mean_length FROM fr JOIN st USING (snapshot_id)),
sc AS (SELECT snapshot_id, query_id, chunk_id, round(sum(idf * weight * 2.2 / (weight + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score
  FROM post JOIN sn USING (chunk_id) JOIN idf USING (snapshot_id, term) JOIN asked USING (term) JOIN len USING (chunk_id) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, query_id ORDER BY score DESC, path, chunk_id)::INT AS rank FROM sc JOIN ch USING (chunk_id))
"""
BM25_SQL = _SCORED_SQL + " SELECT snapshot_id, query_id, rank, chunk_id, path, score FROM rk WHERE rank <= 10"


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _chunks(spark, sf_dir).select("snapshot_id", "chunk_id", "path")
    vectors = R._vectors(spark, sf_dir)
    asked = questions(spark, sf_dir).select("query_id").join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", "vector")
    asked = own.select("snapshot_id").distinct().join(F.broadcast(asked))  # every question of every snapshot
    held = own.select("snapshot_id", F.col("chunk_id").alias("vec_id")).join(vectors, "vec_id")
    found = semantic.cosine_top_k(asked, held, 20).withColumnRenamed("vec_id", "chunk_id")
    return found.join(own, ["snapshot_id", "chunk_id"]).select("snapshot_id", "query_id", "rank", "chunk_id", "path", "score")


def hybrid_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels of each question in each snapshot, fused, gated and expanded within it: documents are linked to the one of twice their number."""
    own = _chunks(spark, sf_dir).select("snapshot_id", "chunk_id", "path")
    links = own.select("snapshot_id", F.concat(F.lit("r"), F.col("chunk_id").cast("string")).alias("relation_id"), F.lit("calls").alias("kind"), F.col("chunk_id").alias("source"), (F.col("chunk_id") * 2).alias("target"))
    links = links.join(own.select("snapshot_id", F.col("chunk_id").alias("target")), ["snapshot_id", "target"], "left_semi")
    rows, _ = fusion.hybrid(_found(spark, sf_dir, 20), _semantic(spark, sf_dir), links, own, 5, least_lexical=31.4)
    return rows.withColumn("score", F.round("score", 6))


HYBRID_SQL = f"""WITH lexi AS ({_SCORED_SQL} SELECT snapshot_id, query_id, rank, chunk_id, path, score FROM rk WHERE rank <= 20),
sn AS (SELECT doc_id AS chunk_id, coalesce(lang, '') AS snapshot_id, {R._PATH} AS path FROM documents),
cs AS (SELECT sn.snapshot_id, q.vec_id AS query_id, v.vec_id AS chunk_id, path, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings v JOIN sn ON sn.chunk_id = v.vec_id),
sema AS (SELECT snapshot_id, query_id, row_number() OVER (PARTITION BY snapshot_id, query_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, path, score FROM cs WHERE score > 0),
channels AS (SELECT 'lexical' AS channel, * FROM lexi UNION ALL SELECT 'semantic', * FROM sema WHERE rank <= 20),
fu AS (SELECT snapshot_id, query_id, chunk_id, round(sum(1 / (60 + rank)), 9) AS rrf, any_value(path) AS path, string_agg(channel, ',' ORDER BY channel) AS signals,
  max(score) FILTER (channel = 'lexical') AS ls, max(score) FILTER (channel = 'semantic') AS ss FROM channels GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, query_id ORDER BY rrf DESC, path, chunk_id)::INT AS position FROM fu),
ok AS (SELECT snapshot_id, query_id FROM fused GROUP BY ALL HAVING max(ls) >= 31.4 OR max(ss) >= 0.51),
se AS (SELECT fused.* FROM fused JOIN ok USING (snapshot_id, query_id) WHERE position <= 5),
li AS (SELECT a.snapshot_id, 'r' || a.chunk_id AS relation_id, a.chunk_id AS s, b.chunk_id AS t FROM sn a JOIN sn b ON a.snapshot_id = b.snapshot_id AND b.chunk_id = a.chunk_id * 2),
both_ AS (SELECT snapshot_id, relation_id, s AS a, t AS b FROM li UNION ALL SELECT snapshot_id, relation_id, t, s FROM li),
re AS (SELECT se.snapshot_id, query_id, b AS chunk_id, min(relation_id) AS relation_id FROM se JOIN both_ ON both_.snapshot_id = se.snapshot_id AND a = chunk_id
  WHERE NOT EXISTS (SELECT 1 FROM se x WHERE x.snapshot_id = se.snapshot_id AND x.query_id = se.query_id AND x.chunk_id = b) GROUP BY ALL),
le AS (SELECT snapshot_id, query_id, min(rrf) AS least, max(position) AS n FROM se GROUP BY ALL),
ex AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, query_id ORDER BY relation_id, chunk_id)::INT AS p FROM re)
SELECT snapshot_id, query_id, position, chunk_id, path, round(rrf, 6) AS score, signals FROM se
UNION ALL SELECT snapshot_id, query_id, n + p, chunk_id, path, round(round(0.5 * least / p, 9), 6), 'structural' FROM ex JOIN le USING (snapshot_id, query_id) JOIN sn USING (snapshot_id, chunk_id) WHERE p <= 20 - n
"""

def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots' chunks with a title of three words and a symbol of one."""
    words = F.slice(F.split(F.coalesce("content", F.lit("")), " "), 1, 3)
    return _chunks(spark, sf_dir).withColumn("title", F.array_join(words, " ")).withColumn("symbol", F.regexp_extract(F.coalesce("content", F.lit("")), r"^([A-Za-z]+)", 1))


def bm25_indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each question in each snapshot, from a written index of five fields."""
    own = _fields(spark, sf_dir)
    path = f"{folder(spark)}/index-{uuid.uuid4().hex}"
    lexical.build_index(own, path)
    scored = lexical.bm25_indexed_top(R._terms(spark, sf_dir), path, 50).join(own.select("snapshot_id", "chunk_id", "path"), ["snapshot_id", "chunk_id"])
    return lexical.two_stage_top_k(scored, F.lit(0.0), 10).select("snapshot_id", "query_id", "rank", "chunk_id", "path", "score")


def bm25_blocks_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_snapshots from a written index of blocks, where those that cannot hold one of the best are not scored."""
    own = _chunks(spark, sf_dir)
    path = f"{folder(spark)}/blocks-{uuid.uuid4().hex}"
    blocks.build(own, path, slots=16)
    scored = blocks.top(R._terms(spark, sf_dir), path, 50).join(own.select("snapshot_id", "chunk_id", "path"), ["snapshot_id", "chunk_id"])
    return lexical.two_stage_top_k(scored, F.lit(0.0), 10).select("snapshot_id", "query_id", "rank", "chunk_id", "path", "score")


INDEXED_SQL = _SCORED_SQL.replace(
    "UNION ALL SELECT chunk_id, language, 1.0 FROM ch)",
    "UNION ALL SELECT chunk_id, language, 1.0 FROM ch UNION ALL SELECT chunk_id, array_to_string(string_split(coalesce(content, ''), ' ')[1:3], ' '), 1.5 FROM ch UNION ALL SELECT chunk_id, regexp_extract(coalesce(content, ''), '^([A-Za-z]+)', 1), 2.0 FROM ch)",
) + " SELECT snapshot_id, query_id, rank, chunk_id, path, score FROM rk WHERE rank <= 10"

QUERIES = {"bm25_blocks_topk": bm25_blocks_topk, "bm25_indexed_topk": bm25_indexed_topk, "bm25_snapshots": bm25_snapshots, "hybrid_snapshots": hybrid_snapshots}
ORACLES = {"bm25_blocks_topk": BM25_SQL, "bm25_indexed_topk": INDEXED_SQL, "bm25_snapshots": BM25_SQL, "hybrid_snapshots": HYBRID_SQL}
