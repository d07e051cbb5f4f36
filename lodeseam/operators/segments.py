"""A lexical index that is kept current: segments of postings, marks of what they replace, merging.

A change writes one segment: the postings of the new and changed chunks, and marks of all chunks that it replaces or
removes.  A posting counts if no later segment marks its chunk.  The manifest lists the segments, so a segment that failed
half way is never seen, and merging swaps many for one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import publish
from .lexical import WEIGHTS, _score, postings, scope


def _listed(spark: SparkSession, root: str) -> tuple[int, dict[int, str]]:
    number, listed = publish._newest(spark, root)
    return number, {int(k): v for k, v in listed.get("segments", {}).items()}


def _write(chunks: DataFrame, dead: DataFrame, root: str, weights: dict[str, float]) -> str:
    path = f"{root}/data/segment-{uuid.uuid4().hex}"
    found = postings(chunks, None, weights)
    found.repartitionByRange("snapshot_id", "term", "chunk_id").sortWithinPartitions("snapshot_id", "term", "chunk_id").write.parquet(f"{path}/postings")
    # every chunk has a row, one without tokens too: it counts in the mean length
    length = found.select("snapshot_id", "chunk_id", "length").distinct()
    ids = chunks.select("snapshot_id", "chunk_id").join(length, ["snapshot_id", "chunk_id"], "left").withColumn("length", F.coalesce("length", F.lit(0)))
    ids.write.parquet(f"{path}/chunks")
    dead.select("snapshot_id", "chunk_id").distinct().write.parquet(f"{path}/dead")
    return path


def update(spark: SparkSession, root: str, changed: DataFrame, removed: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> int:
    """Add a segment for ``changed`` chunks (snapshot_id, chunk_id, fields), new ones included, and ``removed`` (snapshot_id, chunk_id)."""
    number, segments = _listed(spark, root)
    dead = changed.select("snapshot_id", "chunk_id")
    dead = dead if removed is None else dead.unionByName(removed.select("snapshot_id", "chunk_id"))
    path = _write(changed, dead, root, weights)
    publish.commit(spark, root, number + 1, {"segments": {**{str(k): v for k, v in segments.items()}, str(number + 1): path}})
    return number + 1


def live(spark: SparkSession, root: str, part: str) -> DataFrame:
    """Rows of ``postings`` or ``chunks`` that no later segment replaces."""
    _, segments = _listed(spark, root)
    rows = dead = None
    for k, path in sorted(segments.items()):
        own, marks = (spark.read.parquet(f"{path}/{x}").withColumn(n, F.lit(k)) for x, n in ((part, "_segment"), ("dead", "_dead")))
        rows, dead = (own, marks) if rows is None else (rows.unionByName(own), dead.unionByName(marks))
    if rows is None:
        raise LookupError(f"no segment in {root}")
    last = dead.groupBy("snapshot_id", "chunk_id").agg(F.max("_dead").alias("_dead"))
    # a chunk's own segment marks it, too: rows of that segment stay
    return rows.join(last, ["snapshot_id", "chunk_id"], "left").where(F.coalesce("_dead", F.lit(0)) <= F.col("_segment")).drop("_dead", "_segment")


def search(queries: DataFrame, root: str, least_terms: int = 1) -> DataFrame:
    """``lexical.bm25`` over what is live: query_id, snapshot_id, chunk_id, matched, score."""
    spark = queries.sparkSession
    asked = queries.select(*scope(queries), F.explode("terms").alias("term"))
    found = live(spark, root, "postings").join(asked.select("term").distinct(), "term", "left_semi")
    stats = live(spark, root, "chunks").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("length").alias("mean_length"))
    return _score(asked, found, stats, least_terms)


def merge(spark: SparkSession, root: str) -> int:
    """One segment of all that is live in place of those that are; marks and what they hid are gone.  ``publish.vacuum`` then deletes the old ones."""
    number, _ = _listed(spark, root)
    path = f"{root}/data/segment-{uuid.uuid4().hex}"
    rows = live(spark, root, "postings")
    rows.repartitionByRange("snapshot_id", "term", "chunk_id").sortWithinPartitions("snapshot_id", "term", "chunk_id").write.parquet(f"{path}/postings")
    live(spark, root, "chunks").write.parquet(f"{path}/chunks")
    spark.createDataFrame([], live(spark, root, "chunks").select("snapshot_id", "chunk_id").schema).write.parquet(f"{path}/dead")
    publish.commit(spark, root, number + 1, {"segments": {str(number + 1): path}})
    return number + 1
