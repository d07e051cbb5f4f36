"""Exact dedup against a persistent digest index.

The index is a table with one row per digest ever seen, bucketed and sorted by the digest.  A batch is reduced to its
distinct digests (map-side combined, so a group of copies shuffles a row per task), anti-joined against the index by
sort-merge, and what is new is appended.  Texts never shuffle: only ids and 32-byte digests do.

One writer at a time is meant.  Should two append the same digest all the same, ``read`` shows the first of them by batch
name, so rows never multiply; ``compact`` writes one sorted file per bucket again after many appends.

Defined cases: a null text counts as empty; a null ``doc_id`` loses to any other; rows that repeat a ``doc_id`` and text
are told apart by their place in the scan, so exactly one row of a group stays; a very long text is digested whole; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_ascii, materialize, shared_dir, table

INDEX_SCHEMA = "digest binary, keep_id bigint, batch string"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as 32 bytes."""
    return F.unhex(F.sha2(fold_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """A bucketed, digest-sorted table in the shared folder; opening it again registers what is stored there."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/{self.name}"
        # as many as a shuffle has partitions, so that an append writes one file a bucket and joins need no other layout
        self.buckets = buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        """digest (unique), keep_id, batch.  The table's buckets serve the grouping: no shuffle."""
        first = F.min(F.struct("batch", "keep_id")).alias("first")
        return self.spark.table(self.name).groupBy("digest").agg(first).select("digest", "first.keep_id", "first.batch")

    def compact(self) -> "DigestIndex":
        """The same digests in a new table of one sorted file per bucket."""
        fresh = DigestIndex(self.spark, buckets=self.buckets)
        fresh.append(self.read())
        return fresh

    def append(self, rows: DataFrame) -> None:
        """One sorted file for each bucket that gets rows."""
        (
            rows.select("digest", "keep_id", "batch")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )


def digests(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, digest, place (tells all rows apart) and the columns named in ``carry``, written."""
    return materialize(docs.select("doc_id", text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("place"), *carry), "digests")


def register(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Add the digests of ``rows`` that are new to ``index``.  Returns digest, last (doc_id, place), group_size, batch_seen."""
    last, size = F.max(F.struct("doc_id", "place")).alias("last"), F.count(F.lit(1)).alias("group_size")
    groups = materialize(rows.groupBy("digest").agg(last, size).withColumn("batch_seen", F.lit(batch)), "digest-groups")
    fresh = groups.join(index.read().hint("merge"), "digest", "left_anti")
    index.append(fresh.select("digest", F.col("last.doc_id").alias("keep_id"), F.lit(batch).alias("batch")))
    return groups


def decide(rows: DataFrame, groups: DataFrame, index: DigestIndex, carry: tuple[str, ...] = ()) -> DataFrame:
    """The index's decision for every row; ``groups`` as ``register`` returns them, one per digest."""
    decided = materialize(
        groups.join(index.read().hint("merge"), "digest").select(
            "digest",
            "group_size",
            "keep_id",
            F.when(F.col("batch") == F.col("batch_seen"), F.col("last.place")).alias("keep_place"),
        ),
        "digest-decisions",
    )
    # Both sides are plain exchanges, so a digest with a third of all rows is split among tasks at run time.
    return rows.join(decided, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("place") == F.col("keep_place"), F.lit(False)).alias("kept"),
        "digest",
        *carry,
    )


def dedup_against_index(docs: DataFrame, index: DigestIndex, batch: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Decide every row of ``docs`` and add the digests that are new to ``index``.

    Of equal texts in the batch the row with the largest ``doc_id`` stays; none stays if an earlier batch had the text.
    Returns doc_id, keep_id, group_size (rows of the batch with the text), kept, digest (binary) and the columns
    named in ``carry``.
    """
    batch = batch or uuid.uuid4().hex
    rows = digests(docs, carry)
    return decide(rows, register(rows, index, batch), index, carry)


def dedup_in_batches(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Decide every row of ``docs`` as two batches over one new index, the rows of larger ids first.

    Whatever the second batch shares with the first is dropped by the anti-join against the index, so the largest id of
    each text stays.  Null ids are in the second batch.
    """
    rows = digests(docs)
    middle = rows.agg(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
    upper = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    seen = register(rows.where(upper), index, "1").unionByName(register(rows.where(~upper), index, "2"))
    both = seen.groupBy("digest").agg(F.min_by("last", "batch_seen").alias("last"), F.sum("group_size").alias("group_size"), F.min("batch_seen").alias("batch_seen"))
    return decide(rows, both, index)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_in_batches(table(spark, sf_dir, "documents"), DigestIndex(spark))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
