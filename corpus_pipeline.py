"""From raw documents to packed sequences in five stages, each a written table that the next one reads.

Every stage works on all that its predecessor kept and returns the columns of ``documents``, but for the last, which
returns the packed pieces.  Stages decide by row: null and repeated ids, null and very long texts, repeated rows, extra
columns of any name and empty tables pass through.
"""

from __future__ import annotations

import time
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm import exact_dedup, mixing, near_copies, packing, quality_rules
from lodeseam.llm.common import discard, materialize, recorded, table


#: What the stages of a run wrote for themselves: for each input folder, (when the stage returned, its tables).
_SPENT: dict[str, list[tuple[float, list[str]]]] = {}


def _stage(step):
    """Deletes what earlier stages of the run wrote for themselves, and notes what this one writes.

    A run is known by its input folder.  A stage's tables are spent once its result is written, so they go if ``docs``
    was written after the stage had returned, and are not what ``docs`` reads; else they stay, as somebody may still read them.
    """

    @wraps(step)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        written_at = _written_at(spark, docs)
        kept = []
        for returned, paths in _SPENT.pop(sf_dir, []):
            if written_at > returned:
                discard(spark, paths, docs)
            if paths:
                kept.append((returned, paths))
        with recorded() as paths:
            out = step(spark, docs, sf_dir)
        _SPENT[sf_dir] = [*kept, (time.time(), paths)]
        return out

    return stage


def _written_at(spark: SparkSession, docs: DataFrame) -> float:
    """When the first file of ``docs`` was written; 0 if it has none."""
    files = docs.inputFiles()[:1]
    if not files:
        return 0.0
    at = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime() / 1000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a column that tells all rows apart, as ids may be null or repeated, and that column's name."""
    key = "row_key"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-keyed"), key


def _without(keyed: DataFrame, key: str, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``keyed`` that are not ``dropped`` (row_key).  Dropped keys are few and written, so Spark sees if it can send them around."""
    gone = materialize(dropped.select(F.col("row_key").alias(key)), "pipeline-dropped")
    return keyed.join(gone, key, "left_anti").select(*columns)


@_stage
def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list keeps.

    Labels are by id: a null id has none, rows of one id share theirs.  Without labels the base rule decides.
    """
    plain = docs.select("doc_id", "text")
    rules = quality_rules.learn_rules(plain, table(spark, sf_dir, "labels"))
    judged = quality_rules.apply_rules(docs, rules, tuple(docs.columns), bare=True)
    return judged.where("kept").select(*[F.col("_keep")[c].alias(c) for c in docs.columns])


@_stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the largest id, of each group of equal texts; of rows with equal ids any one, and null ids last."""
    keyed, key = _keyed(docs)
    found = exact_dedup.dedup_against_index(keyed.select("doc_id", "text", F.col(key).alias("row_key")), exact_dedup.DigestIndex(spark), carry=("row_key",))
    return _without(keyed, key, found.where(~F.col("kept")), docs.columns)


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least id, of each group that similarities of 0.8 on five words link; null ids last."""
    keyed, key = _keyed(docs)
    rows = keyed.select(F.col(key).alias("row_key"), "doc_id", "text")
    found = near_copies.near_copies(rows.select("row_key", "text"), "row_key").join(rows.select("row_key", "doc_id"), "row_key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    found = materialize(found.select("row_key", "component", order.alias("at")), "pipeline-near")
    groups = found.groupBy("component").agg(F.min("at.row_key").alias("any"), F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rest = found.join(groups.select("component", "first"), "component").where(F.col("row_key") != F.col("first.row_key"))
    return _without(keyed, key, rest, docs.columns)


@_stage
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix draws them, whole: none that it does not draw, a text of no words never."""
    keyed, key = _keyed(docs)
    draws = mixing.mix(keyed.select("doc_id", "source", "text", F.col(key).alias("row_key")), block_words=mixing.WHOLE, whole_blocks=True, key="row_key")
    drawn = draws.where("shard is not null").select(F.col("row_key").alias(key))
    return keyed.join(drawn, key).select(*docs.columns)


@_stage
def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, placed; equal rows are packed each for itself, an empty text as its end token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), memo=200_000)  # workers still hold what earlier stages left


STAGES = [
    ("quality_rules", rules_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("pack", pack_stage),
]

#: SimHash and packing have no SQL form; tests/llm/test_pipeline.py checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
