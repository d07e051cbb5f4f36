"""An exactly-once sink: each micro-batch is written once, whatever is replayed, and rows that came too late are kept apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "batch_id bigint, rows bigint, late bigint, newest timestamp"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, rows, late, newest: the batches that are complete."""
    fs, at = _files(spark, f"{path}/ledger")
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger") if fs.exists(at) else spark.createDataFrame([], LEDGER)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exactly_once(path: str, key: str = "id", time: str = "created_at", late_seconds: int = 3600) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that adds a batch's new rows to ``path``/rows, and late ones to ``path``/late.

    A batch is written to a folder of its own number, over what a failed attempt left there, and entered in the ledger last:
    a batch in the ledger is skipped when it comes again, and readers see ledger batches only.  A row whose key any earlier
    batch holds is a copy, however long ago it came.  Late is what lies more than ``late_seconds`` before the newest time
    of the batches before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = ledger(spark, path)
        known = done.agg(F.max("newest").alias("newest"), F.max(F.when(F.col("batch_id") == batch_id, 1)).alias("again")).first()
        if known["again"]:
            return
        rows = batch.groupBy(key).agg(F.min(F.struct(*[c for c in (time, *(x for x in batch.columns if x not in (key, time)))])).alias("_r")).select(key, "_r.*").select(*batch.columns)
        fs, at = _files(spark, f"{path}/rows")
        if fs.exists(at):
            for side in ("rows", "late"):
                rows = rows.join(read(spark, path, batch.schema, side, batch_id).select(key), key, "left_anti")
        limit = F.lit(known["newest"]).cast("timestamp") - F.expr(f"interval {int(late_seconds)} seconds")
        marked = rows.select(*batch.columns, F.coalesce(F.col(time) < limit, F.lit(False)).alias("_late"))
        marked.where("not _late").drop("_late").write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
        marked.where("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        own, apart = (spark.read.schema(batch.schema).parquet(f"{path}/{side}/batch_id={batch_id}") for side in ("rows", "late"))
        newest = batch.agg(F.max(time).alias("newest"))
        entry = newest.select(F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(own.count()).cast("bigint").alias("rows"), F.lit(apart.count()).cast("bigint").alias("late"), F.greatest("newest", F.lit(known["newest"]).cast("timestamp")).alias("newest"))
        entry.coalesce(1).write.mode("append").parquet(f"{path}/ledger")

    return write


def read(spark: SparkSession, path: str, schema: T.StructType, side: str = "rows", but: int | None = None) -> DataFrame:
    """Rows (or the late ones) of the batches in the ledger; the folder of ``but`` is not opened."""
    kind = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    held = spark.read.schema(kind).parquet(f"{path}/{side}")
    held = held if but is None else held.where(F.col("batch_id") != but)
    return held.join(F.broadcast(ledger(spark, path).select("batch_id")), "batch_id", "left_semi").select(*schema.names)
