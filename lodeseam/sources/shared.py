"""Tables that a job writes for itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the warehouse's where Spark is local."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = spark.conf.get("spark.sql.warehouse.dir")
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` once, in the shared folder: later steps read it, not its plan."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task of ``dealt``.
TASK_ROWS = 200_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as its ``rows`` need: what is grouped or ranked within the keys grows in tasks, not in a task."""
    return df.repartition(max(8, -(-rows // TASK_ROWS)), *keys)
