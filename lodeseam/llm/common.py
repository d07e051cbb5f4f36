"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_WRITTEN: list[str] = []
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ASCII white space, as a Java/RE2 character class.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a local one only where Spark itself is local."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='lodeseam-')}")
        path = _OWN[0]
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage ends there, a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the paths of the tables written inside, for ``discard``."""
    start, paths = len(_WRITTEN), []
    try:
        yield paths
    finally:
        paths += _WRITTEN[start:]


def discard(spark: SparkSession, paths: list[str], unless: DataFrame | None = None) -> None:
    """Delete written tables whose results are stored, and empty the list; those that ``unless`` reads stay in it."""
    read = unless.inputFiles() if unless is not None and paths else []
    names = {f.rsplit("/", 2)[-2] for f in read} | {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in read}
    kept = []
    while paths:
        path = paths.pop()
        if path.rsplit("/", 1)[-1] in names:
            kept.append(path)
        else:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths += kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.  ``lower`` does that on pure ASCII, and is faster there than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def map_documents(docs: DataFrame, columns: list[str], batch, schema: str, key: str = "doc_id") -> DataFrame:
    """``mapInPandas`` over ``key`` and ``columns``; ``schema`` names what ``batch`` returns beside the key.

    The key travels as text: pandas would turn integers with a null among them into floats.
    """
    rows = docs.select(F.col(key).cast("string").alias(key), *columns).mapInPandas(batch, f"{key} string, {schema}")
    return rows.withColumn(key, F.col(key).cast("bigint"))


def split_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; an empty array for a null or empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")
