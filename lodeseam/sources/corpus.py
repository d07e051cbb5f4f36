"""The library's record shapes over generated tables, and readers for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from . import files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of one snapshot: snapshot_id, chunk_id, path, language, content."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select(
        F.lit("s1").alias("snapshot_id"), F.col("doc_id").alias("chunk_id"), path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content")
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), location, length, language, is_test of files outside ignored folders.  No content is read."""
    return _named(files.read_folder(spark, root, contents=False).drop("content") if files.reaches(root) else _listed(spark, root))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("*", X.detect_language(F.col("path")).alias("language"), X.is_test_path(F.col("path")).alias("is_test"))


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """Files of a store that only Spark opens; its file source lists no empty ones."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    base = root.split("://")[-1].rstrip("/") + "/"
    named = listed.select(F.element_at(F.split(F.col("path"), base, 2), -1).alias("path"), F.col("path").alias("location"), "length")
    return named.where(~X.is_ignored(F.col("path")))


def _loaded(spark: SparkSession, root: str, max_bytes: int) -> DataFrame:
    """``_listed`` with contents: the file source drops large files of unsupported types before it opens them."""
    load = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True)
    letters = lambda name: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)
    supported = "{" + ",".join([*(f"?*{letters(x)}" for x in X.LANGUAGES), *map(letters, X.TEXT_NAMES)]) + "}"
    small = load().load(root).where(F.col("length") <= max_bytes)
    large = load().option("pathGlobFilter", supported).load(root).where(F.col("length") > max_bytes)
    return _listed(spark, root).join(small.unionByName(large).select(F.col("path").alias("location"), "content"), "location", "left")


def scan_files(spark: SparkSession, root: str, max_bytes: int = 10 << 20) -> DataFrame:
    """Files under ``root`` without ignored folders: path, length, language, is_test, is_binary, indexable, ignored_reason,
    file_type, content_sha1, line_count, text (null where not indexable).

    Files of an unsupported type over ``max_bytes`` are classified by name; all others have their bytes read.  Mounted folders
    and object stores are read by ``files``, empty files included and ignored folders unopened; stores that only Spark opens by
    its file source, which lists no empty files and reads small files of ignored folders before they are dropped.
    """
    rows = _named(files.read_folder(spark, root, max_bytes=max_bytes) if files.reaches(root) else _loaded(spark, root, max_bytes))
    head = F.substring("content", 1, 8192)
    start = F.hex(F.substring("content", 1, 2))
    wide = start.isin("FFFE", "FEFF")
    binary = F.when(F.col("content").isNotNull(), ~wide & (F.rlike(F.hex(head), F.lit("^(..)*00")) | ~F.is_valid_utf8(head.cast("string")))).otherwise(F.lit(False))
    indexable = F.col("language").isNotNull() & ~binary
    bare = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    text = F.when(indexable, F.when(wide, F.decode("content", "UTF-16")).otherwise(bare))
    return rows.select(
        "path",
        "length",
        "language",
        "is_test",
        binary.alias("is_binary"),
        indexable.alias("indexable"),
        F.when(F.col("language").isNull(), "unsupported_file_type").when(binary, "binary").alias("ignored_reason"),
        F.coalesce(F.when(binary, "binary"), "language", F.lit("unknown")).alias("file_type"),
        F.sha1("content").alias("content_sha1"),
        F.when(text == "", 0).otherwise(F.size(X.split_lines(text))).alias("line_count"),
        text.alias("text"),
    )


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose hash differs between two scans, or that one of them lacks."""
    a = before.select("path", F.col("content_sha1").alias("before"))
    b = after.select("path", F.col("content_sha1").alias("after"))
    return a.join(b, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def require_no_drift(before: DataFrame, after: DataFrame) -> None:
    """Stops a publish whose captured contents are not the scanned ones."""
    first = drift(before, after).orderBy("path").limit(5).collect()
    if first:
        raise ValueError("content changed during the build: " + ", ".join(r["path"] for r in first))


def replace_snapshot(rows: DataFrame, path: str) -> None:
    """Overwrite the partitions of the snapshots in ``rows`` and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``; of equal ones the fresh row."""
    both = stored.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stored.columns if c not in keys]), F.struct(order, "_fresh")).alias("_row"))
    return best.select(*keys, "_row.*").select(*stored.columns)


def read_captures(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents, one or many a file (gold questions, captures, result rows), a row per element of ``queries``.

    Members outside ``queries`` are repeated on each row.  A byte order mark is skipped; what does not parse has a text in
    ``_corrupt`` and nothing else.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kind = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    rows = whole.select(F.from_json("value", kind, {"columnNameOfCorruptRecord": "_corrupt"}).alias("x")).select("x.*")
    if "queries" not in rows.columns:
        return rows
    return rows.withColumn("queries", F.explode_outer("queries")).select(*[c for c in rows.columns if c != "queries"], "queries.*")


def write_report(sections: DataFrame, path: str) -> None:
    """A report as JSON rows and as Markdown: ``sections`` has report_id, position, title, lines (array).

    Both are written by Spark, a folder per form; the Markdown has a row per report.
    """
    sections.write.mode("overwrite").json(f"{path}/json")
    markdown(sections).write.mode("overwrite").partitionBy("report_id").text(f"{path}/markdown")


def markdown(sections: DataFrame) -> DataFrame:
    """report_id, markdown: a heading per section and a bullet per line, in order."""
    body = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x)), "\n"))
    parts = F.sort_array(F.collect_list(F.struct("position", body.alias("body"))))
    return sections.groupBy("report_id").agg(F.array_join(F.transform(parts, lambda x: x["body"]), "\n\n").alias("markdown"))


def newest_reports(reports: DataFrame, per_repo: int = 12) -> DataFrame:
    """repo_id, report_id, created_at, summary, position: a repository's newest reports; a missing summary has a default."""
    order = Window.partitionBy("repo_id").orderBy(F.desc("created_at"), F.desc("report_id"))
    placed = reports.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_repo)
    return placed.withColumn("summary", F.coalesce("summary", F.lit("no summary"))).select("repo_id", "report_id", "created_at", "summary", "position")
