"""Reads scoped to a snapshot: which snapshot, listings, point reads, read models, and replacing a file's or a snapshot's facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def select_snapshot(requests: DataFrame, repos: DataFrame, snapshots: DataFrame) -> DataFrame:
    """request_id, repo_id, snapshot_id, error: the snapshot a request reads.

    ``requests``: request_id, repo_id, snapshot_id (null: the repository's active one); ``repos``: repo_id,
    active_snapshot_id; ``snapshots``: snapshot_id, repo_id, status.  A snapshot must belong to the repository and have
    succeeded.
    """
    known = repos.select("repo_id", "active_snapshot_id", F.lit(True).alias("_known"))
    asked = requests.select("request_id", "repo_id", F.col("snapshot_id").alias("_asked")).join(known, "repo_id", "left")
    asked = asked.withColumn("snapshot_id", F.coalesce("_asked", "active_snapshot_id"))
    found = asked.join(snapshots.select("snapshot_id", "repo_id", "status"), ["snapshot_id", "repo_id"], "left")
    error = (
        F.when(F.col("_known").isNull(), "repo_not_found")
        .when(F.col("snapshot_id").isNull(), "no_active_snapshot")
        .when(F.col("status").isNull(), "snapshot_not_found")
        .when(F.col("status") != "succeeded", "snapshot_not_ready")
    )
    return found.select("request_id", "repo_id", F.when(error.isNull(), F.col("snapshot_id")).alias("snapshot_id"), error.alias("error"))


def repo_list(repos: DataFrame, snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    """repo_id, alias, created_at, active_snapshot_id, status, indexed (its active snapshot succeeded), newest first."""
    status = snapshots.select(F.col("snapshot_id").alias("active_snapshot_id"), "status")
    rows = repos.select("repo_id", "alias", "created_at", "active_snapshot_id").join(status, "active_snapshot_id", "left")
    rows = rows.withColumn("indexed", F.coalesce(F.col("status") == "succeeded", F.lit(False))).orderBy(F.desc("created_at"), "repo_id")
    return rows if limit is None else rows.limit(limit)


def snapshot_list(snapshots: DataFrame, per_repo: int | None = None) -> DataFrame:
    """Adds position: a repository's snapshots, newest first."""
    order = Window.partitionBy("repo_id").orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    rows = snapshots.withColumn("position", F.row_number().over(order))
    return rows if per_repo is None else rows.where(F.col("position") <= per_repo)


def to_build(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo_id, commit) pairs that have no succeeded snapshot: new ones, and failed ones again."""
    done = snapshots.where("status = 'succeeded'").select("repo_id", "commit")
    return wanted.select("repo_id", "commit").distinct().join(done, ["repo_id", "commit"], "left_anti")


def search_rows(rows: DataFrame, pattern: str, columns: list[str], order: list[str], limit: int | None = None, offset: int = 0, most: int = 1000) -> DataFrame:
    """Rows that hold ``pattern`` in any of the columns, in order.  Case does not count; % and _ are wildcards.

    A limit is clamped to 1 and ``most``; without one all rows return.
    """
    met = F.lit(False)
    for c in columns:
        met = met | F.coalesce(F.ilike(c, F.lit(f"%{pattern}%")), F.lit(False))
    found = rows.where(met).orderBy(*order)
    if offset:
        found = found.offset(offset)
    return found if limit is None else found.limit(max(1, min(limit, most)))


def by_ids(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Point reads for a table of ids."""
    return rows.join(ids.select(*keys).distinct(), keys, "left_semi")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """snapshot_id, chunks"""
    return chunks.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("chunks"))


def project_chunks(units: DataFrame, files: DataFrame) -> DataFrame:
    """The read model of units in their files: snapshot_id, chunk_id, path, language, kind, start_line, end_line, content."""
    own = files.select("snapshot_id", "file_id", "path", "language")
    return units.join(own, ["snapshot_id", "file_id"]).select("snapshot_id", F.col("unit_id").alias("chunk_id"), "path", "language", "kind", "start_line", "end_line", "content")


def project_graph(symbols: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): symbols, and the resolved relations both of whose ends are among them."""
    ids = symbols.select("symbol").distinct()
    edges = relations.where("source is not null and target is not null")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("symbol", end), end, "left_semi")
    return symbols, edges.select("relation_id", "kind", "source", "target")


def snapshot_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """snapshot_id, path, chunks (sorted array of start_line, end_line, chunk_id; empty for a file without any): every page of a snapshot."""
    item = F.struct(F.col("start_line"), F.col("end_line"), F.col("chunk_id"))
    own = chunks.groupBy("snapshot_id", "path").agg(F.sort_array(F.collect_list(item)).alias("chunks"))
    none = F.expr("cast(array() as array<struct<start_line: int, end_line: int, chunk_id: bigint>>)")
    return files.select("snapshot_id", "path").join(own, ["snapshot_id", "path"], "left").withColumn("chunks", F.coalesce("chunks", none))


def has_line_range(start: Column, end: Column) -> Column:
    return F.coalesce((start >= 1) & (end >= start), F.lit(False))


def stable_chunk_id(*parts: Column) -> Column:
    """32 hex digits of what identifies a chunk: repository, snapshot, path, lines, content hash, type."""
    return F.left(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(32))


def display_rows(evidence: DataFrame, width: int = 360) -> DataFrame:
    """query_id, chunk_id, path, reason, snippet.  ``evidence``: path, file_path, symbol, match_type (exact, lexical, semantic, structural), content.

    The path falls back from the row's own to its file's, to its symbol's, to 'repository'.
    """
    some = lambda c: F.when(F.trim(c) != "", F.col(c))
    reasons = F.create_map(*[F.lit(x) for x in ("exact", "exact match", "lexical", "text match", "semantic", "similar meaning", "structural", "related in the graph")])
    path = F.coalesce(some("path"), some("file_path"), some("symbol"), F.lit("repository"))
    reason = F.coalesce(F.try_element_at(reasons, F.col("match_type")), F.lit("match"))
    return evidence.select("query_id", "chunk_id", path.alias("path"), reason.alias("reason"), X.snippet(F.coalesce("content", F.lit("")), width).alias("snippet"))


def output_records(evidence: DataFrame, most: int = 12) -> DataFrame:
    """query_id, items: an answer's records in order of rank, at most ``most``; symbol, role and relation only where known.

    ``evidence``: query_id, rank, chunk_id, path, start_line, end_line, symbol, role, relation.
    """
    placed = evidence.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))).where(F.col("position") <= most)
    named = F.map_filter(
        F.create_map(*[x for c in ("symbol", "role", "relation") for x in (F.lit(c), F.col(c))]), lambda k, v: F.coalesce(F.trim(v) != "", F.lit(False))
    )
    item = F.struct("position", "chunk_id", "path", "start_line", "end_line", named.alias("about"))
    return placed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.to_json(item).alias("item")))), lambda x: x["item"]).alias("items"))


def stamp(facts: DataFrame, snapshot_id: str, files: DataFrame, parser: str = "unknown") -> DataFrame:
    """Facts with their snapshot and file id; a fact without a parser gets ``parser``."""
    own = files.select("path", "file_id")
    named = facts.withColumn("parser", F.coalesce("parser", F.lit(parser)) if "parser" in facts.columns else F.lit(parser))
    return named.withColumn("snapshot_id", F.lit(snapshot_id)).join(own, "path", "left")


def sort_facts(facts: DataFrame) -> DataFrame:
    """The stable order of facts, for sinks: path, lines, kind, id."""
    return facts.orderBy("path", "start_line", "end_line", "kind", "fact_id")


def status_per_file(files: DataFrame, parsed: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """files with status: parsed, partial (with diagnostics), failed (an error and nothing parsed), skipped (not indexable), missing.

    ``files``: file_id, indexable; ``parsed``: file_id of every fact; ``diagnostics``: file_id, severity.
    """
    facts = parsed.groupBy("file_id").agg(F.count(F.lit(1)).alias("facts"))
    seen = diagnostics.groupBy("file_id").agg(F.max((F.col("severity") == "error").cast("int")).alias("error"))
    rows = files.join(facts, "file_id", "left").join(seen, "file_id", "left")
    some = F.col("facts").isNotNull()
    status = (
        F.when(~F.col("indexable"), "skipped")
        .when(some & F.col("error").isNull(), "parsed")
        .when(some, "partial")
        .when(F.col("error") == 1, "failed")
        .otherwise("missing")
    )
    return rows.select("file_id", status.alias("status"))


def integrity(files: DataFrame, units: DataFrame, chunks: DataFrame, relations: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """gate, n, passed: what must be zero before a snapshot is published, one row per gate.

    Chunks must be the units, vectors (where given) the chunks, and no unit may name an unknown file, no relation an
    unknown unit.
    """
    ids = units.select(F.col("unit_id").alias("id"))
    gates = {
        "no_files": files.agg((F.count(F.lit(1)) == 0).cast("long").alias("n")),
        "units_without_file": units.join(files.select("file_id"), "file_id", "left_anti").agg(F.count(F.lit(1)).alias("n")),
        "units_without_chunk": ids.join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("n")),
        "chunks_without_unit": chunks.select(F.col("chunk_id").alias("id")).join(ids, "id", "left_anti").agg(F.count(F.lit(1)).alias("n")),
        "dangling_source": relations.where("source is not null").select(F.col("source").alias("id")).join(ids, "id", "left_anti").agg(F.count(F.lit(1)).alias("n")),
        "dangling_target": relations.where("target is not null").select(F.col("target").alias("id")).join(ids, "id", "left_anti").agg(F.count(F.lit(1)).alias("n")),
    }
    if vectors is not None:
        gates["chunks_without_vector"] = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    rows = None
    for name, count in gates.items():
        row = count.select(F.lit(name).alias("gate"), "n", (F.col("n") == 0).alias("passed"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def replace_file_facts(stored: dict[str, DataFrame], fresh: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """units, symbols and relations after the facts of ``files`` (file_id) were replaced by ``fresh``.

    Every old relation that touches a unit or symbol of those files goes, too, whichever file it came from.
    """
    gone = files.select("file_id").distinct()
    old_ids = None
    out = {}
    for name, key in (("units", "unit_id"), ("symbols", "symbol")):
        old = stored[name].join(gone, "file_id", "left_semi").select(F.col(key).cast("string").alias("id"))
        old_ids = old if old_ids is None else old_ids.unionByName(old)
        out[name] = stored[name].join(gone, "file_id", "left_anti").unionByName(fresh[name])
    kept = stored["relations"]
    for end in ("source", "target"):
        kept = kept.join(old_ids.select(F.col("id").alias(end)).distinct(), end, "left_anti")
    out["relations"] = kept.select(*stored["relations"].columns).unionByName(fresh["relations"])
    return out
