"""Semantic retrieval: exact cosine top-k for a table of query vectors, embedding inputs, cache reuse, provider batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _packed(rows: DataFrame, id_column: str, block: int) -> DataFrame:
    """Blocks of at most ``block`` unit vectors of one snapshot and dimension: snapshot, size, ids, m (row-major doubles).  Nothing shuffles."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (snapshot, size), own in f.groupby([f["snapshot"], f["vector"].map(len)]):
                for at in range(0, len(own), block):
                    part = own.iloc[at : at + block]
                    m = np.array(part["vector"].tolist(), dtype=np.float64)
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                    yield pd.DataFrame({"snapshot": [snapshot], "size": [size], "ids": [part[id_column].to_numpy()], "m": [m.tobytes()]})

    snapshot = F.coalesce(F.col("snapshot_id").cast("string"), F.lit("")) if "snapshot_id" in rows.columns else F.lit("")
    return rows.select(snapshot.alias("snapshot"), id_column, "vector").where("vector is not null").mapInPandas(pack, "snapshot string, size int, ids array<bigint>, m binary")


#: Bytes of query vectors that are sent to every task; beyond it query blocks and vector blocks meet by shuffle, in cells of a grid
#: of which each holds about so many bytes of queries and eight times as many of vectors.
BROADCAST_BYTES = 32 << 20


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, query_block: int = 256, vector_block: int = 4096, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, vec_id, score (over 0), rank, and snapshot_id if both sides have it: vectors then answer queries of their snapshot only.

    ``queries``: query_id, vector; ``vectors``: vec_id, vector.

    Both sides are packed into blocks; every block of queries meets every block of vectors of its dimension as one matrix
    product, and only the product's k best of each query leave it.  The queries are measured: a small set is broadcast, a
    large one is dealt over the rows of a grid and the vectors over its columns, so a cell gets its share of either.  A zero vector or another dimension scores nothing.
    Exact, in double precision; ties go by vec_id.
    """
    bytes_of = lambda df: df.agg(F.sum(F.size("vector").cast("long") * 8)).first()[0] or 0
    scoped = "snapshot_id" in queries.columns and "snapshot_id" in vectors.columns
    if not scoped:
        queries, vectors = queries.select("query_id", "vector"), vectors.select("vec_id", "vector")
    down = max(1, -(-bytes_of(queries) // broadcast_bytes))
    across = max(1, -(-bytes_of(vectors) // (8 * broadcast_bytes))) if down > 1 else 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = _packed(queries, "query_id", query_block).select("snapshot", F.col("size").alias("dim"), F.col("size").alias("q_size"), F.col("ids").alias("q_ids"), F.col("m").alias("q"))
    held = _packed(vectors, "vec_id", vector_block).withColumnRenamed("size", "dim")
    if down == 1:
        pairs = held.join(F.broadcast(asked), ["snapshot", "dim"])
    else:
        asked = asked.withColumn("row", F.pmod(F.xxhash64("q_ids"), F.lit(down))).withColumn("column", every(across))
        held = held.withColumn("column", F.pmod(F.xxhash64("ids"), F.lit(across))).withColumn("row", every(down))
        pairs = held.join(asked, ["snapshot", "dim", "row", "column"])
    pairs = pairs.select("snapshot", "ids", "m", "q_size", "q_ids", "q")

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                ids = np.asarray(row.ids)
                q, m = (np.frombuffer(x, dtype=np.float64).reshape(-1, row.q_size) for x in (row.q, row.m))
                score = np.round(q @ m.T, 6)
                top = [np.lexsort((ids, -own))[:k] for own in score]
                top = [t[own[t] > 0] for t, own in zip(top, score, strict=True)]
                yield pd.DataFrame(
                    {
                        "snapshot_id": row.snapshot,
                        "query_id": np.repeat(np.asarray(row.q_ids), [len(t) for t in top]),
                        "vec_id": ids[np.concatenate(top)],
                        "score": np.concatenate([own[t] for t, own in zip(top, score, strict=True)]),
                    }
                )

    found = pairs.mapInPandas(best, "snapshot_id string, query_id long, vec_id long, score double")
    order = Window.partitionBy("snapshot_id", "query_id").orderBy(F.desc("score"), "vec_id")
    found = found if scoped else found.withColumn("snapshot_id", F.lit(""))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found if scoped else found.drop("snapshot_id")


def embedding_input(path: Column, kind: Column, symbol: Column, title: Column, imports: Column, calls: Column, body: Column) -> Column:
    """The text to embed: a head of bracketed parts, those that are known, and the body below it."""
    part = lambda label, c: F.when(c != "", F.concat(F.lit(f"[{label}: "), c, F.lit("]")))
    listed = lambda c: F.array_join(F.slice(c, 1, 5), ", ")
    head = F.concat_ws(
        " ",
        F.when(path != "", F.concat(F.lit("["), path, F.lit("]"))),
        F.when(symbol != "", F.concat(F.lit("["), kind, F.lit(": "), symbol, F.lit("]"))),
        part("title", title),
        part("imports", listed(imports)),
        part("calls", listed(calls)),
    )
    return F.when(head != "", F.concat_ws("\n", head, body)).otherwise(body)


def reuse_cached(wanted: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their newest stored vector, distinct hashes still to embed).

    ``wanted``: content_hash and more; ``stored``: content_hash, vector, created_at.  Where both name a provider and a model,
    only vectors of the same ones are reused.
    """
    keys = [c for c in ("provider", "model", "content_hash") if c in wanted.columns and c in stored.columns]
    newest = stored.groupBy(*keys).agg(F.max_by("vector", "created_at").alias("vector"))
    hits = wanted.join(newest, keys)
    return hits, wanted.select(*keys).distinct().join(newest, keys, "left_anti")


def first_relations(relations: DataFrame, most: int = 5) -> DataFrame:
    """symbol, imports, calls: the first distinct observed targets of each kind, in the order of the facts.

    ``relations``: symbol, ord, kind (imports, calls), target, observed.
    """
    first = relations.where(F.col("observed") & F.col("kind").isin("imports", "calls")).groupBy("symbol", "kind", "target").agg(F.min("ord").alias("ord"))
    placed = first.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "kind").orderBy("ord", "target"))).where(F.col("_n") <= most)
    own = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("_n", "target")))), lambda x: x["target"])
    return placed.groupBy("symbol").agg(own("imports").alias("imports"), own("calls").alias("calls"))


def provider_violations(inputs: DataFrame, answers: DataFrame) -> DataFrame:
    """batch_id, code, n: answers that break the provider's contract.  ``inputs``: batch_id, index; ``answers``: batch_id, index, vector.

    Every input has one answer and no other index has any, all vectors of a batch have one dimension, and all numbers are finite.
    """
    key = ["batch_id", "index"]
    given = answers.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    code = lambda df, name, n=F.lit(1): df.select("batch_id", F.lit(name).alias("code"), n.cast("long").alias("n"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    sizes = answers.groupBy("batch_id").agg(F.count_distinct(F.size("vector")).alias("d")).where("d > 1")
    rows = (
        code(inputs.join(given, key, "left_anti"), "missing_answer")
        .unionByName(code(answers.join(inputs, key, "left_anti"), "unknown_index"))
        .unionByName(code(given.where("n > 1"), "repeated_answer", F.col("n") - 1))
        .unionByName(code(answers.where(F.col("vector").isNull() | (F.size("vector") == 0) | bad), "not_finite"))
        .unionByName(code(sizes, "mixed_dimensions", F.col("d")))
    )
    return rows.groupBy("batch_id", "code").agg(F.sum("n").alias("n"))


def availability(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, mode, reason: hybrid where the query's snapshot has vectors and the query has one of their dimension, else lexical.

    ``queries``: query_id, snapshot_id, vector; ``vectors``: snapshot_id, vector.
    """
    dims = vectors.where("vector is not null").select("snapshot_id", F.size("vector").alias("d")).distinct()
    known = dims.groupBy("snapshot_id").agg(F.collect_set("d").alias("dims"))
    rows = queries.join(known, "snapshot_id", "left")
    reason = F.when(F.col("dims").isNull(), "no_vectors").when(F.col("vector").isNull(), "query_not_embedded").when(~F.array_contains("dims", F.size("vector")), "dimension_mismatch")
    return rows.select("query_id", F.when(reason.isNull(), "hybrid").otherwise("lexical").alias("mode"), reason.alias("reason"))


def embedding_status(chunks: DataFrame, results: DataFrame, enabled: bool = True) -> DataFrame:
    """snapshot_id, status (ready, warning, disabled), chunks, stored, reused, failed.  ``results``: snapshot_id, chunk_id, outcome (stored, reused, failed)."""
    of = lambda name: F.sum((F.coalesce("outcome", F.lit("")) == name).cast("long")).alias(name)
    rows = chunks.select("snapshot_id", "chunk_id").join(results, ["snapshot_id", "chunk_id"], "left")
    n = rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("chunks"), of("stored"), of("reused"), of("failed"))
    done = F.col("stored") + F.col("reused")
    status = F.when(~F.lit(enabled), "disabled").when(done == F.col("chunks"), "ready").otherwise("warning")
    return n.withColumn("status", status).select("snapshot_id", "status", "chunks", "stored", "reused", "failed")


def embed(rows: DataFrame, provider: Callable[[list[str]], list[list[float]]], batch: int = 64, shortest: int = 32) -> DataFrame:
    """content_hash, vector, error for ``rows`` (content_hash, input).  A failing batch is halved, a failing input shortened."""

    def run(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [(v, None) for v in provider(texts)]
        except Exception as e:  # a provider's error is data: it is reported in its row
            if len(texts) > 1:
                half = len(texts) // 2
                return run(texts[:half]) + run(texts[half:])
            if len(texts[0]) > shortest:
                return run([texts[0][: max(shortest, len(texts[0]) // 2)]])
            return [(None, str(e)[:200])]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["input"].tolist()
            found = [x for i in range(0, len(texts), batch) for x in run(texts[i : i + batch])]
            yield pd.DataFrame({"content_hash": f["content_hash"], "vector": [v for v, _ in found], "error": [e for _, e in found]})

    return rows.select("content_hash", "input").mapInPandas(each, "content_hash string, vector array<float>, error string")
