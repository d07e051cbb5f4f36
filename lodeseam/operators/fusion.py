"""Reciprocal-rank fusion, relevance gating, reranking and one-hop expansion over channels of ranked rows.

Rows that carry a snapshot_id are fused, gated, expanded and counted within it: a query over two snapshots is two searches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import dealt, written
from .lexical import scope


def rrf(channels: DataFrame, k: int = 60) -> DataFrame:
    """``channels``: query_id, channel, rank, chunk_id, path, score.  One row per query and chunk with the fused score.

    A row repeated in a channel adds again.  The first channel by name gives the path; signals list the channels.  A boost
    column is carried along; without one it is 0.
    """
    boost = F.col("boost") if "boost" in channels.columns else F.lit(0.0)
    fused = channels.groupBy(*scope(channels), "chunk_id").agg(
        F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("rrf"),
        F.min_by("path", F.struct("channel", "rank")).alias("path"),
        F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("signals"),
        F.max(F.when(F.col("channel") == "lexical", F.col("score"))).alias("lexical_score"),
        F.max(F.when(F.col("channel") == "semantic", F.col("score"))).alias("semantic_score"),
        F.max(boost).alias("boost"),
    )
    order = Window.partitionBy(*scope(fused)).orderBy(F.desc("rrf"), "path", "chunk_id")
    return fused.withColumn("position", F.row_number().over(order))


def plan(queries: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """query_id, query, limit, candidates, mode: white space collapsed, limit within 1 and 50, four candidates a row up to 200.

    ``queries``: query_id, query, limit; ``available``: query_id, mode (lexical without it).
    """
    limit = F.least(F.greatest(F.coalesce("limit", F.lit(10)), F.lit(1)), F.lit(50)).cast("int")
    rows = queries.select("query_id", F.trim(F.regexp_replace("query", r"\s+", " ")).alias("query"), limit.alias("limit"))
    rows = rows.withColumn("candidates", F.least(F.lit(200), F.col("limit") * 4).cast("int"))
    if available is None:
        return rows.withColumn("mode", F.lit("lexical"))
    return rows.join(available.select("query_id", "mode"), "query_id", "left").withColumn("mode", F.coalesce("mode", F.lit("lexical")))


def channels(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Both channels as one long frame: query_id, channel, rank, chunk_id, path, score, boost.  ``semantic`` has no boost."""
    shape = [*scope(lexical), "channel", "rank", "chunk_id", "path", "score", "boost"]
    boost = F.col("boost") if "boost" in lexical.columns else F.lit(0.0)
    a = lexical.withColumn("channel", F.lit("lexical")).withColumn("boost", boost).select(*shape)
    return a.unionByName(semantic.withColumn("channel", F.lit("semantic")).withColumn("boost", F.lit(0.0)).select(*shape))


def fuse_rows(channels_: DataFrame, k: int = 60) -> DataFrame:
    """query_id, position, identity, chunk_id, path, start_line, content, rrf, signals, source_ranks: fused rows with their fields merged.

    ``channels_``: query_id, channel, rank, chunk_id, path, start_line, end_line, content.  A row's identity is its chunk id, else
    its place and content.  The first channel's row wins; its missing fields are filled from the others; source_ranks maps
    each channel to its best rank.  Order: score, path, line, identity.
    """
    place = F.concat_ws("\0", F.coalesce("path", F.lit("")), F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.coalesce("content", F.lit("")))
    identity = F.coalesce(F.concat(F.lit("c"), F.col("chunk_id").cast("string")), F.concat(F.lit("p"), F.md5(place)))
    order = F.struct("channel", "rank")
    first = lambda c, some: F.min_by(F.when(some, F.col(c)), F.when(some, order)).alias(c)
    known = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    rows, key = channels_.withColumn("identity", identity), scope(channels_)
    ranks = rows.groupBy(*key, "identity", "channel").agg(F.min("rank").alias("r"))
    ranks = ranks.groupBy(*key, "identity").agg(F.sort_array(F.collect_list(F.struct("channel", "r"))).alias("_s"))
    fused = rows.groupBy(*key, "identity").agg(
        F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("rrf"), *[first(c, known(c)) for c in ("chunk_id", "path", "start_line", "content")]
    ).join(ranks, [*key, "identity"])
    by = Window.partitionBy(*key).orderBy(F.desc("rrf"), "path", "start_line", "identity")
    return fused.select(
        *key, F.row_number().over(by).alias("position"), "identity", "chunk_id", "path", "start_line", "content", "rrf",
        F.array_join(F.transform("_s", lambda x: x["channel"]), ",").alias("signals"), F.map_from_entries("_s").alias("source_ranks"),
    )


def run_audit(channels_: DataFrame, fused: DataFrame, expanded: DataFrame, returned: DataFrame) -> DataFrame:
    """query_id, lexical, semantic, fused, expanded, returned, events: what each step of a query's run gave."""
    key = scope(channels_)
    of = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    rows = of(channels_.where("channel = 'lexical'"), "lexical")
    for df, name in ((channels_.where("channel = 'semantic'"), "semantic"), (fused, "fused"), (expanded, "expanded"), (returned, "returned")):
        rows = rows.join(of(df, name), key, "full_outer")
    names = ("lexical", "semantic", "fused", "expanded", "returned")
    rows = rows.select(*key, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    events = F.array_join(F.array(*[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names]), ";")
    return rows.withColumn("events", events)


def hybrid(lexical: DataFrame, semantic: DataFrame, relations: DataFrame, paths: DataFrame, limit: int, least_lexical: float = 31.4, least_semantic: float = 0.51, rerank=None) -> tuple[DataFrame, DataFrame]:
    """(rows, audit) of a search over two channels: fusion, gate, one-hop expansion, and an optional reranking of the head.

    ``lexical``, ``semantic``: query_id, rank, chunk_id, path, score (and boost); ``relations``: relation_id, kind, source,
    target over chunk ids; ``paths``: chunk_id, path.  A rejected query has no rows.  Expanded rows follow the fused ones;
    ``rerank``, a column over the fused rows, orders the first fifty where ``limit`` is five or more.
    """
    both = written(channels(lexical, semantic), "hybrid-channels")  # a few rows a query, read by every step
    key = scope(both)
    where = key[:-1]
    fused = rrf(both)
    kept = accepted_only(fused, gate(observe(fused), least_lexical, least_semantic))
    if rerank is not None and limit >= 5:
        kept = rerank_head(kept, rerank).withColumn("position", F.col("reranked")).drop("reranked")
    most = min(200, 4 * limit)
    seeds = kept.where(F.col("position") <= limit)
    near = expand_one_hop(seeds.select(*key, F.col("chunk_id").alias("node"), F.col("rrf").alias("score")), relations, most)
    counts = seeds.groupBy(*key).agg(F.max("position").alias("_n"))
    near = near.join(counts, key).where(F.col("position") <= most - F.col("_n"))
    more = near.withColumnRenamed("node", "chunk_id").join(paths, [*where, "chunk_id"]).select(*key, (F.col("_n") + F.col("position")).alias("position"), "chunk_id", "path", "score", F.lit("structural").alias("signals"))
    rows = seeds.select(*key, "position", "chunk_id", "path", F.col("rrf").alias("score"), "signals").unionByName(more)
    return rows, run_audit(both, fused, more, rows)


def observe(fused: DataFrame) -> DataFrame:
    """Per query: hits of each channel and the best scores."""
    return fused.groupBy(*scope(fused)).agg(
        F.count("lexical_score").alias("lexical_hits"),
        F.count("semantic_score").alias("semantic_hits"),
        F.max("lexical_score").alias("top_lexical"),
        F.max("semantic_score").alias("top_semantic"),
        F.max("rrf").alias("top_rrf"),
        F.max("boost").alias("top_boost"),
    )


def gate(observed: DataFrame, least_lexical: float = 31.4, least_semantic: float = 0.51) -> DataFrame:
    """Adds decision and, where it is not acceptance, reason.  An exact hit always passes; a fused score is never a threshold."""
    some = (F.col("lexical_hits") > 0, F.col("semantic_hits") > 0)
    lexical = some[0] & ((F.col("top_boost") > 0) | (F.coalesce("top_lexical", F.lit(0.0)) >= least_lexical))
    semantic = some[1] & (F.coalesce("top_semantic", F.lit(-1.0)) >= least_semantic)
    none, ok = ~some[0] & ~some[1], lexical | semantic
    below = F.concat_ws("+", *[F.when(s, f"{name}_below_threshold") for s, name in zip(some, ("lexical", "semantic"), strict=True)])
    return observed.withColumn("decision", F.when(none, "not_found").when(ok, "accepted").otherwise("low_relevance")).withColumn(
        "reason", F.when(none, "no_channel_hits").when(~ok, below)
    )


def accepted_only(fused: DataFrame, decided: DataFrame) -> DataFrame:
    return fused.join(decided.where("decision = 'accepted'").select(*scope(fused)), scope(fused), "left_semi")


def rerank_head(fused: DataFrame, score, head: int = 50) -> DataFrame:
    """The first ``head`` positions by ``score`` (a column), stable; the tail keeps its order."""
    at_head = F.col("position") <= head
    order = Window.partitionBy(*scope(fused)).orderBy(F.when(at_head, 0).otherwise(1), F.when(at_head, -score), "position")
    return fused.withColumn("reranked", F.row_number().over(order))


#: Seeds that are sent to every task, at most; more of them meet the relations by shuffle.
BROADCAST_SEEDS = 500_000


def expand_one_hop(seeds: DataFrame, relations: DataFrame, limit: int) -> DataFrame:
    """Neighbours of seeds over resolved relations, either way: query_id, node, relation_id, kind, position, score.

    ``seeds``: query_id, node, score; ``relations``: relation_id, kind, source, target.  A neighbour that is a seed is left
    out, its first relation by (kind, relation_id) counts, and ``limit`` neighbours of a query stay, scored half the least
    seed score over their position.
    """
    key = scope(seeds)
    where = key[:-1]  # relations of several snapshots name theirs
    held = written(relations.select(*where, "relation_id", "kind", "source", "target"), "relations")
    ends = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    both = held.select(*where, "relation_id", "kind", F.explode(F.array(ends("source", "target"), ends("target", "source"))).alias("x")).select(*where, "relation_id", "kind", "x.*")
    own = seeds.select(*key, "node")
    if seeds.count() <= BROADCAST_SEEDS:
        own = F.broadcast(own)
    reached = both.join(own, [*where, "node"]).select(*key, F.col("other").alias("node"), "kind", "relation_id")
    reached = dealt(reached.join(own, [*key, "node"], "left_anti"), held.count(), *key, "node")  # what a seed reaches, dealt by the number of relations
    first = reached.groupBy(*key, "node").agg(F.min(F.struct("kind", "relation_id")).alias("r"))
    order = Window.partitionBy(*key).orderBy("r.kind", "r.relation_id", "node")
    placed = first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    least = seeds.groupBy(*key).agg(F.min("score").alias("least"))
    return placed.join(least, key).select(*key, "node", "r.relation_id", "r.kind", "position", F.round(0.5 * F.col("least") / F.col("position"), 9).alias("score"))
