"""Phrase search by positions: the retry of a question that the tokens of a match cannot express, such as an unbroken run of CJK text.

Tokens are runs of letters and digits, and every CJK character by itself, numbered within a chunk.  A phrase stands where
each of its tokens stands at its own distance from one start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources.shared import written
from .lexical import scope


_CJK = r"[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"


def phrase_tokens(text: Column) -> Column:
    """Tokens in order; a CJK character is one.  Those are set apart by spaces first: a class without them takes Java eight times as long."""
    apart = F.regexp_replace(X.fold(F.coalesce(text, F.lit(""))), f"({_CJK})", " $1 ")
    return F.regexp_extract_all(apart, F.lit(rf"([\p{{L}}\p{{N}}]+|{_CJK})"))


def _followed(tokens: Column) -> Column:
    """Position, token and the next one (null after the last) of a column of tokens."""
    return F.posexplode(F.arrays_zip(tokens.alias("term"), F.slice(tokens, 2, F.size(tokens)).alias("next")))


def positions(chunks: DataFrame) -> DataFrame:
    """snapshot_id, chunk_id, position (from 0), term, next (the term after it, null at the end) of every token of ``content``."""
    cut = chunks.select("snapshot_id", "chunk_id", phrase_tokens(F.col("content")).alias("tokens"))
    return cut.select("snapshot_id", "chunk_id", _followed(F.col("tokens")).alias("position", "x")).select("snapshot_id", "chunk_id", "position", "x.term", "x.next")


#: Rows of a query set, or of the places it enters by, up to which they are sent to every task; larger ones meet the tokens by shuffle.
SENT_ROWS = 500_000


def sent(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= SENT_ROWS else rows


def phrase_hits(queries: DataFrame, held: DataFrame) -> DataFrame:
    """query_id, snapshot_id, chunk_id, hits (places of the phrase), first (the first one's position).

    ``queries``: query_id, query, and snapshot_id if only that one is asked; ``held``: as ``positions`` gives it.  Equal phrases
    are searched once.  A phrase enters by its rarest pair of adjoining tokens (or its only token): the pairs asked for are sent
    to the tokens, whose places are written; of those only places that begin a phrase shuffle, and the others are checked in
    their chunks alone.  A query without tokens has no hits.
    """
    key = scope(queries)
    where = key[:-1]
    own = queries.select(*key, phrase_tokens(F.col("query")).alias("phrase")).where(F.size("phrase") > 0)
    own = written(own.withColumn("lead", F.min("query_id").over(Window.partitionBy(*where, "phrase"))), "phrases")
    seen = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("phrase")).alias("longest"), F.sum(F.size("phrase")).alias("tokens"), F.count_if(F.size("phrase") == 1).alias("single")).first()
    of = F.size("phrase").alias("of")
    phrase = own.where("query_id = lead").select(*where, "lead", "phrase", of)
    pairs = phrase.select(*where, "lead", "of", _followed(F.col("phrase")).alias("at", "x")).select(*where, "lead", "of", "at", "x.term", "x.next").where("next is not null")
    place = ["lead", "snapshot_id", "chunk_id", (F.col("position") - F.col("at")).alias("start"), "of"]
    rarest = pairs
    if (seen["longest"] or 0) > 2:
        wanted = sent(pairs.select("term", "next").distinct(), seen["tokens"])
        # places of pairs that some phrase has: the texts are cut once, whatever follows reads these
        known = written(held.join(wanted, ["term", "next"], "left_semi").select("snapshot_id", "chunk_id", "position", "term", "next"), "phrase-places")
        count = known.groupBy("term", "next").agg(F.count(F.lit(1)).alias("n"))
        best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term", "next")).alias("best")
        rarest = written(pairs.join(count, ["term", "next"], "left").groupBy(*where, "lead", "of").agg(best).where("best.n > 0").select(*where, "lead", "of", "best.*").drop("n"), "rarest-pairs")
    starts = (known if (seen["longest"] or 0) > 2 else held).join(sent(rarest, seen["n"]), [*where, "term", "next"]).select(*place).where("start >= 0")
    if (seen["longest"] or 0) > 2:
        starts = written(starts, "phrase-starts")
        # a start is kept if each pair stands where it has to: equal keys on both sides, no pairs of places
        rows = starts.join(sent(pairs.drop("of"), seen["tokens"]), [*where, "lead"])
        rows = rows.select("lead", "snapshot_id", "chunk_id", "start", "of", "term", "next", (F.col("start") + F.col("at")).alias("position"))
        near = known.join(sent(starts.select("snapshot_id", "chunk_id").distinct(), starts.count()), ["snapshot_id", "chunk_id"], "left_semi")
        met = rows.join(near, ["snapshot_id", "chunk_id", "position", "term", "next"], "left_semi").groupBy("lead", "snapshot_id", "chunk_id", "start", "of").agg(F.count(F.lit(1)).alias("met"))
        starts = met.where(F.col("met") == F.col("of") - 1)
    starts = starts.select("lead", "snapshot_id", "chunk_id", "start")
    if seen["single"]:
        one = phrase.where("of = 1").select(*where, "lead", "of", F.lit(0).alias("at"), F.col("phrase")[0].alias("term"))
        starts = starts.unionByName(held.join(sent(one, seen["n"]), [*where, "term"]).select(*place[:-1]))
    hits = starts.groupBy("lead", "snapshot_id", "chunk_id").agg(F.count(F.lit(1)).alias("hits"), F.min("start").alias("first"))
    return hits.join(sent(own.select(*where, "lead", "query_id"), seen["n"]), [*where, "lead"]).select("query_id", "snapshot_id", "chunk_id", "hits", "first")


def retry_as_phrase(found: DataFrame, queries: DataFrame, held: DataFrame) -> DataFrame:
    """query_id, snapshot_id, chunk_id, channel: hits as they are, and phrase hits of the queries that have none."""
    key = scope(queries)
    lost = queries.join(found.select(*key).distinct(), key, "left_anti")
    own = found.select("query_id", "snapshot_id", "chunk_id", F.lit("terms").alias("channel"))
    return own.unionByName(phrase_hits(lost, held).select("query_id", "snapshot_id", "chunk_id", F.lit("phrase").alias("channel")))
