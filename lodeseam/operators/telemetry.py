"""Telemetry of retrieval runs: redacted rows, daily trend, totals, breakdowns, and alerts on runs of low scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOW = 0.01


def record(rows: DataFrame) -> DataFrame:
    """The stored form: the query is never kept, counts and durations are not negative.  Works on streams too."""
    return rows.withColumn("query", F.lit("[redacted]")).withColumn("returned_count", F.greatest("returned_count", F.lit(0))).withColumn("duration_ms", F.greatest("duration_ms", F.lit(0.0)))


def _measures(low: float):
    disc = lambda q, name: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY duration_ms)").alias(name)
    return [
        F.count(F.lit(1)).alias("requests"),
        F.round(F.avg("top_score"), 6).alias("mean_score"),
        F.max("top_score").alias("max_score"),
        F.sum((F.col("top_score").isNull() | (F.col("top_score") < low)).cast("int")).alias("low_scores"),
        F.round(F.avg("duration_ms"), 6).alias("mean_ms"),
        disc(0.5, "p50_ms"),
        disc(0.95, "p95_ms"),
    ]


def trend(rows: DataFrame, as_of: str, days: int = 30, low: float = LOW) -> DataFrame:
    """Measures of each of the last ``days`` days before and with ``as_of``."""
    recent = rows.where((F.to_date("created_at") <= F.lit(as_of).cast("date")) & (F.to_date("created_at") > F.date_sub(F.lit(as_of).cast("date"), days)))
    return recent.groupBy(F.to_date("created_at").alias("day")).agg(*_measures(low))


def totals(rows: DataFrame, low: float = LOW) -> DataFrame:
    """The measures of all rows.  Percentiles come from running counts of the distinct durations, which are counted first."""
    plain = [m for m in _measures(low)[:-2]]
    counts = rows.where("duration_ms is not null").groupBy(F.col("duration_ms").alias("ms")).agg(F.count(F.lit(1)).alias("n"))
    # durations are cut into ranges by magnitude, so that running counts inside a range and over the ranges are small windows
    ranged = counts.withColumn("range", F.floor(F.log2(F.abs("ms") + 1) * 64) * F.signum("ms"))
    sums = ranged.groupBy("range").agg(F.sum("n").alias("own"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("own").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ahead = ahead.withColumn("all", F.sum("own").over(Window.partitionBy()))
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)) + F.col("ahead")
    placed = ranged.join(ahead, "range").withColumn("upto", upto)
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("all")), F.col("ms")))
    points = placed.agg(at(F.lit(0.5)).alias("p50_ms"), at(F.lit(0.95)).alias("p95_ms"))
    one = rows.agg(*plain).withColumn("_k", F.lit(1))
    return one.join(points.withColumn("_k", F.lit(1)), "_k").drop("_k")


def breakdown(rows: DataFrame, *keys: str, low: float = LOW) -> DataFrame:
    return rows.groupBy(*keys).agg(*_measures(low))


def low_score_alerts(rows: DataFrame, run: int = 10, low: float = LOW) -> DataFrame:
    """repo_id, id, created_at: the row with which ``run`` low scores stand in a row, once for each such run."""
    order = Window.partitionBy("repo_id").orderBy("created_at", "id")
    is_low = F.coalesce(F.col("top_score") < low, F.lit(True))
    island = rows.withColumn("is_low", is_low).withColumn("island", F.sum((~is_low).cast("int")).over(order))
    nth = island.where("is_low").withColumn("nth", F.row_number().over(Window.partitionBy("repo_id", "island").orderBy("created_at", "id")))
    return nth.where(F.col("nth") == run).select("repo_id", "id", "created_at")
