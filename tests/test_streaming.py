"""The streams against the batch operators on the same rows."""

from pyspark.sql import functions as F

from lodeseam.operators import telemetry
from lodeseam.streaming import telemetry as stream

SCHEMA = "repo_id long, id long, tool_name string, created_at timestamp, top_score double, duration_ms double"


def _files(spark, path):
    rows = spark.range(300).select(
        (F.col("id") % 3).alias("repo_id"), "id", F.lit("t").alias("tool_name"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 600).alias("created_at"),
        F.when(F.col("id") % 90 > 20, 0.5).otherwise(0.0).alias("top_score"), F.col("id").cast("double").alias("duration_ms"),
    )
    rows.coalesce(1).write.parquet(path)
    return rows


def _drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_alerts_equal_batch(spark, tmp_path):
    rows = _files(spark, str(tmp_path / "in"))
    found = _drain(stream.alerts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), run=5), "alerts", "append")
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in telemetry.low_score_alerts(rows, 5).collect())


def test_daily_equals_batch(spark, tmp_path):
    rows = _files(spark, str(tmp_path / "in"))
    found = _drain(stream.daily(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), "daily", "complete")
    batch = telemetry.breakdown(rows.withColumn("day", F.to_date("created_at")), "day")
    assert sorted((str(r["day"])[:10], r["requests"], r["low_scores"]) for r in found.collect()) == sorted((str(r["day"]), r["requests"], r["low_scores"]) for r in batch.collect())


def test_copies_within_the_watermark_are_dropped(spark, tmp_path):
    rows = _files(spark, str(tmp_path / "in"))
    rows.limit(10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert _drain(stream.distinct_rows(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), "once", "append").count() == 300


def test_totals_and_breakdown_equal_batch(spark, tmp_path):
    rows = _files(spark, str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    batch = {str(r["day"]): (r["requests"], r["low_scores"], r["mean_ms"]) for r in telemetry.breakdown(rows.withColumn("day", F.to_date("created_at")), "day").collect()}
    for by in ((), ("tool_name",)):
        found = _drain(stream.totals(read(), by=by), f"totals{len(by)}", "complete")
        assert {str(r["day"])[:10]: (r["requests"], r["low_scores"], round(r["mean_ms"], 6)) for r in found.collect()} == batch


def test_alert_state_of_silent_repositories_is_dropped(spark, tmp_path):
    """Four low scores, a month of silence, four more: no run of five, as the first ones are forgotten."""
    day = 86400
    times = [k * 60 for k in range(4)] + [30 * day + k * 60 for k in range(4)]
    rows = [(1, k, "t", t, 0.0) for k, t in enumerate(times)] + [(2, 100 + k, "t", k * 3 * day, 0.9) for k in range(10)]
    df = spark.createDataFrame(rows, "repo_id long, id long, tool_name string, s long, top_score double").withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("s"))).withColumn("duration_ms", F.lit(1.0))
    shape = ["repo_id", "id", "tool_name", "created_at", "top_score", "duration_ms"]
    cut = 20 * day  # the second file moves the watermark on before the third one comes
    for name, part in (("1", df.where("s < 1000")), ("2", df.where(f"s >= 1000 and s < {cut}")), ("3", df.where(f"s >= {cut}"))):
        part.select(*shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.alerts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), run=5).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.read.schema("repo_id long, id long").parquet(str(tmp_path / "out")).count() == 0
