"""Registered queries over nested records: redaction at any depth, structural differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from ..sources.corpus import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and its turns in order as structs."""
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null")
    meta = F.struct(F.concat(F.lit("k"), F.col("turn").cast("string")).alias("api_key"), (F.col("turn") * 10).alias("cost"), F.concat(F.lit("see https://u:p@h.example/x?token=t"), F.col("turn").cast("string")).alias("note"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text"), "role", meta.alias("meta")))).alias("turns"))


def nested_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records: secrets by name and within texts, three levels down, are gone and all else stays."""
    item = lambda t: F.struct(t["meta"].alias("meta"), t["role"].alias("role"), F.array(t["text"], F.concat(F.lit("password="), t["role"])).alias("texts"))
    record = F.to_json(F.struct(F.struct(F.lit("a").alias("user")).alias("auth"), F.col("conv_id").alias("conv"), F.transform("turns", item).alias("turns")))
    return records.redact_records(_turns(spark, sf_dir).select(F.col("conv_id").alias("id"), record.alias("record")))


REDACTION_SQL = r"""WITH t AS (SELECT conv_id, list({'meta': {'api_key': '[redacted]', 'cost': turn * 10, 'note': 'see https://[redacted]@h.example/x'}, 'role': role, 'texts': [text, 'password=[redacted]']} ORDER BY turn, text, role) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)
SELECT conv_id AS id, to_json({'auth': '[redacted]', 'conv': conv_id, 'turns': turns})::VARCHAR AS record FROM t"""


def record_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two captures of each conversation: in the second one every fourth turn's role is upper case, every sixth has a flag, and times differ."""
    def capture(second: bool) -> DataFrame:
        role = lambda t: F.when((t["turn"] % 4 == 3) & F.lit(second), F.upper(t["role"])).otherwise(t["role"])
        flag = lambda t: F.when((t["turn"] % 6 == 5) & F.lit(second), F.lit(True))
        item = lambda t: F.struct(flag(t).alias("flag"), F.struct(role(t).alias("role"), t["meta"]["cost"].alias("cost")).alias("inner"), t["text"].alias("text"))
        record = F.to_json(F.struct(F.lit(int(second)).alias("duration_ms"), F.transform("turns", item).alias("turns")))
        return _turns(spark, sf_dir).select(F.col("conv_id").alias("id"), record.alias("record"))

    return records.compare(capture(False), capture(True))


DIFFERENCES_SQL = r"""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, role) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL)
SELECT conv_id AS id, '/turns/' || i || '/inner/role' AS path, 'changed' AS change, role AS before, upper(role) AS after FROM t WHERE turn % 4 = 3 AND role <> upper(role)
UNION ALL SELECT conv_id, '/turns/' || i || '/flag', 'added', NULL, 'true' FROM t WHERE turn % 6 = 5"""

QUERIES = {"nested_redaction": nested_redaction, "record_differences": record_differences}
ORACLES = {"nested_redaction": REDACTION_SQL, "record_differences": DIFFERENCES_SQL}
