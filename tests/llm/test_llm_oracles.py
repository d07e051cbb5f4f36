"""The registered queries that SQL expresses, in both directions, and the rows of the others."""

import os

import pytest

from lodeseam.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.queries()[name](spark, SF)
    found.write.parquet(str(tmp_path / "out"))
    listed = ", ".join(sorted(found.columns))
    con.execute(f"CREATE TABLE expected AS {registry.oracle_sql()[name]}")
    for a, b in (("expected", f"'{tmp_path}/out/*.parquet'"), (f"'{tmp_path}/out/*.parquet'", "expected")):
        assert con.execute(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b} LIMIT 3").fetchall() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["op1_license_scan", "op2_mix_sources", "op9_quality_rules", "op10_toxicity"])
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert registry.queries()[name](spark, SF).count() == docs
