"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from lodeseam import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, tmp_path, name):
    found = catalog.queries()[name](spark, SF)
    found.write.parquet(str(tmp_path / "out"))
    columns = sorted(found.columns)
    duck.execute(f"CREATE OR REPLACE TABLE expected AS {catalog.oracle_sql()[name]}")
    assert sorted(c[0] for c in duck.execute("DESCRIBE expected").fetchall()) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("expected", f"'{tmp_path}/out/*.parquet'"), (f"'{tmp_path}/out/*.parquet'", "expected")):
        assert duck.execute(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b} LIMIT 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    assert catalog.queries()[name](spark, SF).count() >= 0
