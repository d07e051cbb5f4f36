"""How often the locator reads its inputs, and that it reads no further into a text than it has to."""

from pyspark.sql import functions as F

from lodeseam.operators import locate
from lodeseam.plans import answers


def test_units_are_read_once_for_candidates_and_once_for_places(spark, tmp_path):
    texts = [f"def fn_{k}(x):\n    return alpha_{k % 3} + beta(x)\n" for k in range(12)]
    rows = [(k, f"src/f{k}.py", ("function", "class", "text")[k % 3], 1, 2, t, f"fn_{k}") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "unit_id long, path string, kind string, start_line int, end_line int, content string, symbol string").write.parquet(str(tmp_path / "units"))
    units = spark.read.parquet(str(tmp_path / "units"))
    symbols = units.select(F.col("unit_id").alias("symbol"), F.col("symbol").alias("name"), F.concat(F.lit("m."), "symbol").alias("qualified"), "kind", "unit_id")
    asked = spark.createDataFrame([(1, "where is alpha_1 added to beta"), (2, "where is fn_3 of alpha_0")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 1, 2.0), (1, 4, 1.5), (2, 3, 3.0)], "query_id long, chunk_id long, score double")
    found = locate.locate(asked, hits, symbols, symbols.select(F.col("symbol").alias("source"), F.col("symbol").alias("target")), units)
    assert found.count() > 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "Window" in plan and plan.count("row_number") == 1  # texts were met before, once


def test_symbols_of_documents_are_their_first_two_words(spark, tmp_path):
    texts = ["Alpha, beta gamma", " 12 one\n", "one!", "", None, "éa béc d", "x" + "-" * 5000, "a1b"]
    spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["unit_id"]: r["symbol"] for r in answers._code(spark, str(tmp_path)).collect()}
    assert found == {0: "Alpha_beta", 1: "one", 2: "one", 3: "", 4: "", 5: "a_b", 6: "x", 7: "a_b"}
    plan = answers._code(spark, str(tmp_path)).select("symbol")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
