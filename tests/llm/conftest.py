import pytest

NASTY = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", None, None),
    (4, "The cat sat on the mat under the MIT license today and then it went home again to eat fish", "en", "a"),
    (5, "THE cat sat on the mat under the MIT license today and then it went home again to eat fish", "en", "b"),
    (6, "one two three four five six seven eight nine ten " * 400, "en", "b"),
    (7, "é ß Ünïcode żółć 日本語 \U0001f600 words", "de", "c"),
    (8, "x", "en", "c"),
    (9, "a\x0bb\x0cc\rd\x1ce\x85f", "en", None),
    (10, "line one\nline one\nline one\n\nother line", "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and long texts, ties, and a column whose name an operator uses inside."""
    return spark.createDataFrame([(*r, "x", 5) for r in NASTY], SCHEMA + ", digest string, fp int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    """The documents of the smallest generated table."""
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no tables here")
    return spark.read.parquet(f"{path}/documents.parquet")
