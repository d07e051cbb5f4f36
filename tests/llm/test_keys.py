"""Null, repeated and very large ids through every operator."""

import pytest

from lodeseam.llm import exact_dedup, katz, license_scan, mixing, packing, quality_rules, simhash, token_counts, toxicity, url_filter

BIG = (1 << 60) + 1
ROWS = [(None, "alpha beta gamma", "a"), (BIG, "under the MIT license now", "a"), (BIG, "under the MIT license now", "a"), (3, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").repartition(1)


def _ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x or 0))


def test_ids_stay_whole(spark, odd):
    P = pytest.importorskip("public_tokenizers")
    expected = [3, BIG, BIG, None]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert _ids(license_scan.scan(odd)) == expected
    assert _ids(simhash.near_duplicates(odd)) == expected
    assert _ids(exact_dedup.dedup_against_index(odd, exact_dedup.DigestIndex(spark))) == expected
    assert _ids(token_counts.token_counts(odd, P.path("piece_bpe_32k.model"))) == expected
    assert _ids(katz.score_documents(odd)) == expected
    assert _ids(packing.pack(odd, P.path("word_bpe_49k.json"))) == expected
    assert _ids(quality_rules.apply_rules(odd, quality_rules.learn_rules(odd, none))) == expected
    assert _ids(toxicity.score_documents(odd, toxicity.learn(odd, none))) == expected
    assert set(_ids(mixing.mix(odd))) == set(expected)
    pages = spark.createDataFrame([(None, "http://a.org/"), (BIG, None)], "page_id bigint, url string")
    assert {r["page_id"] for r in url_filter.filter_urls(pages).collect()} == {None, BIG}
