"""License scan, URL filter, token counts, quality rules and toxicity against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from lodeseam.llm import license_scan, quality_rules, token_counts, toxicity, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_license_base_equals_brute_force(nasty, sample):
    phrases = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
    for docs in (nasty, sample):
        for r in license_scan.scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
            words = WORD.findall((r["text"] or "").translate(LOWER))
            found = sorted((i, label) for p, label in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
            assert r["n_words"] == len(words)
            assert sorted((s["start"], s["label"]) for s in r["spans"] if s["base"]) == found


def test_templates_match_mandatory_wording_only():
    T = license_scan.Template
    auto = license_scan.TemplateAutomaton((T("a", "a", "released <<beginOptional>>freely<<endOptional>> under <<var;name=x;max=2>> license"),))
    hit = lambda text: [(a, b) for _, a, b in auto.spans(license_scan.words_of(text))]
    assert hit("Released under license") == [(0, 3)]
    assert hit("so: released FREELY, under the new license.") == [(1, 7)]
    assert hit("released under one two three license") == []
    assert hit("released quickly under license") == []
    assert hit("released under a license license") == [(0, 5)]
    with pytest.raises(ValueError):
        license_scan.TemplateAutomaton((T("b", "b", "<<beginOptional>>x<<endOptional>>"),))
    with pytest.raises(ValueError):
        license_scan.TemplateAutomaton((T("b", "b", "x <<beginOptional>> y"),))


def test_license_of_nothing(empty):
    assert license_scan.scan(empty).count() == 0


URLS = [
    (1, None), (2, "no scheme"), (3, "http://Example.ORG/es/x?y#z"), (4, "https://a.b.example.org/en/12"), (5, "http://example.org"), (6, "http://x.com/fr/"),
    (7, "http://x.com/de/1"), (8, "http://com/de/"), (9, "http://xcom/de/"), (10, "http://spam-farm.example.net/"), (11, "http://m.spam-farm.example.net/?a://b"),
    (12, "http://"), (13, "http://a..org/"), (14, "http://example.org/en/2"), (15, "http://u@x.com:80/fr/"),
]


def _judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    spam = any(host == s or host.endswith("." + s) for s in url_filter.BLOCKED_SITES)
    return host, path, None, "block" if spam else "allow"


def test_url_filter_and_join_equal_brute_force(spark):
    pages = spark.createDataFrame(URLS, "page_id bigint, url string")
    expected = {i: _judge(u) for i, u in URLS}
    rows = lambda df: {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}
    assert rows(url_filter.filter_urls(pages)) == expected
    rules = spark.createDataFrame([(h + p, v) for v, h, p in url_filter.RULES], "rule string, verdict string")
    assert rows(url_filter.filter_by_join(pages, rules, [1, 4, 5], url_filter.BLOCKED_SITES)) == expected


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b))  # every pair of equal length collides
    url_filter.DigestArray.build({"aa": 0, "bb": 1, "ccc": 1}, str(tmp_path), "x")
    index = url_filter.DigestArray(str(tmp_path), "x")
    assert index.values_of([b"aa", b"bb", b"cc", b"ccc", b"dddd"]).tolist() == [0, 1, 255, 1, 255]


def test_token_counts_equal_the_tokenizer(nasty, sample):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *token_counts.read_vocabulary(path)], unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    for docs in (nasty, sample):
        for r in token_counts.token_counts(docs, path).join(docs.select("doc_id", "text"), "doc_id").collect():
            assert r["n_tokens"] == len(exact.encode(r["text"] or "").ids), r["doc_id"]


def test_token_count_ties_and_unknown():
    c = token_counts.UnigramCounter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁aa", -3.0)])
    assert c.word("▁aa") == (1, -3.0)  # of equal scores the longer last piece
    assert c.word("▁é") == (3, -1.0 - 13.0)


def _stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, places = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            places |= {j for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(places)


def test_quality_stats_equal_brute_force(nasty, sample):
    for docs in (nasty, sample):
        for r in quality_rules.text_stats(docs, ("doc_id", "text")).select("_keep.*", "*").drop("_keep").collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == _stats(r["text"]), r["doc_id"]


def test_rules_find_what_was_planted(spark):
    good = "words that are plain and calm and all of them differ number {} in this little text about nothing at all but length and more of it"
    rows = [(i, good.format(i) + (" ###" * 9 if i % 4 == 0 else ""), 0 if i % 4 == 0 else 1) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    rules = quality_rules.learn_rules(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int"))
    assert rules and len(rules[0].conditions) == 1
    got = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs, rules).collect()}
    assert got == {i: i % 4 != 0 for i in range(600)}


def test_rules_without_labels(spark, nasty, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality_rules.learn_rules(nasty, none) == []
    assert {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(nasty, []).collect()}[1] is False
    assert quality_rules.apply_rules(empty, []).count() == 0
    filtered = quality_rules.apply_rules(nasty, [], tuple(nasty.columns)).where("kept").select(*nasty.columns)
    assert filtered.columns == nasty.columns and {r["doc_id"] for r in filtered.collect()} == {4, 5}


def test_toxicity_learns_and_spares_clean_text(spark):
    import random

    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["zzsnarl", "grumwort", "foulqux"]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rng.randint(0, 60), rng.choice(bad))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5000, 1)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(docs, toxicity.learn(docs, labels)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) / len(held) > 0.9


def test_toxicity_without_labels(spark, nasty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.score_documents(nasty, toxicity.learn(nasty, none)).collect()
    assert len(got) == 10 and {r["score"] for r in got} == {0.0}
    assert toxicity.score_documents(nasty.where(F.lit(False)), toxicity.learn(nasty, none)).count() == 0


def test_toxicity_scores_equal_brute_force(spark, nasty):
    """Every window compressed anew, without memos, against the operator's scores."""
    import math
    import random

    import numpy as np
    import zstandard

    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows = []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 3 == 0:
            words[5:5] = ["zzsnarl", rng.choice(plain), "grumwort" + rng.choice(plain)]
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    assert model.weights

    def length(content, window):
        own = zstandard.ZstdCompressionDict(content + toxicity.TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=15, search_log=4, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTULTRA, write_content_size=False, write_dict_id=False, write_checksum=False)
        own.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(compression_params=params, dict_data=own).compress(b" " + window + b" " + toxicity.TAIL))

    gain = lambda w: length(model.ordinary, w) - length(model.toxic, w)

    def score(text):
        found = (text or "").encode().lower().split() or [b""]
        own = [gain(w) for w in found]
        gains = [gain(a + b" " + b) if max(x, y) >= toxicity.WORTH else min(x, y) for a, b, x, y in zip(found, found[1:], own, own[1:], strict=False)] or own
        n = len(gains)
        reach = [sum(g >= t for g in gains) for t in toxicity.THRESHOLDS]
        x = np.array([sum(gains) / n, *[r / n for r in reach], *[math.log1p(r) for r in reach], *[min(r, 1) for r in reach], math.log1p(n)])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(((x - model.mean) / model.scale) @ np.array(model.weights[:-1]) + model.weights[-1])))))

    some = docs.where("doc_id < 12").unionByName(nasty.where("char_length(text) < 500 or text is null").selectExpr("doc_id + 1000 as doc_id", "text"))
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    for r in toxicity.score_documents(some, model).collect():
        assert abs(r["score"] - score(texts[r["doc_id"]])) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3)
