"""Mixing, packing and language-model scoring against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseam.llm import katz, mixing, packing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_meets_targets_exactly(nasty, sample):
    for docs in (nasty, sample):
        sizes = defaultdict(int)
        for r in docs.collect():
            sizes[r["source"]] += len(words(r["text"]))
        draws = mixing.mix(docs, shards=4, block_words=16).cache()
        target, expected = {r["source"]: r["target"] for r in draws.select("source", "target").distinct().collect()}, _targets(dict(sizes))
        assert target.keys() == expected.keys() and all(abs(target[s] - expected[s]) < 1e-6 * (1 + expected[s]) for s in target)
        taken = {r["source"]: r["t"] for r in draws.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
        assert all(abs(taken[s] - target[s]) <= 0.5 for s in taken)
        per_doc = draws.groupBy("doc_id").agg(F.sum("taken").alias("t")).join(docs.select("doc_id", "text"), "doc_id").collect()
        assert len(per_doc) == docs.count() and all(r["t"] <= 2 * len(words(r["text"])) for r in per_doc)
        # every draw is in one shard, shards are even, and a second run agrees
        shards = [r["count"] for r in draws.where("shard is not null").groupBy("shard").count().collect()]
        assert max(shards) - min(shards) <= 2 + 0.02 * sum(shards) or sum(shards) < 40
        again = mixing.mix(docs, shards=4, block_words=16)
        assert draws.exceptAll(again).count() == 0
        draws.unpersist()


def test_documents_report_what_the_shards_hold(spark, sample):
    docs = sample.unionByName(sample.limit(5)).repartition(2)  # repeated rows are rows of their own
    draws = mixing.mix(docs, shards=8, block_words=16).cache()
    found = mixing.per_document(draws).collect()
    assert len(found) == docs.count()
    held = draws.where("shard is not null").groupBy("row_key").agg(F.sum("taken").alias("t"), F.countDistinct("shard").alias("n")).collect()
    assert {r["row_key"]: r["t"] for r in held} == {r["row_key"]: r["taken"] for r in found if r["draws"]}
    assert {r["row_key"]: r["n"] for r in held} == {r["row_key"]: len(r["shards"].split(",")) for r in found if r["draws"]}
    assert all(r["first_shard"] == min(map(int, r["shards"].split(","))) for r in found if r["draws"])
    draws.unpersist()


def test_shards_as_files(spark, sample, tmp_path):
    draws = mixing.mix(sample, shards=4).cache()
    mixing.write_shards(draws, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == draws.where("shard is not null").count() and back.select("shard").distinct().count() == 4
    draws.unpersist()


def test_tree_keeps_every_quota(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), ("c", 0), ("d", 5000)], "source_key string, draws bigint")
    cuts = {r["source_key"]: r["cuts"] for r in mixing.split_quotas(quotas, 8).collect()}
    assert {s: c[-1] for s, c in cuts.items()} == {"a": 1000, "b": 37, "c": 0, "d": 5000}
    sizes = np.diff(np.array([[0, *c] for c in cuts.values()]), axis=1)
    assert (sizes >= 0).all() and set(sizes.sum(axis=0)) <= {754, 755}


def test_hypergeometric_has_its_mean_and_spread(spark):
    u = (F.col("id") + 0.5) / 2000
    expr = mixing.hypergeometric_sql("300L", "1000L", "200L", "u")
    x = [r[0] for r in spark.range(2000).select(u.alias("u")).select(F.expr(expr)).collect()]
    assert abs(np.mean(x) - 60) < 0.1
    assert abs(np.var(x) - 200 * 0.3 * 0.7 * 800 / 999) < 1
    assert spark.range(1).select(F.expr(mixing.hypergeometric_sql("5L", "5L", "3L", "0.4D"))).first()[0] == 3


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_pack_holds_every_piece_once(nasty, sample, tokenizer):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer)
    for docs, context in ((nasty, 64), (sample, 2048)):
        rows = packing.pack(docs, tokenizer, context).collect()
        expected = {}
        for r in docs.collect():
            ids = np.array([*exact.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
            for k, at in enumerate(range(0, len(ids), context)):
                expected[r["doc_id"], k] = (at, len(ids[at : at + context]), zlib.crc32(ids[at : at + context].tobytes()))
        assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected and len(rows) == len(expected)
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= context
        least = -(-sum(r["length"] for r in rows) // context)
        assert len(bins) <= 1.05 * least + 1


def test_tree_rounds_pack_as_well_as_one(spark, monkeypatch, tokenizer, sample):
    one = packing.pack(sample, tokenizer).select("sequence_id").distinct().count()
    monkeypatch.setattr(packing, "LEAF", 20)
    monkeypatch.setattr(packing, "FAN_IN", 3)
    monkeypatch.setattr(packing, "CARRY", 1 << 30)
    everything = packing.pack(sample, tokenizer).select("sequence_id").distinct().count()
    monkeypatch.setattr(packing, "CARRY", 6)
    many = packing.pack(sample, tokenizer)
    assert many.select("sequence_id").distinct().count() <= everything <= 1.02 * one + 1  # what is not carried loses nothing
    assert many.select("doc_id", "piece").distinct().count() == many.count()


def test_best_fit_takes_the_tightest_bin():
    assert sorted(map(sorted, packing.best_fit([6, 5, 4, 3, 2], 10))) == [[0, 2], [1, 3, 4]]


def test_chunked_ids_are_the_tokenizers(tokenizer):
    from tokenizers import Tokenizer

    exact, chunked = Tokenizer.from_file(tokenizer), packing.ChunkTokenizer(tokenizer)
    for text in ("", " ", "a <|endoftext|> b", "don't WE'LL", "x\x1cy\x85z", "ÉA. é ß!!! Σ ΑΣ", "a*** b&&& 12.5 x_y ( ) \"q\"", "日本 語😀"):
        assert chunked.packed(text) == np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_pack_of_nothing(empty, tokenizer):
    assert packing.pack(empty, tokenizer).count() == 0


def _katz(rows):
    """A direct model: dictionaries of counts."""
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    docs = {i: [*words((t or "").translate(LOWER)), "</s>"] for i, t in rows}
    uni, bi = Counter(), Counter()
    for i, w in docs.items():
        if train(i):
            uni.update(w)
            bi.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    d1 = katz.discounts([sum(c == r for c in uni.values()) for r in range(1, 7)], n)
    d2 = katz.discounts([sum(c == r for c in bi.values()) for r in range(1, 7)], n)
    unknown = 1 - sum(d1[min(c, 6)] * c for c in uni.values()) / n
    p1 = lambda w: d1[min(uni[w], 6)] * uni[w] / n if uni[w] else unknown
    after = defaultdict(list)
    for (h, w), c in bi.items():
        after[h].append((w, c))
    history = lambda h: uni["</s>"] if h == "<s>" else uni[h]

    def p2(h, w):
        if bi[h, w]:
            return d2[min(bi[h, w], 6)] * bi[h, w] / history(h)
        if not after[h]:
            return p1(w)
        seen = sum(d2[min(c, 6)] * c for _, c in after[h]) / history(h)
        return (1 - seen) / (1 - sum(p1(x) for x, _ in after[h])) * p1(w)

    out = {}
    for i, w in docs.items():
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out[i] = (not train(i), len(w), sum(uni[x] > 0 for x in w), n, base, sum(math.log10(p2(h, x)) for h, x in zip(["<s>", *w], w, strict=False)))
    for h in ["the", "<s>"]:  # distributions sum to one, the unknown word included
        if history(h):
            assert abs(sum(p2(h, x) for x in uni) + p2(h, "\0") - 1) < 1e-9
    return out


@pytest.mark.parametrize("small", [False, True])
def test_katz_equals_dictionaries(nasty, sample, monkeypatch, small):
    if small:  # many chunks and parts, and spread histories
        monkeypatch.setattr(katz, "CHUNK_BYTES", 20_000)
        monkeypatch.setattr(katz, "PART_BYTES", 30_000)
        monkeypatch.setattr(katz, "HOT_TOKENS", 300)
    for docs in (nasty, sample):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        expected = _katz(rows)
        got = katz.score_documents(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            e = expected[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == e[:4]
            assert abs(r["base_score"] - e[4]) < 1e-6 and abs(r["score"] - e[5]) < 1e-6 * (1 + abs(e[5])), r["doc_id"]


def test_katz_of_nothing(empty):
    assert katz.score_documents(empty).count() == 0
