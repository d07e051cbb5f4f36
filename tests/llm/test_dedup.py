"""Exact and near dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from lodeseam.llm import components, exact_dedup, simhash, tiles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(i)
    return {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


def test_exact_equals_brute_force(spark, nasty, sample):
    for docs in (nasty, sample):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup_against_index(docs, exact_dedup.DigestIndex(spark)).collect()}
        assert got == _exact(rows)


def test_exact_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (2, "b")], "doc_id bigint, text string")
    got = exact_dedup.dedup_against_index(docs, exact_dedup.DigestIndex(spark)).collect()
    assert len(got) == 4 and sum(r["kept"] for r in got) == 2
    assert {r["keep_id"] for r in got} == {1, 2}


def test_index_remembers_batches_and_opens_again(spark, empty):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    assert all(r["kept"] for r in exact_dedup.dedup_against_index(first, index).collect())
    spark.sql(f"DROP TABLE {index.name}")  # the files stay: they are in the shared folder
    again = exact_dedup.DigestIndex(spark, index.name, index.path, 4)
    more = spark.createDataFrame([(7, "A"), (8, "c"), (9, "C")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.dedup_against_index(more, again).collect()}
    assert got == {7: (1, False), 8: (9, False), 9: (9, True)}
    assert again.read().count() == 3
    assert exact_dedup.dedup_against_index(empty, again).count() == 0


def test_two_batches_decide_as_one(spark, nasty, sample, empty):
    for docs in (nasty, sample):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        index = exact_dedup.DigestIndex(spark, buckets=4)
        got = exact_dedup.dedup_in_batches(docs, index).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == _exact(rows) and len(got) == len(rows)
        assert index.read().count() == len({x[0] for x in _exact(rows).values()})
        assert {r["batch"] for r in index.read().select("batch").distinct().collect()} == {"1", "2"}
    odd = spark.createDataFrame([(None, "a"), (None, "A"), (3, "b"), (3, "b"), (1, "B")], "doc_id bigint, text string")
    got = exact_dedup.dedup_in_batches(odd, exact_dedup.DigestIndex(spark)).collect()
    assert sorted((r["keep_id"] or 0, r["group_size"], r["kept"]) for r in got) == [(0, 2, False), (0, 2, True), (3, 3, False), (3, 3, False), (3, 3, True)]
    assert exact_dedup.dedup_in_batches(empty, exact_dedup.DigestIndex(spark)).count() == 0


def test_index_shows_a_digest_once_and_compacts(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    rows = spark.createDataFrame([(bytes([k]), k) for k in range(20)], "digest binary, keep_id bigint")
    for batch in ("b", "a"):  # two writers that did not see each other
        index.append(rows.selectExpr("digest", f"keep_id + {ord(batch)} as keep_id", f"'{batch}' as batch"))
    for read in (index.read(), index.compact().read()):
        assert sorted((r["keep_id"], r["batch"]) for r in read.collect()) == [(k + 97, "a") for k in range(20)]
    assert "Exchange" not in index.read()._jdf.queryExecution().executedPlan().toString()


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _near(rows):
    fp = {i: _fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (fp[i], find(i)) for i in ids}


def test_near_equals_brute_force(nasty, sample):
    for docs in (nasty, sample):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
        assert got == _near(rows)


def test_spark_hash_is_the_same_hash(spark):
    from pyspark.sql import functions as F

    texts = ["a b c", "é ß 日本", ""]
    got = [r[0] % (1 << 64) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert got == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_links_of_large_groups_join_what_all_pairs_join(spark):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centre for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp bigint")
    got = {r["node"] % (1 << 64): r["component"] for r in components.components(simhash.near_links(df, tile=32)).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    sets = lambda label: {frozenset(x for x in fps if label(x) == r) for r in {label(x) for x in fps}}
    assert sets(lambda x: got.get(x, x - (1 << 70))) == sets(find)


def test_close_pairs_skip_nothing():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    b = np.concatenate([a[:100] ^ np.uint64(5), rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    a, b = (x[np.argsort(np.bitwise_count(x), kind="stable")] for x in (a, b))
    got = {(int(i), int(j)) for p in tiles.close_pairs(a, b, 3, block=16) for i, j in p.T}
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if int(x ^ y).bit_count() <= 3}


def test_components_of_a_long_path(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {200: 200, 201: 200}


def test_near_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0
