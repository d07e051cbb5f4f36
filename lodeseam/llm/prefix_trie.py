"""The prefix trie of conversations: which turns conversations share from their start, and what sharing them would save.

A turn becomes an identifier, the first 16 bytes of the SHA-256 of its role and text, so a conversation is a string
of 16 bytes a turn and a node of the trie is a prefix shared by its members.  In the order of those strings the members
of a node stand together.

* Spark deals the conversations into shards by ranges of (string, conv_id), so a prefix, or a whole conversation, that a
  third of all rows share is spread over as many shards as its rows fill.
* Within a shard, strips of rows become padded matrices of turn ids; ``lexsort`` orders a strip, the change masks of its
  columns are OR-accumulated from the left and mark where nodes start, and ``reduceat`` sums up every depth, deepest first.
* A strip knows the last row before it and the first row after it.  Only nodes on the prefix that it shares with one of
  them lie in several strips; all their counts are sums of what the strips hold, each node's start and its end falling in
  exactly one.  Those partial nodes meet by prefix; the others are finished where they are.

Defined cases: a null role or text is empty; turns are ordered with null first, equal ones by identifier; repeated rows
are turns of their own; rows without conv_id belong to no conversation; a conversation of any length is one row of
20 bytes a turn; ``ends`` of a node holds all conversations that end there, in one value; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

ID = 16
#: Cells of a strip's matrix, and turns behind a shard.
CELLS, SHARD = 2_000_000, 400_000
NODES = (
    "key binary, parent_key binary, strip bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends array<bigint>"
)


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of id in hexadecimal, words of the text) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.substring(F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), role, text), 256), 1, 2 * ID).alias("id")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), turn, words).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def rebuild(found: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Each conversation with its first turns, up to ``most`` as its number's checksum says, taken from conversation c - c % every."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    own = found.select("conv_id", "turns", h.alias("_h"), (F.col("conv_id") - F.col("conv_id") % every).alias("_base"))
    base = found.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_first"))
    first = F.slice(F.coalesce("_first", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    return own.join(base, "_base", "left").select("conv_id", F.concat(first, F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _common(a: bytes | None, b: bytes) -> int:
    """Turns that two conversations share from the start; -1 without a first one."""
    if a is None:
        return -1
    n = min(len(a), len(b))
    x, y = (np.frombuffer(v[:n], np.uint8) for v in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0] if len(differ) else n) // ID


def _prefix_keys(ids: bytes, depth: int) -> list[bytes]:
    """Keys of the prefixes of 0 to ``depth`` turns."""
    h, keys = hashlib.sha256(), []
    for d in range(depth + 1):
        keys.append(h.digest())
        h.update(ids[d * ID : (d + 1) * ID])
    return keys


def strip_nodes(strip: int, ids: list[bytes], words: list[list[int]], conv: np.ndarray, before: bytes | None, after: bytes | None) -> pa.Table:
    """Nodes of the rows of a strip; those that ``before`` or ``after`` share have a key, as partial sums."""
    n = len(ids)
    lens = np.array([len(b) // ID for b in ids])
    deep = int(lens.max())
    flat = np.frombuffer(b"".join(ids), ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    new = np.ones(len(flat), bool)
    new[1:] = (flat[order][1:] != flat[order][:-1]).any(axis=1)
    dense = np.empty(len(flat), np.int32)
    dense[order] = np.cumsum(new) - 1
    inside = np.arange(deep) < lens[:, None]
    matrix, counts = np.full((n, deep), -1, np.int32), np.zeros((n, deep), np.int64)
    matrix[inside], counts[inside] = dense, np.concatenate([np.asarray(w, np.int64) for w in words])
    order = np.lexsort((conv, *matrix.T[::-1]))
    matrix, counts, conv, lens, inside = matrix[order], counts[order], conv[order], lens[order], inside[order]
    first, last = ids[order[0]], ids[order[-1]]
    left, right = _common(before, first), _common(after, last)
    change = np.ones((n, deep + 1), bool)
    change[1:, 0] = False
    change[1:, 1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
    leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)
    keys = [_prefix_keys(ids[order[0]], left), _prefix_keys(ids[order[-1]], right)]
    parts, child = [], np.zeros(n, np.int64)
    for d in range(deep, -1, -1):
        start = np.flatnonzero(change[:, d])
        stop = np.append(start[1:], n)
        node = lens[start] >= d
        begins = np.ones(len(start), bool)
        begins[0] = d > left
        over = np.ones(len(start), bool)
        over[-1] = d > right
        size = stop - start
        tokens = counts[start, d - 1] if d else np.zeros(1, np.int64)
        leaves[start] += node & over & (lens[stop - 1] == d)
        saved[start] += np.where(node, (size - begins) * tokens, 0)
        ends = np.add.reduceat(lens == d, start, dtype=np.int64)
        key, parent = np.full(len(start), None, object), np.full(len(start), None, object)
        up = np.searchsorted(np.flatnonzero(change[:, max(d - 1, 0)]), start, side="right") - 1  # parent's segment
        last_up = int(change[:, max(d - 1, 0)].sum()) - 1
        if d <= right:
            key[-1] = keys[1][d]
        if d <= left:
            key[0] = keys[0][d]
        if d:
            if d - 1 <= right:
                parent[up == last_up] = keys[1][d - 1]
            if d - 1 <= left:
                parent[up == 0] = keys[0][d - 1]
            parent_conv = np.minimum.reduceat(conv, np.flatnonzero(change[:, d - 1]))[up]
        else:
            parent_conv = np.zeros(1, np.int64)
        columns = [np.minimum.reduceat(conv, start), parent_conv, size, np.add.reduceat(child, start), np.add.reduceat(leaves, start), np.add.reduceat(saved, start)]
        child = np.zeros(n, np.int64)
        child[start] = node & begins
        stops = np.append(0, np.cumsum(ends[node]))
        members = conv[lens == d]
        arrays = [pa.array(key[node].tolist(), pa.binary()), pa.array(parent[node].tolist(), pa.binary())]
        arrays += [pa.array(np.full(node.sum(), v), pa.int64()) for v in (strip, d)]
        arrays += [pa.array(c[node], pa.int64(), mask=np.full(node.sum(), d == 0 and k == 1)) for k, c in enumerate(columns)]
        arrays.append(pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(members, pa.int64())))
        parts.append(pa.table(arrays, [c.split()[0] for c in NODES.split(", ")]))
    return pa.concat_tables(parts)


def _shard_nodes(rows: pa.Table, cells: int) -> pa.Table:
    """All strips of a shard.  Rows of ``side`` -1 and 1 are the neighbours' last and first conversations."""
    side = np.asarray(rows["side"])
    near = {s: rows["ids"][int(i)].as_py() for s in (-1, 1) for i in np.flatnonzero(side == s)}
    rows = rows.filter(pa.array(side == 0))
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("ids", "ascending"), ("conv_id", "ascending")]))
    ids, words, conv = rows["ids"].to_pylist(), rows["words"].to_pylist(), np.asarray(rows["conv_id"])
    shard = rows["shard"][0].as_py()
    parts, i = [], 0
    while i < len(ids):
        j, deep = i, 0
        while j < len(ids) and (j == i or (j + 1 - i) * max(deep, len(ids[j]) // ID) <= cells):
            deep = max(deep, len(ids[j]) // ID)
            j += 1
        before = ids[i - 1] if i else near.get(-1)
        after = ids[j] if j < len(ids) else near.get(1)
        parts.append(strip_nodes((shard << 32) + i, ids[i:j], words[i:j], conv[i:j], before, after))
        i = j
    return pa.concat_tables(parts)


def build_trie(found: DataFrame, shards: int, cells: int = CELLS) -> DataFrame:
    """Nodes of conversations (conv_id, turns): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends."""
    spark: SparkSession = found.sparkSession
    rows = found.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = materialize(rows.repartitionByRange(shards, "ids", "conv_id").withColumn("shard", F.spark_partition_id().cast("bigint")), "trie-shards")
    place = F.struct("ids", "conv_id")
    ends = rows.groupBy("shard").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    used = sorted(r[0] for r in rows.select("shard").distinct().collect())  # as many as there are shards
    pairs = spark.createDataFrame(list(zip(used[:-1], used[1:])), "before bigint, after bigint")
    empty = F.lit(None).cast("array<int>").alias("words")
    behind = ends.join(pairs, F.col("shard") == F.col("before")).select(F.col("after").alias("shard"), F.lit(-1).alias("side"), F.col("last.conv_id"), F.col("last.ids"), empty)
    ahead = ends.join(pairs, F.col("shard") == F.col("after")).select(F.col("before").alias("shard"), F.lit(1).alias("side"), F.col("first.conv_id"), F.col("first.ids"), empty)
    own = rows.select("shard", F.lit(0).alias("side"), "conv_id", "ids", "words")
    nodes = materialize(own.unionByName(behind).unionByName(ahead).groupBy("shard").applyInArrow(lambda rows: _shard_nodes(rows, cells), NODES), "trie-nodes")
    total = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    parts = F.array_sort(F.collect_list(F.when(F.size("ends") > 0, F.struct("strip", "ends"))))
    shared = nodes.where("key is not null").groupBy("key", "depth").agg(F.first("parent_key", True).alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"), *total.values(), F.flatten(F.transform(parts, lambda p: p["ends"])).alias("ends"))
    names = ["conv_id", "depth", "parent_key", "parent_conv_id", *total, "ends"]
    every = nodes.where("key is null").select(*names).unionByName(shared.select(*names))
    parent = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    return every.join(parent, "parent_key", "left").select("conv_id", "depth", F.coalesce("_parent", "parent_conv_id").alias("parent_conv_id"), *total, "ends")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``build_trie`` of rebuilt conversations, with enough shards for all turns."""
    spark = conversations.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-conversations.count() // SHARD))
    return build_trie(rebuild(sequences(conversations)), shards)


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_trie(table(spark, sf_dir, "conversations"))
    return found.withColumn("ends_sha256", F.sha2(F.array_join(F.col("ends").cast("array<string>"), ",").cast("binary"), 256)).drop("ends")


#: The checksum of a conversation's number is folded from its bytes, eight shifts each.
OP12_SQL = r"""
WITH s AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda k: -1::BIGINT))))),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 4 AS h FROM s),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h.h::INT), []), list_slice(h.turns, h.h::INT + 1, len(h.turns))) AS turns FROM h LEFT JOIN s b ON b.conv_id = h.base),
p AS (SELECT conv_id, turns, list_transform(turns, lambda t: sha256(len(t.r) || ':' || t.r || t.t)) AS ids FROM r),
x AS (SELECT conv_id, d AS depth, len(ids) = d AS ends, sha256(array_to_string(ids[1:d], '')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(ids[1:d - 1], '')) END AS parent,
        CASE WHEN d > 0 THEN len(list_filter(regexp_split_to_array(turns[d].t, '[ \t-\r]+'), lambda w: w <> '')) ELSE 0 END AS words FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM p)),
n AS (SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM x GROUP BY node, depth),
c AS (SELECT parent, count(*) AS k FROM n GROUP BY parent),
f AS (SELECT n.*, coalesce(c.k, 0) AS n_children FROM n LEFT JOIN c ON c.parent = n.node),
u AS (SELECT up.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(f.own) AS saved FROM f JOIN x AS up ON up.conv_id = f.conv_id AND up.depth <= f.depth GROUP BY up.node)
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u ON u.node = f.node LEFT JOIN n q ON q.node = f.parent
"""
