"""Best-fit packing of tokenised documents by hierarchical residual packing.

Documents become token ids where their texts are read; pieces of the context length are sequences of their own, and only
the remainders are packed.  Leaves pack their remainders best-fit decreasing; bins that are nearly full leave, and the
rest go up a tree as items for another best-fit round with those of other leaves, until one node is left.  An item is a bin with its
pieces (a bounded list: each has a token at least), so no round looks anything up.

A node sends up its ``CARRY`` emptiest bins, which bounds what an inner node reads, and loses no merge: of two bins at most
half full best fit would have made one, so a node has one such bin at most, only those can be merged with others further up, each
with one partner, and the emptiest bins are the partners that take the most.  A node needs no more of them than it has
children.

Leaves are chosen by hash, so each sees the whole spread of lengths, and their number follows the number of remainders.

Defined cases: a null or empty text is the end token alone; a document longer than a sequence is cut, its last piece may
be short; equal lengths are ordered by a hash of doc_id and piece; rows that repeat a doc_id are packed as documents of
their own; null ids are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_documents, materialize, table

CONTEXT = 2048
#: Tokens a closed bin may lack.
SLACK = 8
#: Remainders in a leaf, about, and children of an inner node.
LEAF = 20_000
FAN_IN = 16
CARRY = 1024
#: Distinct chunks of text whose ids a worker remembers.
MEMO = 700_000


class ChunkTokenizer:
    """Token ids of a text, by way of its white-space-separated chunks.

    The tokenizer drops white space before it splits words, so the ids of a text are those of its chunks one after
    another; chunks repeat, and their ids are remembered for as long as the worker lives.  A chunk of Latin letters with
    punctuation after them is its lower-cased word and that punctuation, two words to the tokenizer.  New words go through
    it many at a time, and the ids are cut apart at the ends of words, which the vocabulary marks.
    """

    def __init__(self, path: str, most: int = MEMO):
        import tokenizers
        from tokenizers import normalizers, pre_tokenizers

        # by the library's module: this package's functions, shipped by value, have no module that outlives a task
        store = tokenizers.__dict__.setdefault("_chunk_tokenizers", {})
        if path not in store:
            whole = tokenizers.Tokenizer.from_file(path)
            words = tokenizers.Tokenizer.from_file(path)
            words.normalizer = normalizers.Sequence([])
            words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = whole.get_vocab()
            ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            store[path] = whole, words, ends, {}
        self._whole, self._words, self._ends, self._memo = store[path]
        self._most = most

    def _learn_words(self, fresh: list[bytes]) -> None:
        for at in range(0, len(fresh), 2000):
            part = fresh[at : at + 2000]
            ids = np.array(self._words.encode(b" ".join(part).decode(), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(self._ends[ids]) + 1
            raw, start = ids.tobytes(), 0
            for word, end in zip(part, (4 * cuts).tolist(), strict=True):
                self._memo[word] = raw[start:end]
                start = end

    def _learn(self, fresh: set[bytes]) -> None:
        memo, pairs, other = self._memo, [], []
        for chunk in fresh:
            m = _PLAIN.match(chunk.decode("utf-8", "replace"))
            if m:
                pairs.append((chunk, m[1].lower().encode(), m[2].encode()))
            else:
                other.append(chunk)
        other += {tail for _, _, tail in pairs if tail and tail not in memo}
        self._learn_words(list({word for _, word, _ in pairs if word not in memo}))
        for chunk, found in zip(other, self._whole.encode_batch_fast([c.decode("utf-8", "replace") for c in other], add_special_tokens=False), strict=True):
            memo[chunk] = np.array(found.ids, dtype="<u4").tobytes()
        for chunk, word, tail in pairs:
            memo[chunk] = memo[word] + memo[tail] if tail else memo[word]

    def packed(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        chunks = (text or "").encode("utf-8", "replace").split()  # of bytes: at ASCII white space only
        memo = self._memo
        if len(memo) > self._most:
            memo.clear()
        fresh = {c for c in chunks if c not in memo}
        if fresh:
            self._learn(fresh)
        return b"".join(map(memo.__getitem__, chunks))


#: Latin letters that lower-case one to one, then punctuation without apostrophes and angle brackets.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:*$%&#|()\"+=/@-]*)\\Z")


def pieces(docs: DataFrame, tokenizer: str, context: int = CONTEXT, memo: int = MEMO) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document, its end token (id 0) included."""

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        chunked = ChunkTokenizer(tokenizer, memo)
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["text"], strict=True):
                ids = chunked.packed(text) + b"\0\0\0\0"
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, context)):
                    part = ids[4 * start : 4 * (start + context)]
                    rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_documents(docs, ["text"], batch, schema)


def best_fit(lengths: list[int], context: int = CONTEXT) -> list[list[int]]:
    """Best-fit decreasing: lists of item numbers.  Open bins are kept by residual, a bit mask finds the tightest."""
    by_room: list[list[list[int]]] = [[] for _ in range(context + 1)]
    mask = 0
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size = lengths[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, bin_ = context, []
            out.append(bin_)
        bin_.append(i)
        room -= size
        by_room[room].append(bin_)
        mask |= 1 << room
    return out


_BINS = "node long, closed boolean, size long, members array<struct<doc_id: string, piece: int, start: bigint, length: bigint, ids_crc32: bigint>>, sequence_id long"


def _round(items: DataFrame, level: int, last: bool, context: int, slack: int) -> DataFrame:
    """``items``: node, size, members.  Bins of each node; open ones are items for its parent."""

    def node(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["size", "order"], ascending=[False, True], kind="stable")
        sizes, members = f["size"].tolist(), f["members"].tolist()
        bins = best_fit(sizes, context)
        total = [sum(sizes[i] for i in b) for b in bins]
        emptiest = sorted(range(len(bins)), key=lambda k: total[k])[:CARRY]
        up = set() if last else {k for k in emptiest if total[k] < context - slack}
        number = (level << 56) + (int(key[0]) << 24)
        return pd.DataFrame(
            {
                "node": int(key[0]),
                "closed": [k not in up for k in range(len(bins))],
                "size": total,
                "members": [[m for i in b for m in members[i]] for b in bins],
                "sequence_id": [number + k for k in range(len(bins))],
            }
        )

    return items.groupBy("node").applyInPandas(node, _BINS)


def pack(docs: DataFrame, tokenizer: str, context: int = CONTEXT, slack: int = SLACK, memo: int = MEMO) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.  ``memo``: chunks of text a worker remembers, about 250 bytes each."""
    cut = materialize(pieces(docs, tokenizer, context, memo), "pack-pieces")
    row = F.struct(F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", "length", "ids_crc32")
    full = cut.where(F.col("length") == context).select(*cut.columns, (F.monotonically_increasing_id() + (1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < context)
    leaves = max(1, -(-rest.count() // LEAF))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    items = rest.select(F.pmod(order, F.lit(leaves)).alias("node"), F.col("length").alias("size"), F.array(row).alias("members"), order.alias("order"))
    closed, level = [], 0
    while True:
        last = leaves == 1
        bins = materialize(_round(items, level, last, context, slack), f"pack-bins{level}")
        closed.append(bins.where("closed").select("members", "sequence_id"))
        if last:
            break
        leaves, level = -(-leaves // FAN_IN), level + 1
        items = bins.where(~F.col("closed")).select(F.floor(F.col("node") / FAN_IN).alias("node"), "size", "members", F.xxhash64("sequence_id").alias("order"))
    packed = closed[0]
    for more in closed[1:]:
        packed = packed.unionByName(more)
    ahead = F.transform("members", lambda m, i: F.aggregate(F.slice("members", 1, i), F.lit(0).cast("long"), lambda t, x: t + x["length"]))
    placed = packed.select("sequence_id", F.explode(F.arrays_zip(F.col("members").alias("m"), ahead.alias("offset"))).alias("x")).select(
        F.col("x.m.doc_id").cast("bigint").alias("doc_id"), "x.m.piece", "x.m.start", "x.m.length", "x.m.ids_crc32", "sequence_id", "x.offset"
    )
    return full.unionByName(placed)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
