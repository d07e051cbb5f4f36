"""LM scoring: a bigram Katz model with Good-Turing discounts and exactly normalised backoff weights.

    P(w | h) = d(c) c(h, w) / c(h)                       if h w was seen
               alpha(h) P(w)                             else,  alpha(h) = (1 - seen mass of h) / (1 - sum of P over words seen after h)
    P(w)     = d(c) c(w) / N                             if w was seen;  what is left is the unknown word's

Counts live in tables partitioned by word and by pair, sized so that a part fits in a worker; rows are compressed arrays.
Documents are cut into chunks once.  A chunk asks the word parts for its distinct words, then the pair parts for its
distinct pairs, and scores its tokens from the answers, so texts are read once, every shuffled row is distinct within its
chunk, and no table of words or pairs is ever in one place.  Pairs are dealt by their history; a history so frequent that
its pairs would overfill a part is spread over several by the next word, and its sums are added up afterwards.

Discounts are Katz's for counts to five.  Where the counts of counts cannot give them (few data) half a count is taken off.
Larger counts give up one part in N + 1, which keeps every backoff weight positive and every distribution summing to one.

Defined cases: a null text is empty and is its end token alone; a null ``doc_id`` counts as an empty string in the split;
repeated ids are scored row by row; a very long text stays in one chunk;
without training documents every word is unknown, with probability one; repeated rows count as often as they occur;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Text of a chunk, and text for each part of the tables, in bytes.
CHUNK_BYTES = 8 << 20
PART_BYTES = 16 << 20
#: A history with more tokens than this, and than this share of all tokens, is spread over several parts: so there are never
#: more than HOT_MOST such histories, whose sums reach every task.
HOT_TOKENS = 200_000
HOT_MOST = 20_000
K = 5
#: A token no text contains: the end of a document.
END = b"\x0b"
START_ID = 0

_ROW = "chunk string, kind string, part int, n bigint, stats array<double>, a binary, b binary, c binary, d binary, e binary, f binary"


def _pack(x: np.ndarray | bytes) -> bytes:
    """Compressed bytes; an array goes byte plane by byte plane, as most high bytes are zero."""
    if not isinstance(x, bytes):
        x = np.ascontiguousarray(x)
        x = x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(x)


def _unpack(x: bytes, dtype=None):
    raw = zstandard.ZstdDecompressor().decompress(bytes(x))
    if dtype is None:
        return raw
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _row(**values) -> dict:
    return {"chunk": None, "kind": None, "part": -1, "n": 0, "stats": None, "a": None, "b": None, "c": None, "d": None, "e": None, "f": None} | values


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["chunk", "kind", "part", "n", "stats", "a", "b", "c", "d", "e", "f"])


def discounts(counts_of_counts: list[float], total: float) -> np.ndarray:
    """d[r] for r = 0 to K + 1; the last is for all larger counts.  ``counts_of_counts``: n_1 to n_(K+1)."""
    n = [0.0, *counts_of_counts]
    d = np.array([0.0] + [(r - 0.5) / r for r in range(1, K + 1)] + [1 - 1 / (total + 1)])
    if all(x > 0 for x in n[1:]) and (K + 1) * n[K + 1] < n[1]:
        tail = (K + 1) * n[K + 1] / n[1]
        turing = [((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) for r in range(1, K + 1)]
        if all(0 < x < 1 for x in turing):
            d[1 : K + 1] = turing
    return d


class Unigrams:
    """P(w) from a word's count, and what the unknown word gets."""

    def __init__(self, stats: list[float]):
        self.total, self.types = stats[0], stats[1]
        self.d = discounts(stats[2 : 3 + K], self.total)
        small = sum(self.d[r] * r * stats[1 + r] for r in range(1, K + 1))
        rest = self.total - sum(r * stats[1 + r] for r in range(1, K + 1))
        self.unknown = 1 - (small + self.d[K + 1] * rest) / self.total if self.total else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        seen = self.d[np.minimum(count, K + 1).astype(np.int64)] * count / max(self.total, 1)
        return np.where(count > 0, seen, self.unknown)


def _occupied(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, start, stop) of each part that a sorted array of parts has: the work is by what is there, not by how many parts there are."""
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
    return [(int(part[i]), i, j) for i, j in zip(edges[:-1], edges[1:])]


def _chunks(docs: DataFrame, parts: int) -> DataFrame:
    """A 'stream' row for each chunk, and its distinct words as 'words' rows, one for each word part."""

    def chunk(name: str, ids: list, texts: list[list[bytes]], train: list[bool]) -> list[dict]:
        words: list[bytes] = []
        for t in texts:
            words += t
            words.append(END)
        lens = np.array([len(t) + 1 for t in texts], dtype=np.uint32)
        distinct = list(dict.fromkeys(words))
        part = np.array([xxhash.xxh64_intdigest(w) % parts for w in distinct], dtype=np.int32)
        order = np.argsort(part, kind="stable")  # words are numbered part by part
        distinct = [distinct[i] for i in order]
        part = part[order]
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        stream = np.fromiter(map(number.__getitem__, words), dtype=np.uint32, count=len(words))
        counted = np.bincount(stream[np.repeat(np.array(train, dtype=bool), lens)], minlength=len(distinct)).astype(np.uint32)
        rows = [
            _row(
                chunk=name,
                kind="stream",
                n=len(distinct),
                a=_pack(stream),
                b=_pack(lens),
                c=_pack(np.array(train, dtype=np.uint8)),
                d=_pack(np.array([int(i or 0) for i in ids], dtype=np.int64)),
                e=_pack(np.array([i is None for i in ids], dtype=np.uint8)),
            )
        ]
        for p, lo, hi in _occupied(part):
            rows.append(_row(chunk=name, kind="words", part=p, n=hi - lo, a=_pack(b"\n".join(distinct[lo:hi])), b=_pack(counted[lo:hi])))
        return rows

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partition, k = TaskContext.get().partitionId(), 0
        ids, texts, train, size = [], [], [], 0
        for f in frames:
            for i, text, t in zip(f["doc_id"], f["text"], f["train"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass").lower()  # on bytes lower and split act on ASCII only
                ids.append(i)
                texts.append(raw.split())
                train.append(bool(t))
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield _frame(chunk(f"{partition}-{k}", ids, texts, train))
                    ids, texts, train, size, k = [], [], [], 0, k + 1
        if ids:
            yield _frame(chunk(f"{partition}-{k}", ids, texts, train))

    return docs.mapInPandas(batch, _ROW)


def _word_table(chunks: DataFrame, parts: int) -> DataFrame:
    """For each word part its 'unigrams' (words and training counts), and for each chunk that asked 'ids' (id, count)."""

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("chunk")
        number: dict[bytes, int] = {}
        asked, counted = [], []
        for a, b in zip(f["a"], f["b"], strict=True):
            words = _unpack(a).split(b"\n")
            for w in words:
                if w not in number:
                    number[w] = len(number)
            asked.append(np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)))
            counted.append(_unpack(b, np.uint32))
        count = np.bincount(np.concatenate(asked), weights=np.concatenate(counted), minlength=len(number)).astype(np.int64)
        part = int(f["part"].iloc[0])
        stats = [float(count.sum()), float((count > 0).sum())] + [float((count == r).sum()) for r in range(1, K + 2)]
        rows = [_row(kind="unigrams", part=part, n=len(number), stats=stats, a=_pack(b"\n".join(number)), b=_pack(count))]
        for chunk, ids in zip(f["chunk"], asked, strict=True):
            rows.append(_row(chunk=chunk, kind="ids", part=part, n=len(ids), a=_pack(ids * parts + part + 1), b=_pack(count[ids])))
        return _frame(rows)

    return chunks.where("kind = 'words'").groupBy("part").applyInPandas(merge, _ROW)


class _Chunk:
    """A chunk's tokens with the ids and counts of its words, and its distinct pairs in the order of their requests."""

    def __init__(self, f: pd.DataFrame, parts: int, hot_tokens: int):
        stream = f[f["kind"] == "stream"].iloc[0]
        words = f[f["kind"] == "ids"].sort_values("part")
        self.name = stream["chunk"]
        self.tokens = _unpack(stream["a"], np.uint32).astype(np.int64)
        self.lens = _unpack(stream["b"], np.uint32).astype(np.int64)
        self.train = _unpack(stream["c"], np.uint8).astype(bool)
        self.doc_ids, self.no_id = _unpack(stream["d"], np.int64), _unpack(stream["e"], np.uint8).astype(bool)
        self.ids = np.concatenate([_unpack(x, np.int64) for x in words["a"]])
        self.counts = np.concatenate([_unpack(x, np.int64) for x in words["b"]])
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        n = len(self.ids)
        end = self.tokens[self.lens[0] - 1]
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = n  # one past the words: the start of a document
        history_ids = np.append(self.ids, START_ID)
        history_counts = np.append(self.counts, self.counts[end])
        key, self.pair = np.unique(before * (n + 1) + self.tokens, return_inverse=True)
        h, self.w = key // (n + 1), key % (n + 1)
        self.h_id, self.h_count = history_ids[h], history_counts[h]
        spread = np.maximum(1, self.h_count // hot_tokens).astype(np.uint64)
        mix = lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        sub = np.where(spread > 1, mix(self.ids[self.w]) % spread, 0).astype(np.uint64)
        self.hot = spread > 1
        self.part = (mix(self.h_id.astype(np.uint64) + sub * np.uint64(7919)) % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(self.part, kind="stable")
        self.runs = _occupied(self.part[self.order])


def _pair_requests(chunks: DataFrame, words: DataFrame, parts: int, hot_tokens: int) -> DataFrame:
    def ask(f: pd.DataFrame) -> pd.DataFrame:
        c = _Chunk(f, parts, hot_tokens)
        trained = np.repeat(c.train, c.lens)
        count = np.bincount(c.pair[trained], minlength=len(c.w)).astype(np.uint32)
        rows = []
        for p, lo, hi in c.runs:
            own = c.order[lo:hi]
            first = np.flatnonzero(np.diff(c.h_id[own], prepend=-1))
            runs = np.diff(np.append(first, len(own))).astype(np.uint32)
            rows.append(
                _row(
                    chunk=c.name,
                    kind="pairs",
                    part=p,
                    n=len(own),
                    a=_pack(c.h_id[own][first]),
                    b=_pack(runs),
                    c=_pack(c.hot[own][first].astype(np.uint8)),
                    d=_pack(c.ids[c.w[own]]),
                    e=_pack(count[own]),
                    f=_pack(c.counts[c.w[own]]),
                )
            )
        return _frame(rows)

    rows = chunks.where("kind = 'stream'").unionByName(words.where("kind = 'ids'"))
    return rows.groupBy("chunk").applyInPandas(ask, _ROW)


def _pair_table(requests: DataFrame, unigrams: Unigrams) -> DataFrame:
    """For each pair part its 'bigrams'; for each chunk 'answers'; 'hot' sums of histories that are spread.

    A history's sums are n_1 to n_5, the tokens of larger counts, and the sum of P over the words seen after it.
    """

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("chunk")
        runs = [_unpack(x, np.uint32) for x in f["b"]]
        heads = [_unpack(x, np.int64) for x in f["a"]]
        h_values, h_all = np.unique(np.concatenate([np.repeat(x, r) for x, r in zip(heads, runs, strict=True)]), return_inverse=True)
        w_values, w_all = np.unique(np.concatenate([_unpack(x, np.int64) for x in f["d"]]), return_inverse=True)
        key, asked = np.unique(h_all * len(w_values) + w_all, return_inverse=True)
        del h_all, w_all
        count = np.bincount(asked, weights=np.concatenate([_unpack(x, np.uint32) for x in f["e"]]), minlength=len(key)).astype(np.int64)
        of_word = np.zeros(len(key), dtype=np.int64)
        of_word[asked] = np.concatenate([_unpack(x, np.int64) for x in f["f"]])
        seen = count > 0
        h, w, c = key[seen] // len(w_values), key[seen] % len(w_values), count[seen]
        sums = np.zeros((len(h_values), K + 2))
        for r in range(1, K + 1):
            sums[:, r - 1] = np.bincount(h[c == r], minlength=len(h_values))
        sums[:, K] = np.bincount(h[c > K], weights=c[c > K], minlength=len(h_values))
        sums[:, K + 1] = np.bincount(h, weights=unigrams.p(of_word[seen]), minlength=len(h_values))
        part = int(f["part"].iloc[0])
        stats = [float((c == r).sum()) for r in range(1, K + 2)]
        rows = [_row(kind="bigrams", part=part, n=len(c), stats=stats, a=_pack(h_values[h]), b=_pack(w_values[w]), c=_pack(c))]
        at, hot_ids = 0, set()
        for chunk, n, head, run, hot in zip(f["chunk"], f["n"], heads, runs, f["c"], strict=True):
            own = count[asked[at : at + n]]
            at += n
            starts = np.concatenate([[0], np.cumsum(run)[:-1]]).astype(np.int64)
            unseen = np.minimum.reduceat(own, starts) == 0
            rows.append(_row(chunk=chunk, kind="answers", part=part, n=int(n), a=_pack(own), b=_pack(sums[np.searchsorted(h_values, head[unseen])])))
            hot_ids.update(head[_unpack(hot, np.uint8).astype(bool)].tolist())
        for i in sorted(hot_ids):
            rows.append(_row(kind="hot", part=part, n=int(i), stats=sums[np.searchsorted(h_values, i)].tolist()))
        return _frame(rows)

    return requests.groupBy("part").applyInPandas(merge, _ROW)


def _scores(chunks: DataFrame, words: DataFrame, answers: DataFrame, parts: int, unigrams: Unigrams, d: np.ndarray, hot: dict[int, list[float]], hot_tokens: int) -> DataFrame:
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def score(f: pd.DataFrame) -> pd.DataFrame:
        c = _Chunk(f, parts, hot_tokens)
        got = f[f["kind"] == "answers"].sort_values("part")
        count, alpha = np.empty(len(c.w), dtype=np.int64), np.ones(len(c.w))
        place = {p: (lo, hi) for p, lo, hi in c.runs}
        for p, a, b in zip(got["part"], got["a"], got["b"], strict=True):
            lo, hi = place[p]
            own = c.order[lo:hi]
            count[own] = _unpack(a, np.int64)
            sums = _unpack(b, np.float64).reshape(-1, K + 2)
            first = np.flatnonzero(np.diff(c.h_id[own], prepend=-1))
            unseen = np.minimum.reduceat(count[own], first) == 0
            spread = np.flatnonzero(c.hot[own][first][unseen])
            if len(spread):
                sums = sums.copy()
                sums[spread] = [hot[int(i)] for i in c.h_id[own][first][unseen][spread]]
            total = np.maximum(c.h_count[own][first][unseen], 1)
            mass = sums[:, :K] @ (d[1 : K + 1] * np.arange(1, K + 1)) + d[K + 1] * sums[:, K]
            weight = np.where(mass > 0, (1 - mass / total) / np.maximum(1 - sums[:, K + 1], unigrams.unknown), 1.0)
            per_head = np.ones(len(first))
            per_head[unseen] = weight
            alpha[own] = np.repeat(per_head, np.diff(np.append(first, len(own))))
        of_word = c.counts[c.w]
        backed_off = alpha * unigrams.p(of_word)
        p = np.where(count > 0, d[np.minimum(count, K + 1)] * count / np.maximum(c.h_count, 1), backed_off)
        token_score = np.log10(p)[c.pair]
        base = np.log10((c.counts + 0.1) / (unigrams.total + 0.1 * (unigrams.types + 1)))
        return pd.DataFrame(
            {
                "doc_id": pd.Series(c.doc_ids).astype("Int64").mask(c.no_id),
                "held_out": ~c.train,
                "n_tokens": c.lens,
                "n_known": np.add.reduceat((c.counts > 0)[c.tokens].astype(np.int64), c.starts),
                "train_tokens": int(unigrams.total),
                "base_score": np.add.reduceat(base[c.tokens], c.starts),
                "score": np.add.reduceat(token_score, c.starts),
            }
        )

    rows = chunks.where("kind = 'stream'").unionByName(words.where("kind = 'ids'")).unionByName(answers.where("kind = 'answers'"))
    return rows.groupBy("chunk").applyInPandas(score, schema)


def _sums(rows: DataFrame, n: int) -> list[float]:
    found = rows.agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n)]).first()
    return [float(x or 0) for x in found]


def score_documents(docs: DataFrame, fold: int = 10) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod ``fold`` is not 0 and score all."""
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % fold != 0
    chosen = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", train.alias("train"))  # text keeps nulls and large ids whole
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2, -(-size // PART_BYTES))
    chunks = materialize(_chunks(chosen, parts), "katz-chunks", "kind")
    words = materialize(_word_table(chunks, parts), "katz-unigrams", "kind")
    unigrams = Unigrams(_sums(words.where("kind = 'unigrams'"), K + 3))
    hot_tokens = max(HOT_TOKENS, int(unigrams.total) // HOT_MOST)
    pairs = materialize(_pair_table(_pair_requests(chunks, words, parts, hot_tokens), unigrams), "katz-bigrams", "kind")
    d = discounts(_sums(pairs.where("kind = 'bigrams'"), K + 1), unigrams.total)
    spread = pairs.where("kind = 'hot'").groupBy("n").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(K + 2)])
    hot = {r["n"]: [r[f"s{i}"] for i in range(K + 2)] for r in spread.collect()}  # HOT_MOST rows at most
    return _scores(chunks, words, pairs, parts, unigrams, d, hot, hot_tokens)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
