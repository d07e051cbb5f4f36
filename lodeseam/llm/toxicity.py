"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.  The windows of a text are its overlapping
pairs of words; a window's gain is the bytes that the toxic dictionary saves over the ordinary one.  A document's gains are
summarised (their mean, and how many reach each of six thresholds), and a logistic curve fitted on labelled documents turns
the summary into a score, which calibrates the thresholds.

Words alone repeat, so their own gains are remembered; a window is compressed if one of its words gains ``WORTH`` bytes or
more, and counts the lesser gain of its words otherwise.  A window is too short to compress by itself, so each is followed
by the same run of bytes, which ends both dictionaries.

What makes toxic text toxic is a small part of it.  The toxic dictionary is trained on the words of toxic documents that hold
a run of GRAM characters far commoner in toxic documents than in ordinary ones (log odds of document frequency), the
ordinary one on all other words of ordinary documents; all of them would fill the toxic dictionary with ordinary words.

The fit is on a bounded sample of labelled documents (``SAMPLE``; documents over ``SAMPLE_CHARS`` are not in it); a third
of it is kept from the dictionaries and weighs in the curve only.  Every document is scored whole.

Defined cases: a null or empty text has one empty window of gain zero, a text of one word that word; labels without a
document or with a null are not learned from; without labels of both kinds the score is the share of toxic labels, or 0;
repeated labels count once, the toxic one first; null and repeated ids and repeated rows are scored row by row; ties in the
choice of a setting go to the first; a very long text is scored whole, its words remembered up to MEMO; an empty table gives
an empty result; neither labels nor any column but the text enter a score.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_documents, table

#: Labelled documents of each kind in the fit, about and at most, and the longest of them.
SAMPLE = {1: 3000, 0: 6000}
SAMPLE_CHARS = 60_000
#: Characters of all texts of a label together that the fit takes: in order of draw, until they are used up.
TOTAL_CHARS = 30_000_000
#: Settings tried: bytes of the toxic and of the ordinary dictionary, and the log odds beyond COMMONER, in standard errors,
#: from which on a run of characters marks a word.  The setting that ranks the documents kept from the dictionaries best is used.
SETTINGS = ((6144, 32768, 5.0), (6144, 32768, 3.5), (6144, 32768, 2.5))
#: How many times as common in toxic documents a run has to be before any log odds count: toxic documents may be longer than
#: others, or fewer of them empty, which makes ordinary runs commoner too, with little error where documents are many.
COMMONER = 2
#: Characters of a run, and toxic documents it occurs in, at least.
GRAM, MIN_DOCS = 5, 4
#: Samples of the ordinary dictionary, at most; they are shuffled first.
ORDINARY_SAMPLES = 300_000
#: Bytes a word has to gain for its windows to be compressed.
WORTH = 3
THRESHOLDS = (1, 2, 3, 4, 5, 6)
MEMO = 600_000
TAIL = bytes(b for b in range(1, 32) if b != 10)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams(word: bytes, known: dict[bytes, bytes]) -> tuple[bytes, ...]:
    """Runs of GRAM bytes of a word with a blank at either end; ``known`` lets equal runs share their memory."""
    whole = b" " + word + b" "
    runs = (whole[i : i + GRAM] for i in range(max(1, len(whole) - GRAM + 1)))
    return tuple({known.setdefault(g, g) for g in runs})


def _train(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=8, level=3).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(dict.fromkeys(samples))[-size:]


def _length(content: bytes):
    """window -> compressed bytes, under a dictionary."""
    own = zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=14, chain_log=15, search_log=4, min_match=3, target_length=32,
        strategy=zstandard.STRATEGY_BTULTRA, write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    own.precompute_compress(compression_params=params)
    compress = zstandard.ZstdCompressor(compression_params=params, dict_data=own).compress
    return lambda window: len(compress(b" " + window + b" " + TAIL))


class Gains:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self._toxic, self._ordinary = _length(toxic), _length(ordinary)
        self._memo: dict[bytes, int] = {}

    def _own(self, window: bytes) -> int:
        memo = self._memo
        if window not in memo:
            if len(memo) > MEMO:
                memo.clear()
            memo[window] = self._ordinary(window) - self._toxic(window)
        return memo[window]

    def of(self, text: str | None) -> np.ndarray:
        """The gain of every window."""
        found = words(text) or [b""]
        own = np.fromiter(map(self._own, found), dtype=np.int16, count=len(found))
        if len(own) == 1:
            return own
        gains = np.minimum(own[:-1], own[1:])
        for i in np.flatnonzero(np.maximum(own[:-1], own[1:]) >= WORTH).tolist():
            gains[i] = self._own(found[i] + b" " + found[i + 1])
        return gains

    def summary(self, text: str | None) -> list[float]:
        g = self.of(text)
        n = len(g)
        reach = [int((g >= t).sum()) for t in THRESHOLDS]
        return [float(g.mean()), *[r / n for r in reach], *[math.log1p(r) for r in reach], *[min(r, 1) for r in reach], math.log1p(n)]


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float

    def scorer(self):
        if not self.weights:
            return lambda text: self.prior
        gains, mean, scale, w = Gains(self.toxic, self.ordinary), np.array(self.mean), np.array(self.scale), np.array(self.weights)

        def score(text: str | None) -> float:
            x = float(np.dot(w[:-1], (np.array(gains.summary(text)) - mean) / scale) + w[-1])
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

        return score


def fit(rows: list[tuple[int, str, int]], weight: dict[int, float], prior: float) -> ToxicityModel:
    """``rows``: (fold 0 to 2, text, label), a bounded sample; ``weight``: how many labelled documents a row of a label stands for."""
    rows = list(dict.fromkeys(rows))  # copies would make any of their words recur
    if len({y for _, _, y in rows}) < 2:
        return ToxicityModel(b"", b"", (), (), (), prior)
    docs: dict[int, Counter] = {0: Counter(), 1: Counter()}
    own: dict[int, Counter] = {0: Counter(), 1: Counter()}
    n = {0: 0, 1: 0}
    of_word: dict[bytes, tuple[bytes, ...]] = {}
    known: dict[bytes, bytes] = {}
    for fold, text, y in rows:
        if fold:
            found = words(text)
            distinct = set(found)
            for w in distinct:
                if w not in of_word:
                    of_word[w] = grams(w, known)
            docs[y].update(set().union(*(of_word[w] for w in distinct)))
            own[y].update(distinct if y else found)
            n[y] += 1

    def z(gram: bytes) -> float:
        a, b = docs[1][gram], docs[0][gram]
        odds = math.log((a + 0.5) / (n[1] - a + 0.5)) - math.log((b + 0.5) / (n[0] - b + 0.5))
        return (odds - math.log(COMMONER)) / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))

    odds = {g: z(g) for g, a in docs[1].items() if a >= MIN_DOCS}
    del docs, known
    held = [r for r in rows if not r[0]]
    pure = np.array([r[2] for r in held], dtype=float)
    held += [r for r in rows if r[0]][: len(held) // 2]
    if len(held) < 20 or not pure.size or pure.min() == pure.max():
        held, pure = rows, np.array([r[2] for r in rows], dtype=float)
    y = np.array([r[2] for r in held], dtype=float)
    each = np.where(y == 1, weight[1], weight[0])
    best: tuple[float, ToxicityModel] | None = None
    for toxic_bytes, ordinary_bytes, least in SETTINGS:
        marks = {g for g, o in odds.items() if o > least}
        toxic = [b" " + w + b" " for w, a in sorted(own[1].items()) if not marks.isdisjoint(of_word[w]) for _ in range(min(a, 30))]
        ordinary = [b" " + w + b" " for w, c in sorted(own[0].items()) if marks.isdisjoint(of_word[w]) for _ in range(min(8, 1 + int(math.log2(c))))]
        random.Random(7).shuffle(toxic)
        random.Random(7).shuffle(ordinary)
        dictionaries = _train(toxic, toxic_bytes), _train(ordinary[:ORDINARY_SAMPLES], ordinary_bytes)
        gains = Gains(*dictionaries)
        x = np.array([gains.summary(t) for _, t, _ in held])
        mean, scale, w = _curve(x, y, each / each.mean())
        ranks = np.argsort(np.argsort((x[: len(pure)] - mean) / scale @ w[:-1], kind="stable"))
        area = float(ranks[pure == 1].mean() - ranks[pure == 0].mean())
        if best is None or area > best[0]:
            best = area, ToxicityModel(*dictionaries, tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), prior)
    return best[1]


def _curve(x: np.ndarray, y: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights of a logistic curve with a ridge, by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    design, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (each * p * (1 - p))[:, None]).T @ design + np.eye(len(w))
        w = w - np.linalg.solve(hessian, design.T @ (each * (p - y)) + w)
    return mean, scale, w


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> ToxicityModel:
    """Fit on labelled documents that are not held out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = total[1] / max(1, total[0] + total[1])
    share = {y: min(1.0, 0.9 * sample[y] / max(1, total[y])) for y in (0, 1)}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_003))
    limit = F.when(F.col("toxic") == 1, int(share[1] * 1_000_003) + 1).otherwise(int(share[0] * 1_000_003) + 1)
    chosen = known.where(draw < limit)  # at most the bound of documents: small enough to send to every task
    rows = (
        docs.select("doc_id", "text")
        .where(F.char_length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(chosen), "doc_id")
        .withColumn("_before", F.sum(F.char_length("text")).over(Window.partitionBy("toxic").orderBy(draw, "doc_id")))
        .withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy("toxic")))
        .where(F.col("_before") <= TOTAL_CHARS)
        .select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).alias("fold"), "text", "toxic", "_of")
        .collect()
    )
    for y in (0, 1):  # a label whose characters ran out stands for as many documents as before
        own = [r for r in rows if r["toxic"] == y]
        share[y] *= len(own) / own[0]["_of"] if own else 1
    rows.sort(key=lambda r: r["doc_id"])
    return fit([(r["fold"], r["text"], r["toxic"]) for r in rows], {y: 1 / share[y] for y in (0, 1)}, prior)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "score": [score(t) for t in f["text"]]})

    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    scored = map_documents(marked, ["held_out", "text"], batch, "held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
