"""Removal of repeated byte strings: every byte that lies in a string of ``length`` bytes which also starts earlier goes.

Suffix buckets are refined as in bucket-pointer refinement, spread over Spark tasks.  A bucket identifier names the bytes
it stands for, so that tasks which never met agree on it.

* Initial buckets.  Every window of ``length`` bytes is filed under the smallest q-gram identifier within it (ties: the
  first place), at its ``anchor``.  Equal windows have equal anchors at equal offsets, and neighbouring windows share
  one, so about one place in 40 has to be looked at.  A bucket that holds one context is finished, as in any bucket sort.
* Refinement.  The windows of an anchor differ in their offset before it.  A bucket with several contexts is split by
  offset range, and each half is filed under the identifier of the bytes that all its windows share, which reach to later
  offsets on both sides; so on recursively, until a bucket holds one context or one window.  Members of a bucket with equal
  contexts need no further sorting: the first stays, the windows of the others are repeats.
* Each block of documents refines what it holds by itself first, and sends one row for a bucket and context.  A bucket that
  it had to split is announced to the others by two rows.  So no bucket, however common its bytes, gets more than two
  rows from a block, and no task gathers the copies of anything.

The initial identifiers travel packed (12 bytes an anchor); their verdicts return to the block, which then makes rows only
for buckets that others share.  Texts travel twice, compressed in blocks, to meet the verdicts.

Identifiers: 64 bits for a bucket, where a chance match costs time only, and 128 bits for a context, where it is
taken for equality.

Defined cases: a null text is empty; a text shorter than ``length`` bytes loses nothing; order is doc_id (null first), then
the place in the table for rows with the same doc_id, then the start; every row gets an answer, repeated ids and rows
included; a text of any length is worked on in strips; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

LENGTH = 100
GRAM = 24
#: Bytes of text in a block, window starts in a strip, bytes of text behind a part of the initial buckets.
BLOCK, STRIP, PART = 2 << 20, 1 << 19, 32 << 20
#: A range of at most so many offsets is split into single windows at once.
FEW = 8
#: Contexts that a block refines together.
MEMBERS = 20_000
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POSITION_BITS = 21  # of a strip: STRIP + length < 2 ** 21
_LEAST = -(1 << 63)
#: The cut of rows whose bucket has one context in each block: level 1, like the first split; a cut is level, least and largest offset.
_SAME = 1 << 14 | 127 << 7


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


class Names:
    """Identifiers of byte strings: polynomials modulo 2**64 over random byte values, mixed."""

    def __init__(self, size: int):
        rng = np.random.default_rng(7)
        self.values = [rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1) for _ in _BASES]
        self.powers = [self._powers(b, size + 1) for b in _BASES]
        self.inverse = [self._powers(pow(b, -1, 1 << 64), size + 1) for b in _BASES]

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.cumprod(p, dtype=np.uint64)

    def prefix(self, x: np.ndarray, k: int) -> np.ndarray:
        """Sums whose differences are identifiers, along the last axis."""
        n = x.shape[-1]
        out = np.zeros((*x.shape[:-1], n + 1), np.uint64)
        np.cumsum(self.values[k][x] * self.powers[k][:n], axis=-1, dtype=np.uint64, out=out[..., 1:])
        return out


def _anchors(x: np.ndarray, stops: np.ndarray, names: Names, length: int, gram: int, strip: int) -> dict[str, np.ndarray]:
    """The anchors of concatenated texts ``x`` that end at ``stops``.

    at: the anchor's place, low and high: how far its windows start before it, bucket, and two identifiers of the
    bytes under its windows, which also depend on low and high.
    """
    wide = length - gram + 1
    parts: list[tuple] = []
    for begin in range(0, max(0, len(x) - length + 1), strip):
        y = x[begin : begin + strip + length - 1]
        n = len(y) - length + 1
        sums = names.prefix(y, 0)
        grams = sums[gram:] - sums[:-gram]
        grams *= names.inverse[0][: len(grams)]
        grams = _mix(grams)
        key = (grams >> _U(_POSITION_BITS)) << _U(_POSITION_BITS)
        key |= np.arange(len(key), dtype=np.uint64)
        done = 1
        while done * 2 <= wide:
            key = np.minimum(key[:-done], key[done:])
            done *= 2
        if wide > done:
            key = np.minimum(key[: len(key) - (wide - done)], key[wide - done :])
        place = (key & _U((1 << _POSITION_BITS) - 1)).astype(np.int64)
        start = np.arange(begin, begin + n)
        at_text = np.searchsorted(stops, start[[0, -1]], side="right")
        inner = stops[at_text[0] : at_text[1] + 1]
        bad = np.zeros(n + 1, np.int32)  # starts whose window would pass the end of a text
        np.add.at(bad, np.clip(inner - length + 1 - begin, 0, n), 1)
        np.add.at(bad, np.clip(inner - begin, 0, n), -1)
        # texts shorter than a window: their marks overlap, so count
        good = np.cumsum(bad[:-1]) == 0
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (place[1:] != place[:-1]) | (good[1:] != good[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        keep = good[first]
        first, last = first[keep], last[keep]
        p = place[first]
        low, high = p - last, p - first
        shape = (low * 128 + high).astype(np.uint64)
        contexts = []
        for k in range(2):
            s = sums if k == 0 else names.prefix(y, 1)
            contexts.append(_mix((s[last + length] - s[first]) * names.inverse[k][first] + shape * _U(0x9E3779B97F4A7C15)))
        parts.append((p + begin, low, high, grams[p], *contexts))
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 3
    return dict(zip(("at", "low", "high", "bucket", "one", "two"), columns))


class _Block:
    """Some documents of a table: ids, place order, concatenated bytes."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, data: np.ndarray):
        self.ids, self.data = ids, data
        self.stops = np.cumsum(lens)
        self.starts = self.stops - lens

    def local_first(self, names: Names, length: int, gram: int, strip: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Anchors in order of (bucket, context, place); which of them come first of their context; each one's document."""
        a = _anchors(self.data, self.stops, names, length, gram, strip)
        doc = np.searchsorted(self.stops, a["at"], side="right")
        order = np.lexsort((a["at"], doc, self.ids[doc], a["two"], a["one"], a["bucket"]))
        a, doc = {k: v[order] for k, v in a.items()}, doc[order]
        first = np.ones(len(doc), bool)
        first[1:] = (a["bucket"][1:] != a["bucket"][:-1]) | (a["one"][1:] != a["one"][:-1]) | (a["two"][1:] != a["two"][:-1])
        return a, first, doc


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, _Block, np.ndarray]]:
    """(number, block, which ids are null), cut from the rows of a task; the same for every scan of a partition."""
    number = TaskContext.get().partitionId() << 20
    for batch in batches:
        col, key = batch.column("text"), batch.column("doc_id")
        n = len(batch)
        if not n:
            continue
        _, offsets, data = col.buffers()
        offsets = np.frombuffer(offsets, np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        lens = np.diff(offsets)
        if col.null_count:
            lens[np.asarray(col.is_null())] = 0
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        null = np.asarray(key.is_null())
        numbers = np.asarray(key.fill_null(_LEAST), dtype=np.int64)
        total = np.cumsum(lens)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + size, side="right")))
            j = min(j, n, i + (1 << 20) - 1)
            yield number, _Block(numbers[i:j], lens[i:j], data[offsets[i] : offsets[j]] if not col.null_count else _gather(data, offsets[i:j], lens[i:j])), null[i:j]
            number += 1
            i = j


def _gather(data: np.ndarray, offsets: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return np.concatenate([data[o : o + k] for o, k in zip(offsets.tolist(), lens.tolist())] or [np.zeros(0, np.uint8)])


def _six(x: np.ndarray) -> np.ndarray:
    """The upper six bytes of each identifier."""
    return np.ascontiguousarray(x >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _shares(a: dict[str, np.ndarray], first: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's buckets by part: (places of the buckets' first anchors, whether several contexts, order by part, parts, edges)."""
    head = np.flatnonzero(first)
    bucket = a["bucket"][head]
    new = np.ones(len(head), bool)
    new[1:] = bucket[1:] != bucket[:-1]
    begin = np.flatnonzero(new)
    several = np.diff(np.append(begin, len(head))) > 1
    head = head[begin]
    part = (a["bucket"][head] % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    sorted_part = part[order]
    edges = np.flatnonzero(np.append(True, sorted_part[1:] != sorted_part[:-1])) if len(order) else np.zeros(0, np.int64)
    return head, several, order, sorted_part[edges], np.append(edges, len(order))


def _split(low: int, high: int) -> list[tuple[int, int]]:
    if high - low < FEW:
        return [(o, o) for o in range(low, high + 1)]
    mid = (low + high) // 2
    return [(low, mid), (mid + 1, high)]


class _Members:
    """Contexts of anchors, to be refined: a frame of bytes around each anchor, and the offsets of its windows."""

    def __init__(self, frame, low, high, doc, unit, at, names: Names, length: int):
        # frame: (n, 2 * wide + gram) bytes; column wide - 1 is the anchor's place
        self.frame, self.low, self.high, self.doc, self.unit, self.at = frame, low, high, doc, unit, at
        self.wide = frame.shape[1] - length
        self.length = length
        self.sums = [names.prefix(frame, k) for k in range(2)]

    def refine(self, rows: np.ndarray, cut: int, out: list, covered: list) -> None:
        """Split the members ``rows`` of a range of offsets; ``out`` gets rows to send, ``covered`` the repeats found here."""
        level, low, high = (cut >> 14) + 1, cut >> 7 & 127, cut & 127
        for a, b in _split(low, high):
            mine = rows[(self.low[rows] <= b) & (self.high[rows] >= a)]
            if not len(mine):
                continue
            lo, hi = np.maximum(self.low[mine], a), np.minimum(self.high[mine], b)
            w, n = self.wide, self.length
            core = _mix(self.sums[0][mine, w - b + n] - self.sums[0][mine, w - a] + _U((a * 128 + b + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            shape = (lo * 128 + hi).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
            one, two = (_mix(s[mine, w - lo + n] - s[mine, w - hi] + shape) for s in self.sums)
            order = np.lexsort((self.at[mine], self.unit[mine], self.doc[mine], two, one, core))
            mine, core, one, two, lo, hi = (v[order] for v in (mine, core, one, two, lo, hi))
            bucket_new = np.ones(len(mine), bool)
            bucket_new[1:] = core[1:] != core[:-1]
            first = bucket_new.copy()
            first[1:] |= (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            covered.append((self.unit[mine[~first]], self.at[mine[~first]] - hi[~first], self.at[mine[~first]] - lo[~first]))
            mine, core, one, two, lo, hi, bucket_new = (v[first] for v in (mine, core, one, two, lo, hi, bucket_new))
            begin = np.flatnonzero(bucket_new)
            size = np.diff(np.append(begin, len(mine)))
            alone = np.repeat(size == 1, size)
            cut = level << 14 | a << 7 | b
            out.append((mine[alone], core[alone], one[alone], two[alone], lo[alone], hi[alone], np.full(alone.sum(), cut), np.zeros(alone.sum(), bool)))
            if not alone.all():
                marks = np.concatenate([begin[size > 1], begin[size > 1] + 1])
                out.append((mine[marks], core[marks], one[marks], two[marks], lo[marks], hi[marks], np.full(len(marks), cut), np.ones(len(marks), bool)))
                self.refine(mine[~alone], cut, out, covered)


_ROW = "core bigint, one bigint, two bigint, doc bigint, unit bigint, at bigint, low int, high int, cut int, mark boolean, bytes binary"
_ROW_NAMES = ["core", "one", "two", "doc", "unit", "at", "low", "high", "cut", "mark", "bytes"]


def _rows(core, one, two, doc, unit, at, low, high, cut, mark, bytes_) -> pa.RecordBatch:
    i64 = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    i32 = lambda x: pa.array(np.asarray(x).astype(np.int32))
    return pa.RecordBatch.from_arrays([i64(core), i64(one), i64(two), i64(doc), i64(unit), i64(at), i32(low), i32(high), i32(cut), pa.array(np.asarray(mark, bool)), bytes_], _ROW_NAMES)


def _send(members: _Members, out: list) -> Iterator[pa.RecordBatch]:
    """The buckets that ``refine`` left open as rows, with the bytes of their windows if they may have to be split."""
    if out:
        mine, core, one, two, lo, hi, cut, mark = (np.concatenate(c) for c in zip(*out))
        w, n = members.wide, members.length
        start, stop = w - hi, w - lo + n
        final = ((cut >> 7 & 127) == (cut & 127)) | mark
        parts = [None if f else members.frame[m, i:j].tobytes() for m, i, j, f in zip(mine.tolist(), start.tolist(), stop.tolist(), final.tolist())]
        yield _rows(core, one, two, members.doc[mine], members.unit[mine], members.at[mine], lo, hi, cut, mark, pa.array(parts, pa.binary()))


def _found(covered: list, number: int | None = None) -> Iterator[pa.RecordBatch]:
    """Repeats as rows (``cut`` -1, first and last start in one and two), or all of a block in one row's bytes."""
    unit, lo, hi = (np.concatenate(c).astype(np.int64) for c in zip(*covered)) if covered else [np.zeros(0, np.int64)] * 3
    if not len(unit):
        return
    if number is not None:
        packed = np.stack([unit, lo, hi]).tobytes()
        unit, lo, hi = np.array([number << 20]), np.zeros(1, np.int64), np.zeros(1, np.int64)
    zero = np.zeros(len(unit), np.int64)
    yield _rows(_mix((unit + lo).view(np.uint64)), lo, hi, zero, unit, zero, zero, zero, zero - 1, zero > 0, pa.array([packed], pa.binary()) if number is not None else pa.nulls(len(unit), pa.binary()))


def _packed(number: int, block: _Block, null: np.ndarray) -> pa.RecordBatch:
    import zstandard

    blob = zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(block.data))
    lens = (block.stops - block.starts).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([v], pa.binary()) for v in (block.ids.tobytes(), null.tobytes(), lens.tobytes(), blob))], ["block", "ids", "nulls", "lens", "blob"])


_PACKED = "block bigint, ids binary, nulls binary, lens binary, blob binary"


def _unpacked(row: dict) -> tuple[_Block, np.ndarray]:
    import zstandard

    lens = np.frombuffer(row["lens"], np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=int(lens.sum())) if lens.sum() else b""
    return _Block(np.frombuffer(row["ids"], np.int64), lens, np.frombuffer(data, np.uint8)), np.frombuffer(row["nulls"], bool)


def _decide(rows: DataFrame, level: int) -> DataFrame:
    """Rows of a level to repeats (``cut`` -1) and members that have to be split further; the other members are finished.

    Rows of deeper levels wait as they are: their buckets may get members from the splits to come.
    """
    bucket = Window.partitionBy("core")
    same = Window.partitionBy("core", "mark", "one", "two").orderBy("doc", "unit", "at")
    several = (F.min("one").over(bucket) != F.max("one").over(bucket)) | (F.min("two").over(bucket) != F.max("two").over(bucket))
    judged = rows.withColumn("nth", F.row_number().over(same)).withColumn("several", several)
    now = F.shiftright("cut", 14) == level
    repeat = now & ~F.col("mark") & (F.col("nth") > 1)
    judged = judged.where(~now | (~F.col("mark") & (repeat | (F.col("several") & F.col("bytes").isNotNull()))))
    new = {
        "one": F.when(repeat, F.col("at") - F.col("high")).otherwise(F.col("one")),
        "two": F.when(repeat, F.col("at") - F.col("low")).otherwise(F.col("two")),
        "cut": F.when(repeat, F.lit(-1)).otherwise(F.col("cut")),
        "bytes": F.when(~repeat, F.col("bytes")),
    }
    return judged.select(*[new.get(c, F.col(c)).alias(c) for c in _ROW_NAMES])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_size: int = BLOCK, strip: int = STRIP, part_size: int = PART, members_size: int = MEMBERS) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and stop of the maximal removed runs), kept (the remaining bytes).

    ``docs`` is scanned twice and has to give its rows in the same order, as a table does: write anything else first.
    """
    spark: SparkSession = docs.sparkSession
    wide = length - gram + 1
    if not 1 <= wide <= 127:
        raise ValueError("length must be from gram to gram + 126")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_size))

    def initial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(strip + length)
        for number, block, _ in _blocks(batches, block_size):
            a, first, _doc = block.local_first(names, length, gram, strip)
            head, several, order, part, edges = _shares(a, first, parts)
            if not len(part):
                continue
            head, several = head[order], several[order]
            bucket, one = _six(a["bucket"][head]), _six(a["one"][head])
            cut = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array([number] * len(part), pa.int64())]
                + [pa.array([c[i:j].tobytes() for i, j in cut], pa.binary()) for c in (bucket, one, several.view(np.uint8))],
                ["part", "block", "buckets", "contexts", "several"],
            )

    def classes(frame: pa.Table) -> pa.Table:
        """Per block of a part: 0 a bucket of one context, 1 that context is in other blocks, 2 several contexts in several blocks, 3 in this block only."""
        bucket = [_from_six(b) for b in frame["buckets"].to_pylist()]
        sizes = np.array([len(b) for b in bucket])
        bucket = np.concatenate(bucket)
        one = np.concatenate([_from_six(b) for b in frame["contexts"].to_pylist()])
        several = np.concatenate([np.frombuffer(b, np.uint8) for b in frame["several"].to_pylist()])
        order = np.argsort(bucket, kind="stable")
        b, o = bucket[order], one[order]
        begin = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        size = np.diff(np.append(begin, len(b)))
        many = np.maximum.reduceat(several[order], begin) > 0
        mixed = (np.minimum.reduceat(o, begin) != np.maximum.reduceat(o, begin)) | many
        found = np.empty(len(b), np.uint8)
        found[order] = np.repeat(np.where(size > 1, 1 + mixed, 3 * many), size)
        cuts = np.cumsum(sizes)[:-1]
        packed = [np.packbits(np.unpackbits(c[:, None], axis=1)[:, 6:].ravel()).tobytes() for c in np.split(found, cuts)]
        return pa.table({"block": frame["block"], "part": frame["part"], "found": pa.array(packed, pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, null in _blocks(batches, block_size):
            yield _packed(number, block, null)

    def open_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(strip + length)
        for batch in batches:
            for row in batch.to_pylist():
                block, _ = _unpacked(row)
                a, first, doc = block.local_first(names, length, gram, strip)
                unit = (row["block"] << 20) + doc
                at = a["at"] - block.starts[doc]
                covered = [(unit[~first], at[~first] - a["high"][~first], at[~first] - a["low"][~first])]
                head, several, order, part, edges = _shares(a, first, parts)
                kind = np.zeros(len(head), np.uint8)
                replies = {r["part"]: r["found"] for r in row["replies"] or []}
                for p, i, j in zip(part.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
                    bits = np.unpackbits(np.frombuffer(replies[p], np.uint8))[: 2 * (j - i)].reshape(-1, 2)
                    kind[order[i:j]] = bits[:, 0] * 2 + bits[:, 1]
                same = head[kind == 1]
                if len(same):
                    zero = np.zeros(len(same), np.int64)
                    yield _rows(a["bucket"][same], a["one"][same], a["two"][same], block.ids[doc[same]], unit[same], at[same], a["low"][same], a["high"][same], zero + _SAME, zero > 0, pa.nulls(len(same), pa.binary()))
                contexts = np.flatnonzero(first)
                kinds = kind[np.searchsorted(head, contexts, side="right") - 1]
                for k in (2, 3):
                    mixed = contexts[kinds == k]
                    for i in range(0, len(mixed), members_size):
                        m = mixed[i : i + members_size]
                        frame = _frames(block.data, a["at"][m], a["low"][m], a["high"][m], wide, length)
                        members = _Members(frame, a["low"][m], a["high"][m], block.ids[doc[m]], unit[m], at[m], names, length)
                        out: list = []
                        members.refine(np.arange(len(m)), wide - 1, out, covered)
                        if k == 2 or len(mixed) > members_size:
                            yield from _send(members, out)
                yield from _found(covered, row["block"])

    def next_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(wide + length)
        for batch in batches:
            c = {n: batch.column(n) for n in _ROW_NAMES}
            low, high, doc, unit, at, cut = (np.asarray(c[n], dtype=np.int64) for n in ("low", "high", "doc", "unit", "at", "cut"))
            frame = np.zeros((len(low), wide + length), np.uint8)
            for i, b in enumerate(c["bytes"].to_pylist()):
                frame[i, wide - high[i] : wide - low[i] + length] = np.frombuffer(b, np.uint8)
            members = _Members(frame, low, high, doc, unit, at, names, length)
            out, covered = [], []
            for k in np.unique(cut).tolist():
                members.refine(np.flatnonzero(cut == k), k, out, covered)
            yield from _send(members, out)
            yield from _found(covered)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, null = _unpacked(row)
                yield _answers(block, null, row["single"] or [], row["packed"] or [], length)

    shares = texts.mapInArrow(initial, "part bigint, block bigint, buckets binary, contexts binary, several binary")
    replies = shares.repartition(parts, "part").groupBy("part").applyInArrow(classes, "block bigint, part bigint, found binary")
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("part", "found")).alias("replies"))
    blocks = texts.mapInArrow(pack, _PACKED)
    rows = blocks.join(replies, "block", "left").mapInArrow(open_buckets, _ROW)
    repeats, waiting, level = None, [], 1
    while True:
        decided = materialize(_decide(rows, level), "repeat-buckets")
        now = decided.where("cut < 0").select(F.shiftright("unit", 20).alias("block"), "unit", "one", "two", "bytes")
        repeats = now if repeats is None else repeats.unionByName(now)
        of_level = F.shiftright("cut", 14)
        levels = {r[0] for r in decided.where("cut >= 0").select(of_level).distinct().collect()}  # a handful
        parts_next = [decided.where(of_level == level).mapInArrow(next_round, _ROW)] if level in levels else []
        waiting = [(t, found - {level}) for t, found in [*waiting, (decided, levels)]]
        level += 1
        parts_next += [t.where(of_level == level) for t, found in waiting if level in found]
        if not parts_next and not any(found for _, found in waiting):
            break
        rows = reduce(DataFrame.unionByName, parts_next) if parts_next else decided.limit(0)
    single = F.when(F.col("bytes").isNull(), F.struct("unit", "one", "two"))
    repeats = repeats.groupBy("block").agg(F.collect_list(single).alias("single"), F.collect_list("bytes").alias("packed"))
    return blocks.join(repeats, "block", "left").mapInArrow(cut_out, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary")


def _answers(block: _Block, null: np.ndarray, single: list[dict], packed: list[bytes], length: int) -> pa.RecordBatch:
    found = [np.array([[r["unit"], r["one"], r["two"]] for r in single], np.int64).reshape(-1, 3).T, *(np.frombuffer(b, np.int64).reshape(3, -1) for b in packed)]
    unit, low, high = np.concatenate(found, axis=1)
    doc = unit & ((1 << 20) - 1)
    n = len(block.data)
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, block.starts[doc] + low, 1)
    np.add.at(cover, block.starts[doc] + high + length, -1)
    gone = np.cumsum(cover[:-1]) > 0
    # maximal runs, cut where a text ends
    edge = np.zeros(n + 1, bool)
    edge[block.stops] = edge[0] = edge[n] = True
    edge[1:n] |= gone[1:] != gone[:-1]
    cut = np.flatnonzero(edge)
    runs = cut[:-1][gone[cut[:-1]]] if n else np.zeros(0, np.int64)
    ends = cut[1:][gone[cut[:-1]]] if n else runs
    owner = np.searchsorted(block.stops, runs, side="right")
    spans = pa.StructArray.from_arrays([pa.array(runs - block.starts[owner]), pa.array(ends - block.starts[owner])], ["start", "stop"])
    offsets = np.searchsorted(owner, np.arange(len(block.stops) + 1)).astype(np.int32)
    kept = np.append(0, np.cumsum(~gone))
    bounds = kept[np.append(0, block.stops)]
    data = block.data[~gone].tobytes()
    kept = [data[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    ids = pa.array(block.ids, mask=null)
    return pa.RecordBatch.from_arrays([ids, pa.array(block.stops - block.starts), pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("bigint")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _frames(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, wide: int, length: int) -> np.ndarray:
    """The bytes under each anchor's windows, the anchor at column ``wide``; zero elsewhere."""
    column = np.arange(wide + length)
    places = at[:, None] - wide + column
    inside = (column >= (wide - high)[:, None]) & (column < (wide - low + length)[:, None])
    return np.where(inside, data[np.clip(places, 0, len(data) - 1)], 0).astype(np.uint8)
