"""Alignment of two tokenizers over every text: which tokens of one cover the same bytes as which of the other.

Where tokens of both end at the same byte, a group ends.  A *fragment* of a text holds the tokens that end in a range of
its bytes: an open prefix up to the first such place, closed groups, an open suffix behind the last one.  Composing
two neighbouring fragments closes the group between them, and is associative, so ranges of a very long text are tokenized by
different tasks and composed in a tree.

Neither tokenizer ever joins a single space to what stands before it, if that is not white space and a word follows: the
first cuts there before it merges, and no piece of the second has a word mark behind a letter.  So texts fall into *units*
that start with such a space, a task tokenizes each different unit of a block once, and a range of a long text carries
the units it touches.

Link counts: each block of texts sends its different id pairs with their numbers, Spark sums them, finds the highest of
each second id and sends the totals of a block's pairs back to it.  Texts themselves are not shuffled, but long ones.

Defined cases: a null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens, zero
counts and empty groups; a text without a place to cut is one unit; repeated and null ids and repeated rows get a row each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: Characters of text in a block; bytes of a range of a long text; units that a worker remembers, twice.
BLOCK, RANGE, MEMO = 2_000_000, 32_768, 25_000
#: Units that are encoded as one text.
TOGETHER = 8_000
#: Fragments that one step of the tree composes.
FAN = 8
_EDGE = "\u2581\u200b\u180e\ufeff"
#: How byte-level vocabularies split a text before they merge.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space and what may count as such.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + _EDGE
_CUT = re.compile(rf" (?<=[^\s{_EDGE}] )(?=[^\s{_EDGE}])")
_SECOND = 1 << 20  # a pair is first id * _SECOND + second id


class Tokenizers:
    """The two tokenizers with the bytes of every token."""

    def __init__(self, first: str, second: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        back = {c: b for b, c in _byte_letters().items()}
        n = self.first.get_vocab_size()
        self.first_bytes = [bytes(back[c] for c in t) if t and all(c in back for c in t) else b"" for t in (self.first.id_to_token(i) or "" for i in range(n))]
        self.second_bytes = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            special = self.second.is_control(i) or self.second.is_unknown(i)
            self.second_bytes.append(b"" if special else bytes([int(piece[1:-1], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode())
        self.lengths = [np.array([len(b) for b in v], np.int64) for v in (self.first_bytes, self.second_bytes)]
        self.fast = _same_by_rank(first, self.first_bytes)
        a, b = ([str(i) for i in range(len(v))] for v in self.lengths)
        self.words = np.array([x + "," for x in a] + [x + "|" for x in a] + [x + "," for x in b] + [x + ";" for x in b], object)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units, which start with a space."""
        return [e.ids for e in self.first.encode_batch_fast(units, add_special_tokens=False)], self.second.encode([u[1:] for u in units], num_threads=1)


def _same_by_rank(path: str, tokens: list[bytes]):
    """A faster encoder of the same vocabulary, if its tokens are numbered in the order of its merges and it splits as usual."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    vocab = spec["model"]["vocab"]
    split = spec.get("pre_tokenizer") or {}
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    if not usual or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    added = {t["id"] for t in spec.get("added_tokens", [])}
    ranks = {b: i for i, b in enumerate(tokens) if b and i not in added}
    return tiktoken.Encoding("by-rank", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def split_units(text: str) -> list[str]:
    """The units of a text, without the space each starts with."""
    return _CUT.split(text)


@dataclass
class Fragment:
    """Tokens ending in a byte range.  Before the first common end all is ``head``; ``tail`` is what follows the last.

    head and tail: (first ids, their ends, second ids, their ends).  closed: text of the closed groups, their links' pairs.
    """

    head: list[list[int]]
    tail: list[list[int]]
    met: bool = False
    groups: list[str] = field(default_factory=list)
    pairs: list[int] = field(default_factory=list)
    counts: list[int] = field(default_factory=lambda: [0, 0, 0])  # first tokens, second tokens, groups


def close(tokens: list[list[int]]) -> tuple[str, list[int], list[int]]:
    """A group of tokens that end together: its text, the pairs of its links, its counts."""
    a, a_ends, b, b_ends = tokens
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        pairs.append(a[i] * _SECOND + b[j])
        x, y = a_ends[i], b_ends[j]
        i += x <= y
        j += y <= x
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}", pairs, [len(a), len(b), 1]


def fragment(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> Fragment:
    """The fragment of the tokens of a range."""
    common = sorted(set(a_ends) & set(b_ends))
    if not common:
        return Fragment([a, a_ends, b, b_ends], [[], [], [], []])
    found, i, j = Fragment([], [], True), 0, 0
    for k, end in enumerate(common):
        i2, j2 = i, j
        while i2 < len(a) and a_ends[i2] <= end:
            i2 += 1
        while j2 < len(b) and b_ends[j2] <= end:
            j2 += 1
        tokens = [a[i:i2], a_ends[i:i2], b[j:j2], b_ends[j:j2]]
        if k:
            _add(found, tokens)
        else:
            found.head = tokens
        i, j = i2, j2
    found.tail = [a[i:], a_ends[i:], b[j:], b_ends[j:]]
    return found


def _add(to: Fragment, tokens: list[list[int]]) -> None:
    text, pairs, counts = close(tokens)
    to.groups.append(text)
    to.pairs += pairs
    to.counts = [x + y for x, y in zip(to.counts, counts)]


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    join = lambda p, q: [u + v for u, v in zip(p, q)]
    if not x.met:
        return Fragment(join(x.head, y.head), y.tail, y.met, y.groups, y.pairs, y.counts)
    if not y.met:
        return Fragment(x.head, join(x.tail, y.head), True, x.groups, x.pairs, x.counts)
    found = Fragment(x.head, y.tail, True, list(x.groups), list(x.pairs), list(x.counts))
    _add(found, join(x.tail, y.head))
    found.groups += y.groups
    found.pairs += y.pairs
    found.counts = [p + q for p, q in zip(found.counts, y.counts)]
    return found


def _packed(f: Fragment | None) -> bytes | None:
    return None if f is None else pickle.dumps((f.head, f.tail, f.met, f.groups, f.pairs, f.counts))


def _unpacked(b: bytes) -> Fragment:
    return Fragment(*pickle.loads(b))


def whole(x: Fragment) -> Fragment:
    """The fragment of a whole text: a text's start ends a group, so its open prefix is one."""
    found = Fragment([[], [], [], []], x.tail, True)
    if x.met:
        _add(found, x.head)
        found.groups += x.groups
        found.pairs += x.pairs
        found.counts = [p + q for p, q in zip(found.counts, x.counts)]
    return found


class _Units:
    """What a worker knows of units: text of the groups, pairs of the links, counts; nothing for one that is not given back whole."""

    def __init__(self, tokenizers: Tokenizers, memo: int):
        self.tokenizers, self.memo = tokenizers, memo
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def look_up(self, units: list[str]) -> list[tuple | None]:
        young, old = self.young, self.old
        missing = [u for u in units if u not in young and u not in old]
        fresh = dict(zip(missing, self._align(missing))) if missing else {}
        found = [young[u] if u in young else old[u] if u in old else fresh[u] for u in units]
        for u, v in zip(units, found):
            if u not in young:
                if len(young) >= self.memo:
                    self.old, self.young = young, {}
                    young = self.young
                young[u] = v
        return found

    def _encoded(self, units: list[str]) -> tuple[list[int], list[np.ndarray], np.ndarray]:
        """(places of the units that are given back whole, ids of both tokenizers one unit after another, bytes of each unit)."""
        t = self.tokenizers
        # letters that every version of Unicode knows alike, and no white space at the ends: such units can be one text
        plain = [k for k, u in enumerate(units) if (u.isascii() or max(u) < "\u0250") and u and len(u.strip(_SPACES)) == len(u)] if t.fast else []
        good, ids, sizes = [], ([], []), []
        rest = set(range(len(units)))
        for i in range(0, len(plain), TOGETHER):
            own = plain[i : i + TOGETHER]
            text = " " + " ".join([units[k] for k in own])
            raw = text.encode()
            a, b = t.fast.encode_ordinary(text), t.second.encode(text[1:])
            if raw == b"".join([t.first_bytes[x] for x in a]) and raw == b"".join([t.second_bytes[x] for x in b]):
                good += own
                rest.difference_update(own)
                ids[0].append(np.array(a, np.int64))
                ids[1].append(np.array(b, np.int64))
                sizes += [len(units[k]) + 1 if units[k].isascii() else len(units[k].encode()) + 1 for k in own]
        others = sorted(rest)
        for i in range(0, len(others), 2000):
            own = others[i : i + 2000]
            for k, a, b in zip(own, *t.encode([" " + units[k] for k in own])):
                raw = (" " + units[k]).encode()
                if raw == b"".join([t.first_bytes[x] for x in a]) and raw == b"".join([t.second_bytes[x] for x in b]):
                    good.append(k)
                    ids[0].append(np.array(a, np.int64))
                    ids[1].append(np.array(b, np.int64))
                    sizes.append(len(raw))
        return good, [np.concatenate(x) if x else np.zeros(0, np.int64) for x in ids], np.array(sizes, np.int64)

    def _align(self, units: list[str]) -> list[tuple | None]:
        t = self.tokenizers
        found: list[tuple | None] = [None] * len(units)
        good, ids, bytes_ = self._encoded(units)
        if not good:
            return found
        unit_ends = np.cumsum(bytes_)
        ends = [np.cumsum(t.lengths[k][ids[k]]) for k in range(2)]
        sizes = [np.diff(np.append(0, np.searchsorted(e, unit_ends, side="right"))) for e in ends]
        common = np.intersect1d(*ends, assume_unique=True)
        union = np.union1d(*ends)
        at = [np.searchsorted(e, union) for e in ends]
        pairs = ids[0][at[0]] * _SECOND + ids[1][at[1]]
        cuts = np.append(0, np.searchsorted(union, unit_ends, side="right"))
        groups = np.diff(np.append(0, np.searchsorted(common, unit_ends, side="right")))
        # the text of the groups: first ids, a bar, second ids, a semicolon
        na, nb = (len(v) for v in t.lengths)
        group = [np.searchsorted(common, e) for e in ends]
        last = [common[g] == e for g, e in zip(group, ends)]
        word = np.concatenate([ids[0] + na * last[0], 2 * na + ids[1] + nb * last[1]])
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        words = t.words[word[order]].tolist()
        stops = np.append(0, np.cumsum(sizes[0] + sizes[1])).tolist()
        cuts = cuts.tolist()
        numbers = zip(sizes[0].tolist(), sizes[1].tolist(), groups.tolist())
        for k, (g, n) in enumerate(zip(good, numbers)):
            found[g] = ("".join(words[stops[k] : stops[k + 1]])[:-1], pairs[cuts[k] : cuts[k + 1]].tobytes(), *n)
        return found


class _Numbered(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


_BLOCK = (
    "block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups array<string>, "
    "units binary, doc_sizes binary, links binary, unit_sizes binary, pairs binary, counts binary"
)
_BLOCK_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]


def _small(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x))


def _large(b: bytes, kind: type = np.int64) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _block_row(number: int, ids: list, counts: np.ndarray, groups: list[str], units: np.ndarray, doc_sizes: np.ndarray, unit_pairs: np.ndarray, unit_sizes: np.ndarray) -> pa.RecordBatch:
    """A block's texts as sequences of units, its units as links to its different pairs, and how often each of those occurs."""
    pairs, links = np.unique(unit_pairs, return_inverse=True)
    times = np.bincount(units, minlength=len(unit_sizes))
    number_of = np.bincount(links, weights=np.repeat(times, unit_sizes), minlength=len(pairs)).astype(np.int64)
    binary = [units.astype(np.uint32), doc_sizes.astype(np.int64), links.astype(np.uint32), unit_sizes.astype(np.int64), pairs, number_of]
    lists = [pa.array([c.tolist()], pa.list_(pa.int64())) for c in counts]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *lists, pa.array([groups], pa.list_(pa.string())), *(pa.array([_small(b)], pa.binary()) for b in binary)],
        _BLOCK_NAMES,
    )


def _align_block(number: int, ids: list, texts: list[str | None], known: _Units, render: Callable[[str], str] | None) -> pa.RecordBatch:
    index = _Numbered()
    words = [list(map(index.__getitem__, t.split(" "))) if t else [] for t in texts]
    spaced = [not u or len(u.strip(_SPACES)) < len(u) for u in index]
    if any(spaced):  # spaces beside other white space do not cut
        for k, w in enumerate(words):
            if any(map(spaced.__getitem__, w)):
                words[k] = list(map(index.__getitem__, split_units(texts[k])))
    found = known.look_up(list(index))
    bad = [f is None for f in found]
    if any(bad):
        words = [[] if any(map(bad.__getitem__, w)) else w for w in words]
    none = ("", b"", 0, 0, 0)
    found = [f or none for f in found]
    strings = [f[0] for f in found]
    groups = [";".join(map(strings.__getitem__, w)) for w in words]
    if render:
        groups = [render(g) if g else "" for g in groups]
    sizes = np.array([len(w) for w in words])
    units = np.fromiter((u for w in words for u in w), np.int64, int(sizes.sum()))
    unit_pairs = np.frombuffer(b"".join([f[1] for f in found]), np.int64)
    per_unit = np.array([f[2:] for f in found], np.int64).reshape(-1, 3)
    running = np.vstack([np.zeros((1, 3), np.int64), np.cumsum(per_unit[units], axis=0)])
    stops = np.cumsum(sizes)
    n = (running[stops] - running[stops - sizes]).T
    return _block_row(number, ids, np.vstack([n, n[0] + n[1] - n[2]]), groups, units, sizes, unit_pairs, np.array([len(f[1]) // 8 for f in found]))


_FRAGMENT = "unit bigint, doc_id bigint, step bigint, whole boolean, fragment binary"


def _ranges(text: str, size: int) -> list[tuple[int, int, int, str]]:
    """Byte ranges of a space and ``text``: (start, stop, where the piece starts, the units that the range touches).

    A limit inside a unit longer than a range is left out, so that no unit is in more than two pieces.
    """
    units = split_units(text)
    lens = np.array([len(u.encode()) + 1 for u in units])
    stops = np.cumsum(lens)
    limits = np.arange(size, int(stops[-1]), size)
    at = np.searchsorted(stops, limits, side="right")
    limits = limits[lens[at] <= size]
    edges = [0, *limits.tolist(), int(stops[-1])]
    found = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        i, j = int(np.searchsorted(stops, lo, side="right")), int(np.searchsorted(stops, hi, side="left"))
        found.append((lo, hi, int(stops[i] - lens[i]), " ".join(units[i : j + 1])))
    return found


def _range_fragment(text: str, start: int, lo: int, hi: int, t: Tokenizers) -> Fragment | None:
    """The fragment of a range from the units it touches; nothing if they are not given back whole."""
    units = [" " + u for u in split_units(text)]
    sides = []
    for ids, table_, lengths in zip(t.encode(units), (t.first_bytes, t.second_bytes), t.lengths):
        if any(u.encode() != b"".join([table_[i] for i in x]) for u, x in zip(units, ids)):
            return None
        flat = np.fromiter((i for x in ids for i in x), np.int64)
        ends = start + np.cumsum(lengths[flat])
        inside = (ends > lo) & (ends <= hi)
        sides += [flat[inside].tolist(), ends[inside].tolist()]
    return fragment(*sides)


def align(docs: DataFrame, first: str, second: str, render: Callable[[str], str] | None = None, long_text: int = 2 * RANGE, size: int = RANGE, block: int = BLOCK, memo: int = MEMO) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (``render`` of their text, if given).

    first: a byte-level vocabulary of ``tokenizers``; second: a ``sentencepiece`` model.  Texts of more than
    ``long_text`` bytes are cut into ranges of ``size``.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > long_text, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = None, TaskContext.get().partitionId() << 32
        for b in batches:
            ids, held = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            i = 0
            while i < len(ids):
                j, total = i, 0
                while j < len(ids) and (j == i or total + len(held[j] or "") <= block):
                    total += len(held[j] or "")
                    j += 1
                known = known or _Units(Tokenizers(first, second), memo)
                yield _align_block(number, ids[i:j], held[i:j], known, render)
                number, i = number + 1, j

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, doc, text in zip(*(b.column(c).to_pylist() for c in ("unit", "doc_id", "text"))):
                rows = [(unit, doc, k, *r) for k, r in enumerate(_ranges(text, size))]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.int64()] * 6 + [pa.string()])], ["unit", "doc_id", "step", "lo", "hi", "start", "text"])

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = None
        for b in batches:
            t = t or Tokenizers(first, second)
            rows = b.to_pylist()
            made = [_range_fragment(r["text"], r["start"], r["lo"], r["hi"], t) for r in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("unit", "doc_id", "step")), pa.array([f is not None for f in made]), pa.array([_packed(f) for f in made], pa.binary())], ["unit", "doc_id", "step", "whole", "fragment"])

    def step(rows: pa.Table) -> pa.Table:
        rows = sorted(rows.to_pylist(), key=lambda r: r["step"])
        made = None
        if all(r["whole"] for r in rows):
            made = _unpacked(rows[0]["fragment"])
            for r in rows[1:]:
                made = compose(made, _unpacked(r["fragment"]))
        return pa.table([pa.array([v], kind) for v, kind in ((rows[0]["unit"], pa.int64()), (rows[0]["doc_id"], pa.int64()), (rows[0]["step"] // FAN, pa.int64()), (made is not None, pa.bool_()), (_packed(made), pa.binary()))], ["unit", "doc_id", "step", "whole", "fragment"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                f = whole(_unpacked(r["fragment"])) if r["whole"] else Fragment([], [])
                text, (a, s, g) = ";".join(f.groups), f.counts
                pairs = np.array(f.pairs, np.int64)
                yield _block_row(-1 - r["unit"], [r["doc_id"]], np.array([[a], [s], [g], [a + s - g]]), [render(text) if render and text else text], np.zeros(1, np.int64), np.ones(1, np.int64), pairs, np.array([len(pairs)]))

    ranges = texts.where(is_long).withColumn("unit", F.monotonically_increasing_id()).mapInArrow(cut, "unit bigint, doc_id bigint, step bigint, lo bigint, hi bigint, start bigint, text string")
    parts = materialize(ranges.repartition("unit", "step").mapInArrow(fragments, _FRAGMENT), "alignment-fragments")
    most = parts.agg(F.max("step")).first()[0] or 0
    while most:
        # written each time: steps that run into one another would keep more Python workers alive at once
        parts = materialize(parts.groupBy("unit", F.floor(F.col("step") / FAN).alias("_step")).applyInArrow(step, _FRAGMENT), "alignment-step")
        most //= FAN
    long = materialize(parts.mapInArrow(finish, _BLOCK), "alignment-long")
    blocks = materialize(texts.where(~is_long).mapInArrow(short, _BLOCK), "alignment-blocks")
    return _with_counts(blocks.unionByName(long))


def _with_counts(blocks: DataFrame) -> DataFrame:
    """The corpus-wide numbers of links, brought back to the blocks that hold the pairs."""

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, pairs, counts in zip(*(b.column(c).to_pylist() for c in ("block", "pairs", "counts"))):
                pairs, counts = _large(pairs), _large(counts)
                used = counts > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(used.sum()), number)), pa.array(pairs[used]), pa.array(counts[used])], ["block", "pair", "n"])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield _answers(row)

    held = blocks.select("block", "pairs", "counts").mapInArrow(pairs_of, "block bigint, pair bigint, n bigint")
    totals = held.groupBy("pair").agg(F.sum("n").alias("total"))
    highest = F.max("total").over(Window.partitionBy(F.col("pair") % _SECOND))
    totals = totals.withColumn("best", F.col("total") == highest)
    back = held.select("block", "pair").join(totals, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "total", "best")).alias("known"))
    back = back.select("block", *[F.col(f"known.{c}").alias(f"known_{c}") for c in ("pair", "total", "best")])
    names = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
    return blocks.join(back, "block", "left").mapInArrow(sum_up, names)


def _answers(row: dict) -> pa.RecordBatch:
    pairs = _large(row["pairs"])
    known = np.array(row["known_pair"] or [], np.int64)
    total, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    at = np.searchsorted(pairs, known)
    total[at], best[at] = row["known_total"] or [], row["known_best"] or []
    links, units = _large(row["links"], np.uint32), _large(row["units"], np.uint32)
    unit_sizes, doc_sizes = _large(row["unit_sizes"]), _large(row["doc_sizes"])
    unit_stops = np.cumsum(unit_sizes)
    doc_stops = np.cumsum(doc_sizes)
    sums = []
    for value in (best, total):
        run = np.append(0, np.cumsum(value[links]))
        per_unit = run[unit_stops] - run[unit_stops - unit_sizes]
        run = np.append(0, np.cumsum(per_unit[units]))
        sums.append(run[doc_stops] - run[doc_stops - doc_sizes])
    lists = [pa.array(row[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.RecordBatch.from_arrays([*lists, *(pa.array(s, pa.int64()) for s in sums), pa.array(row["groups"], pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    found = align(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), _sha256)
    return found.withColumnRenamed("groups", "groups_sha256")
