"""Aligned tokens against whole texts encoded at once and every pair of tokens compared."""

import random
from collections import Counter

import pytest

from lodeseam.llm import token_alignment as T

P = pytest.importorskip("public_tokenizers")
FIRST, SECOND = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    return T.Tokenizers(FIRST, SECOND)


def _brute(docs, t):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each document."""
    rows, count = [], Counter()
    for doc, text in docs:
        a, b = (t.first.encode(" " + (text or ""), add_special_tokens=False).ids, t.second.encode(text or "")) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(t.first_bytes[i] for i in a) != raw or b"".join(t.second_bytes[i] for i in b) != raw:
            a, b = [], []
        spans = []
        for ids, table in ((a, t.first_bytes), (b, t.second_bytes)):
            at, found = 0, []
            for i in ids:
                found.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(found)
        links, low = [], 0
        for s, e, i in spans[0]:
            while low < len(spans[1]) and spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        count.update(links)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at = [], [0, 0]
        for e in ends:
            sides = []
            for k, side in enumerate(spans):
                start = at[k]
                while at[k] < len(side) and side[at[k]][1] <= e:
                    at[k] += 1
                sides.append(",".join(str(i) for _, _, i in side[start : at[k]]))
            groups.append("|".join(sides))
        rows.append((doc, len(a), len(b), len(ends), links, ";".join(groups)))
    best = {}
    for (_, i), n in count.items():
        best[i] = max(best.get(i, 0), n)
    return sorted(((d, a, b, g, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), s) for d, a, b, g, links, s in rows), key=str)


def _rows(found):
    return sorted((tuple(r) for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()), key=str)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb c", "tab\tx y", "x  y z", "x  y", "x　y z", "it's 'quoted' don't", "<|endoftext|> <s> </s> <unk> <0x41>",
    "a▁b c", "c d ▁", "zero​ width ​x", "日本語 の テキスト", "日本語のテキスト" * 40, "\U0001f600 \U0001f600\U0001f600 ok", "é ß é ́x", "\x00 nul \x1c\x1d x", "a\x85b \x85 c",
    "...!!! ??? --- 12345 1 2 33", "x" * 500, " ".join("ab" for _ in range(300)), "\n\n\n  \n", "word\r\n word", "ﬁ ﬂ ½ Å", "a b" + " " * 30 + "c",
]


def test_units_and_ranges_equal_whole_texts(spark, tokenizers):
    rnd = random.Random(3)
    pieces = ["the", "quick", "Ünï", "日本", "12", "\n", " ", "  ", "don't", "foo.bar", "\t", "x" * 90, "\U0001f600", "re-do", " "]
    docs = list(enumerate(ODD)) + [(None, "again the same"), (3, "again the same"), (3, "again the same")]
    docs += [(100 + k, "".join(rnd.choice(pieces) + rnd.choice(["", " ", " "]) for _ in range(rnd.randrange(1, 120)))) for k in range(60)]
    df = spark.createDataFrame([(*d, 1, "u") for d in docs], "doc_id bigint, text string, unit int, block string").repartition(3)
    expected = _brute(docs, tokenizers)
    assert _rows(T.align(df, FIRST, SECOND)) == expected
    # long texts in ranges of a few bytes, small blocks, a memo that turns over
    assert _rows(T.align(df, FIRST, SECOND, long_text=40, size=17, block=300, memo=20)) == expected


def test_fragments_compose_in_any_order(tokenizers):
    rnd = random.Random(5)
    a, b = tokenizers.encode([" internationalization of tokenisation_algorithms quite thoroughly"])
    ends = [[sum(len(t[i]) for i in ids[: k + 1]) for k in range(len(ids))] for ids, t in ((a[0], tokenizers.first_bytes), (b[0], tokenizers.second_bytes))]
    full = T.whole(T.fragment(a[0], ends[0], b[0], ends[1]))
    for _ in range(50):
        cuts = [0, *sorted(rnd.sample(range(1, ends[0][-1]), 6)), ends[0][-1]]
        parts = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            sides = []
            for ids, e in ((a[0], ends[0]), (b[0], ends[1])):
                keep = [k for k, x in enumerate(e) if lo < x <= hi]
                sides += [[ids[k] for k in keep], [e[k] for k in keep]]
            parts.append(T.fragment(*sides))
        while len(parts) > 1:
            k = rnd.randrange(len(parts) - 1)
            parts[k : k + 2] = [T.compose(parts[k], parts[k + 1])]
        assert T.whole(parts[0]) == full


def test_long_and_empty(spark, tokenizers):
    assert T.align(spark.createDataFrame([], "doc_id bigint, text string"), FIRST, SECOND).count() == 0
    docs = [(1, "word and more, " * 20_000), (2, "x" * 100_000), (3, "short one")]
    found = _rows(T.align(spark.createDataFrame(docs, "doc_id bigint, text string"), FIRST, SECOND))
    assert found == _brute(docs, tokenizers)


def test_sample(spark, sample, tokenizers):
    expected = _brute([(r["doc_id"], r["text"]) for r in sample.collect()], tokenizers)
    assert _rows(T.align(sample, FIRST, SECOND)) == expected
    assert _rows(T.align(sample, FIRST, SECOND, long_text=8000, size=3000)) == expected
