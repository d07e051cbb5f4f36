"""Token counts under a unigram vocabulary, without building the tokens.

A pass of an Aho-Corasick automaton lists every vocabulary piece that ends at each place of a word; dynamic programming
carries the best score and the number of pieces on it.  Ties follow the exact tokenizers: of equal scores the earlier
start, that is the longer last piece, stays.  A character that no piece covers alone costs the least score less ten and
counts as its bytes, which the vocabulary has.

Pieces mark a word's start and never reach into the next word, so a text's count is the sum over its words and the
workers remember words they have seen.

Defined cases: a null or empty text has no tokens and score 0; runs of spaces begin a word each; a word of any length is
handled in time linear in it; ties go as the tokenizer's do; null and repeated ids and repeated rows give a row each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import map_documents, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 400_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model's ordinary and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not skip(i)]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], mark: str = MARK):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self._mark = mark
        self._memo: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of a marked word."""
        n = len(word)
        score, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        reached, single = 0, False

        def close(end: int) -> None:
            # the last character alone, unless the vocabulary has it
            if not single:
                s = score[end - 1] + self._unknown
                if s > score[end]:
                    score[end], count[end] = s, count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))

        for last, (length, value) in self._automaton.iter(word):  # by end; of one end the longest piece first
            end = last + 1
            while reached < end:
                if reached:
                    close(reached)
                reached, single = reached + 1, False
            single = single or length == 1
            s = score[end - length] + value
            if s > score[end]:
                score[end], count[end] = s, count[end - length] + 1
        while reached < n:
            if reached:
                close(reached)
            reached, single = reached + 1, False
        if n:
            close(n)
        return count[n], score[n]

    def text(self, text: str | None) -> tuple[int, float, int]:
        """(tokens, score, words)"""
        if not text:
            return 0, 0.0, 0
        memo, mark = self._memo, self._mark
        text = text.replace(mark, " ")
        words = (text[1:] if text[0] == " " else text).split(" ")  # one leading space is the first word's own mark
        tokens, score = 0, 0.0
        for w in words:
            found = memo.get(w)
            if found is None:
                if len(memo) >= MEMO:
                    memo.clear()
                found = memo[w] = self.word(mark + w)
            tokens += found[0]
            score += found[1]
        return tokens, score, len(words)


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, n_words (space-separated), score (the best segmentation's)."""
    vocabulary = read_vocabulary(vocabulary_path)  # 32 thousand pieces

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = UnigramCounter(vocabulary)
        for f in frames:
            rows = [counter.text(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_tokens": [r[0] for r in rows], "n_words": [r[2] for r in rows], "score": [r[1] for r in rows]})

    return map_documents(docs, ["text"], batch, "n_tokens bigint, n_words bigint, score double")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
