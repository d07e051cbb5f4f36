"""License scans: marked-up templates compiled to token automata.

A template is wording with two kinds of markup: ``<<beginOptional>>...<<endOptional>>`` may be missing, and
``<<var;name=...;max=N>>`` stands for 0 to N (8 unless given) words of any kind.  Everything else is mandatory and must match
word for word.  Templates become one non-deterministic automaton over words; its subset states are built when first met
and kept, so a word costs one dictionary lookup.  A scan starts only where a template can begin and follows the automaton
to the longest acceptance.

Words are runs of digits, a-z (A-Z lower-cased first) and anything outside ASCII.

Defined cases: a null text is empty; no words give no spans, null positions, empty labels and score 0; places that
overlap all count; null and repeated ids and repeated rows give a row each; text of any length is scanned whole, in its row;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_documents, table

VAR_WORDS = 8
_BLANK = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_MARKUP = re.compile(r"<<(.*?)>>", re.S)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BLANK).split()


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    #: A base phrase counts places; a template of the method adds its label.
    base: bool = False


#: The phrases every scan counts: fixed values.
BASE = (
    Template("phrase-mit", "mit", "under the mit license", True),
    Template("phrase-apache-2", "apache-2", "apache license version 2", True),
    Template("phrase-cc-by-nc", "cc-by-nc", "cc by nc", True),
)

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""

#: Templates of well-known notices and texts.
TEMPLATES = (
    Template("notice-mit", "mit", "<<beginOptional>>released<<endOptional>><<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT license"),
    Template(
        "text-mit",
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies
        or substantial portions of the Software.""" + _WARRANTY,
    ),
    Template(
        "notice-apache-2",
        "apache-2",
        "Licensed under the Apache License, Version 2<<beginOptional>>.0<<endOptional>> <<beginOptional>>(the \"License\")<<endOptional>>",
    ),
    Template("notice-gpl-3", "gpl-3", "licensed under the GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 3"),
    Template("notice-gpl-2", "gpl-2", "licensed under the GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 2"),
    Template("notice-lgpl", "lgpl", "under the terms of the GNU Lesser General Public License <<var;name=tail;max=8>> version"),
    Template("notice-cc-by-nc", "cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC <<beginOptional>>4.0<<endOptional>> <<beginOptional>>license<<endOptional>>"),
    Template("notice-cc-by", "cc-by", "licensed under <<beginOptional>>a<<endOptional>> Creative Commons Attribution <<var;name=version;max=2>> International License"),
    Template("notice-mpl-2", "mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0"),
    Template(
        "text-isc",
        "isc",
        """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies""",
    ),
    Template(
        "text-bsd",
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer""",
    ),
    Template("copyright-reserved", "proprietary", "Copyright <<var;name=holder;max=8>> All rights reserved"),
)


class TemplateAutomaton:
    """All templates as one automaton over words, determinised as it is used."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self._edges: list[dict[bytes | None, list[int]]] = []  # None: any word
        self._skips: list[list[int]] = []
        self._accepts: dict[int, int] = {}
        starts = []
        for k, t in enumerate(templates):
            at = begin = self._state()
            open_: list[int] = []
            pos = 0
            for m in [*_MARKUP.finditer(t.text), None]:
                for w in words_of(t.text[pos : m.start() if m else len(t.text)]):
                    at = self._edge(at, w)
                if m is None:
                    break
                pos, kind = m.end(), m[1].split(";")[0].strip()
                if kind == "beginOptional":
                    open_.append(at)
                elif kind == "endOptional":
                    self._skips[open_.pop()].append(at)
                elif kind == "var":
                    most = re.search(r"max=(\d+)", m[1])
                    first = at
                    between = [first]
                    for _ in range(int(most[1]) if most else VAR_WORDS):
                        at = self._edge(at, None)
                        between.append(at)
                    for s in between[:-1]:
                        self._skips[s].append(at)
                else:
                    raise ValueError(f"unknown markup <<{m[1]}>>")
            if open_ or at == begin:
                raise ValueError(f"{t.name}: optional region left open, or nothing to match")
            self._accepts[at] = k
            starts.append(begin)
        self._sets: dict[frozenset[int], int] = {}
        self._members: list[frozenset[int]] = []
        self._next: list[dict[bytes, int]] = []
        self._words: list[dict[bytes, int]] = []
        self.accepted: list[tuple[int, ...]] = []
        self._any: list[int] = []
        self.start = self._subset(frozenset(starts))
        if self._any[self.start] >= 0 or self.accepted[self.start]:
            raise ValueError("a template must begin with a mandatory word or an optional one, and not be all optional")
        self.first = frozenset(self._words[self.start])

    def _state(self) -> int:
        self._edges.append({})
        self._skips.append([])
        return len(self._edges) - 1

    def _edge(self, at: int, word: bytes | None) -> int:
        to = self._state()
        self._edges[at].setdefault(word, []).append(to)
        return to

    def _subset(self, states: frozenset[int]) -> int:
        seen, todo = set(states), list(states)
        while todo:
            for s in self._skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        closed = frozenset(seen)
        if closed in self._sets:
            return self._sets[closed]
        k = self._sets[closed] = len(self._members)
        self._members.append(closed)
        self.accepted.append(tuple(sorted(self._accepts[s] for s in closed if s in self._accepts)))
        self._words.append({})
        self._any.append(-1)
        anything = frozenset(t for s in closed for t in self._edges[s].get(None, ()))
        if anything:
            self._any[k] = self._subset(anything)
        by_word: dict[bytes, set[int]] = {}
        for s in closed:
            for w, to in self._edges[s].items():
                if w is not None:
                    by_word.setdefault(w, set()).update(to)
        for w, to in by_word.items():
            self._words[k][w] = self._subset(frozenset(to) | anything)
        return k

    def spans(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(template, first word, word after the last): for each start and template the longest acceptance."""
        first, table_, any_ = self.first, self._words, self._any
        for i in [i for i, w in enumerate(words) if w in first]:
            at, best = self.start, {}
            for j in range(i, len(words)):
                at = table_[at].get(words[j], any_[at])
                if at < 0:
                    break
                for k in self.accepted[at]:
                    best[k] = j + 1
            for k in sorted(best):
                yield k, i, best[k]


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + TEMPLATES) -> DataFrame:
    """(doc_id, n_words, spans): spans is an array of (template, label, base, start, end), ends exclusive, in text order."""

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = TemplateAutomaton(templates)
        for f in frames:
            n, found = [], []
            for text in f["text"]:
                words = words_of(text)
                n.append(len(words))
                found.append([(templates[k].name, templates[k].label, templates[k].base, a, b) for k, a, b in automaton.spans(words)])
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_words": n, "spans": found})

    schema = "n_words bigint, spans array<struct<template: string, label: string, base: boolean, start: bigint, end: bigint>>"
    return map_documents(docs, ["text"], batch, schema)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score is the share of distinct labels whose notice or text was accepted as a whole by a template; 0 without labels."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda spans: F.sort_array(F.array_distinct(F.transform(spans, lambda s: s["label"])))
    full = labels(F.filter("spans", lambda s: ~s["base"]))
    every = labels(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(labels(base), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size(every) > 0, F.size(full) / F.size(every)).otherwise(F.lit(0.0)).alias("score"),
    )


def _pattern(template: Template) -> str:
    """The template as a regular expression over words that each have a space before and, at the end, after them."""
    out, pos = "", 0
    for m in [*_MARKUP.finditer(template.text), None]:
        out += "".join(f" {w.decode()}" for w in words_of(template.text[pos : m.start() if m else len(template.text)]))
        if m is None:
            return out + " "
        pos, kind = m.end(), m[1].split(";")[0].strip()
        most = re.search(r"max=(\d+)", m[1])
        out += {"beginOptional": "(?:", "endOptional": ")?", "var": f"(?: [^ ]+){{0,{most[1] if most else VAR_WORDS}}}"}[kind]
    return out


_WORDS = {t.label: ", ".join(f"'{w.decode()}'" for w in words_of(t.text)) for t in BASE}
_PLACES = ", ".join(f"list_filter(range(1, len(l) + 1), lambda i: l[i:i + {w.count(',')}] = [{w}]) AS p{k}" for k, w in enumerate(_WORDS.values()))
_BASE_LABELS = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(_WORDS))
_FULL_LABELS = ", ".join(f"CASE WHEN regexp_matches(s, '{_pattern(t)}') THEN '{t.label}' END" for t in TEMPLATES)
_ALL_PLACES = "list_concat(list_concat(p0, p1), p2)"
OP1_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS l FROM documents),
p AS (SELECT doc_id, len(l) AS n_words, ' ' || array_to_string(l, ' ') || ' ' AS s, {_PLACES} FROM w),
f AS (SELECT doc_id, n_words, {_ALL_PLACES} AS b, list_filter([{_BASE_LABELS}], lambda x: x IS NOT NULL) AS bl, list_filter([{_FULL_LABELS}], lambda x: x IS NOT NULL) AS fl FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, len(b)::BIGINT AS n_base, list_min(b)::BIGINT - 1 AS first_word, list_max(b)::BIGINT - 1 AS last_word,
  array_to_string(list_sort(list_distinct(bl)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, fl))), ',') AS labels,
  CASE WHEN len(bl) + len(fl) > 0 THEN len(list_distinct(fl))::DOUBLE / len(list_distinct(list_concat(bl, fl))) ELSE 0.0 END AS score
FROM f
"""
