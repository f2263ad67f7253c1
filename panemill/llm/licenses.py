"""Licence scans: a positional index of the rarest words of licence passages, looked up along whole files."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panemill.llm.common import give_back, keep_columns, table

#: A word of lower-cased UTF-8: ASCII letters and digits and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: So many hundredths of a passage's words stand at its places where it is found, and so many of its rarest words vote.
COVERED, VOTES = 80, 2
#: Words of a mandatory key phrase stand between these in a passage's text.
OPEN, SHUT = "[", "]"
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

# The phrases that name a licence by themselves, and their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# Passages of the public licences and of the notices that refer to them; key phrases stand in brackets.
PASSAGES = (
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in [all copies or substantial portions of the software]"),
    ("apache", "licensed under the [apache license version 2 0] the license you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software [distributed under the license is distributed on an as is basis] without warranties or conditions of any kind"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software foundation"),
    ("gpl", "licensed under the [gnu general public license]"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the [gnu lesser general public license] as published by the free software foundation"),
    ("agpl", "it under the terms of the [gnu affero general public license] as published by the free software foundation"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "[redistributions of source code must retain] the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the [mozilla public license] v 2 0"),
    ("boost", "[boost software license] version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the [public domain]"),
    ("cc0", "to the extent possible under law the author has [waived all copyright and related or neighboring rights] to this work"),
    ("cc-by", "licensed under [cc by] 4 0"),
    ("cc-by", "licensed under a [creative commons attribution 4 0] international license"),
    ("cc-by-sa", "licensed under [cc by sa] 4 0"),
    ("cc-by-sa", "licensed under a [creative commons attribution sharealike 4 0] international license"),
    ("cc-by-nc", "licensed under [cc by nc] 4 0"),
    ("cc-by-nc", "licensed under a [creative commons attribution noncommercial 4 0] international license"),
    ("cc-by-nd", "licensed under [cc by nd] 4 0"),
)


@dataclass(frozen=True)
class Template:
    """A passage as words; ``must`` are the places of its key phrases. A base phrase is one that holds in full."""

    label: str
    words: tuple[bytes, ...]
    must: frozenset[int]
    base: bool = False

    @property
    def spare(self) -> int:
        """How many of its places may hold other words."""
        return 0 if self.base else len(self.words) * (100 - COVERED) // 100

    @property
    def votes(self) -> int:
        """How many of its looked-up words agree wherever it stands."""
        return min(VOTES, len(self.words) - self.spare)


def template(label: str, text: str, *, base: bool = False) -> Template:
    words, must = [], set()
    for i, piece in enumerate(re.split(r"[\[\]]", text)):
        found = WORD.findall(piece.encode().lower())
        if i % 2:
            must |= set(range(len(words), len(words) + len(found)))
        words += found
    if not words:
        raise ValueError(f"a passage without words: {text!r}")
    return Template(label, tuple(words), frozenset(range(len(words)) if base else must), base)


def templates(phrases: Sequence[tuple[str, str]] = PHRASES, passages: Sequence[tuple[str, str]] = PASSAGES) -> list[Template]:
    return [template(*p, base=True) for p in phrases] + [template(*p) for p in passages]


def licence_words(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """How many documents there are, and how many hold each word of the passages.

    Counts of a batch are added up before they are shuffled; the driver gets one number for each word of the passages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                seen += 1
                held = {m.group() for m in WORD.finditer(_bytes(text).lower())} & vocabulary
                found.update(held)
        yield pa.RecordBatch.from_arrays([pa.array([b"", *found], pa.binary()), pa.array([seen, *found.values()], pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


@dataclass(frozen=True)
class Index:
    """Of each template its rarest words: word to (template, place). ``vocabulary`` numbers all words of all templates."""

    templates: tuple[Template, ...]
    postings: Mapping[bytes, tuple[tuple[int, int], ...]]
    vocabulary: frozenset[bytes]


def rare_index(found: Sequence[Template], n_docs: int, df: Mapping[bytes, int]) -> Index:
    """Index the words of highest IDF of each template.

    A template stands where no more than ``spare`` of its places differ: of any ``spare + votes`` of its places ``votes``
    hold the same word there. So many of its rarest ones are looked up, and no place where it stands is missed.
    """
    postings = defaultdict(list)
    for t, each in enumerate(found):
        idf = [log((n_docs + 1) / (df.get(w, 0) + 1)) for w in each.words]
        rarest = sorted(range(len(each.words)), key=lambda q: (-idf[q], q))[: each.spare + each.votes]
        for q in rarest:
            postings[each.words[q]].append((t, q))
    return Index(tuple(found), {w: tuple(p) for w, p in postings.items()}, frozenset(w for t in found for w in t.words))


@dataclass
class Scan:
    """What a file holds: words, and the (template, place, share) of each passage that stands in it."""

    n_words: int
    found: list[tuple[Template, int, float]]


def scan(body: bytes, index: Index) -> Scan:
    """Look a file's licence words up, intersect postings by their place relative to the file, and verify what is left.

    Only licence words are held. Of a template's looked-up words at least ``votes`` must agree about where it begins;
    there its mandatory phrases must stand word by word, and enough of all its words.
    """
    at: dict[int, bytes] = {}
    agreed: Counter[tuple[int, int]] = Counter()
    n = 0
    for n, m in enumerate(WORD.finditer(body), 1):
        word = m.group()
        if word in index.vocabulary:
            at[n - 1] = word
            agreed.update((t, n - 1 - q) for t, q in index.postings.get(word, ()))
    found = []
    for (t, start), votes in agreed.items():
        each = index.templates[t]
        if votes >= each.votes and all(at.get(start + q) == each.words[q] for q in each.must):
            same = sum(at.get(start + q) == w for q, w in enumerate(each.words))
            if len(each.words) - same <= each.spare:
                found.append((each, start, same / len(each.words)))
    return Scan(n, found)


def _columns(result: Scan) -> tuple:
    base = [(e.label, start) for e, start, _ in result.found if e.base]
    places = [start for _, start in base]
    joined: Callable[[set[str]], str] = lambda labels: ",".join(sorted(labels))
    return (result.n_words, len(base), min(places, default=None), max(places, default=None), joined({x for x, _ in base}), joined({e.label for e, _, _ in result.found}), max((s for _, _, s in result.found), default=0.0))


def licenses(docs: DataFrame, known: Sequence[Template] | None = None) -> DataFrame:
    """Add to each row of ``docs`` (text) the licences that its text names or holds.

    Columns: n_words; of the phrases that name a licence: n_base places, first_word and last_word (the smallest and largest
    start, in words from 0; null for none), base_labels; labels (these and those of passages), sorted and joined by commas;
    score: the largest share of a passage's words that stand at their places, 1 for a phrase, 0 for nothing. Columns
    of these names in the input give way; all others stay. A-Z count as a-z.

    A passage stands where 80 of 100 of its words do, one beside the other as in the passage, its key phrases in full. It
    may begin before the file, where its first words are missing. Null and empty texts hold nothing; texts are scanned
    whole; repeated rows are judged one by one; ties of passages give all their labels; an empty table stays empty. Without
    templates nothing is found.

    One pass counts in how many documents each licence word stands: a number for each word of the passages. The index
    holds each passage's rarest words by these counts; another pass looks each text up in it. Which words are rare decides
    how much is verified, not what is found. Nothing else is shuffled.
    """
    known = templates() if known is None else list(known)
    index = rare_index(known, *licence_words(docs, frozenset(w for t in known for w in t.words)))
    # the row goes into a struct, so that no column of its own can clash
    rows = docs.select(F.struct(*keep_columns(docs, ADDED)).alias("row"), F.col("text").cast("string").alias("text"))
    schema = StructType().add("row", rows.schema["row"].dataType)
    for name, kind in zip(ADDED, ("long", "long", "long", "long", "string", "string", "double"), strict=True):
        schema = schema.add(name, kind)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", *ADDED]
        for batch in batches:
            found = [_columns(scan(_bytes(text).lower(), index)) for text in batch.column(1)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*found, strict=True)) or [[]] * len(ADDED)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)
        give_back()

    found = rows.mapInArrow(look_up, schema)
    return found.select(*keep_columns(docs, ADDED, "row"), *ADDED)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _sql() -> str:
    places = [(t, q, each.label, each.base, w.decode(), q in each.must) for t, each in enumerate(templates()) for q, w in enumerate(each.words)]
    values = ", ".join(f"({t}, {q}, '{label}', {base}, '{w}', {must})" for t, q, label, base, w, must in places)
    return rf"""
WITH p(t, q, label, base, word, must) AS (VALUES {values}),
n AS (SELECT t, label, base, count(*) AS n, count(*) FILTER (must) AS musts FROM p GROUP BY ALL),
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS spot FROM w),
m AS (SELECT doc_id, t, spot - q AS start, count(*) AS same, count(*) FILTER (must) AS held FROM e JOIN p USING (word) GROUP BY ALL),
f AS (
  SELECT doc_id, start, label, base, same / n AS share FROM m JOIN n USING (t)
  WHERE held = musts AND CASE WHEN base THEN same = n ELSE n - same <= n * {100 - COVERED} // 100 END),
g AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    list_sort(list_distinct(list(label) FILTER (base))) AS base_labels, list_sort(list_distinct(list(label))) AS labels, max(share) AS score
  FROM f GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0) AS score
FROM w LEFT JOIN g ON g.doc_id = w.doc_id"""


SQL = _sql()
