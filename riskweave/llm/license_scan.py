"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. The join finds every pair of a block and
a template that share at least ``threshold`` of the template's distinct words. Template words are ordered by their
frequency over all documents, rarest first, and:

* *prefix*: a block with ``need = ceil(threshold * size)`` words of a template has one of its ``size - need + 1`` rarest;
* *length*: it has at least ``need`` distinct words;
* *position*: from the first common word on, both still have enough words to reach ``need``.

Pairs that pass are counted in full. Blocks are the lines of a text and, for notices that are wrapped or stand inside
long lines, windows of the whole text every half window. A template's windows have ``window`` words, doubled until they are
twice the template's, so wherever it stands a window holds it whole, whatever its length.

The templates are a bounded parameter and go to every task; the documents stay where they were read. The only exchange
is the count of template words, one row per word and task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_field

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Short notices by which works name their license, label: text.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.9
WINDOW = 120
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 10 if b == 10 else 32 for b in range(256))

LICENSES = "struct<n_words: bigint, places: array<struct<label: string, word: bigint>>, blocks: array<struct<label: string, word: bigint, words: int, containment: double>>>"


def folded(text: str | None) -> bytes:
    """The text with A-Z lower-cased and all between words a space, but line ends."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[str, int]]:
    """(label, index of its first word) of every place where a phrase's words stand one after the other."""
    out, flat = [], None
    for phrase, label in phrases.items():
        want = phrase.encode().split()
        if flat is None:
            flat = b" " + b" ".join(words) + b" "
        sought = b" " + b" ".join(want) + b" "
        at, word, before = flat.find(sought), 0, 0
        while at >= 0:
            word, before = word + flat.count(b" ", before, at), at
            out.append((label, word))
            at = flat.find(sought, at + 1)
    return out


class TemplateJoin:
    """The join of one block at a time with all templates. ``frequency``: of template words over all documents."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float, frequency: dict[str, int]):
        vocabulary = {w for _, t in templates for w in folded(t).split()}
        order = sorted(vocabulary, key=lambda w: (frequency.get(w.decode("utf-8"), 0), w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.templates = []
        self.posting: dict[bytes, list[tuple[int, int]]] = {}
        for label, text in templates:
            words = sorted(set(folded(text).split()), key=self.rank.__getitem__)
            n = len(words)
            need = max(1, ceil(threshold * n - 1e-9))
            self.templates.append((label, n, need, frozenset(words)))
            for at, w in enumerate(words[: n - need + 1]):
                self.posting.setdefault(w, []).append((len(self.templates) - 1, at))
        self.prefix_words = frozenset(self.posting)
        self.least = min((need for _, _, need, _ in self.templates), default=1)

    def block(self, words: set[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that the block's distinct words contain."""
        if len(words) < self.least or words.isdisjoint(self.prefix_words):
            return []
        mine = sorted(words.intersection(self.rank), key=self.rank.__getitem__)
        out, seen = [], set()
        for j, w in enumerate(mine):
            for k, at in self.posting.get(w, ()):
                label, n, need, whole = self.templates[k]
                if k in seen:
                    continue
                seen.add(k)
                if len(words) >= need and 1 + min(n - at - 1, len(mine) - j - 1) >= need and (common := len(whole.intersection(mine))) >= need:
                    out.append((label, common / n))
        return out


class BlockJoin:
    """The lines of a text joined with all templates, and its windows of each size with the templates of that size."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float, frequency: dict[str, int], window: int):
        templates = tuple(t for t in templates if folded(t[1]).split())
        self.lines = TemplateJoin(templates, threshold, frequency)
        sizes: dict[int, list[tuple[str, str]]] = {}
        for t in templates:
            size = max(2, window)
            while size < 2 * len(folded(t[1]).split()):
                size *= 2
            sizes.setdefault(size, []).append(t)
        self.windows = [(size, TemplateJoin(tuple(own), threshold, frequency)) for size, own in sorted(sizes.items())]

    def blocks(self, raw: bytes, words: list[bytes], distinct: set[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, words, containment) of every block and template that match, by place."""
        if distinct.isdisjoint(self.lines.prefix_words):
            return []
        found, at = set(), 0
        for line in raw.split(b"\n"):
            own = line.split()
            found.update((label, at, len(own), c) for label, c in self.lines.block(set(own)))
            at += len(own)
        for size, join in self.windows:
            if not distinct.isdisjoint(join.prefix_words):
                half = size // 2  # at least as many words as any of these templates has
                for at in range(0, max(1, len(words) - half), half):
                    own = words[at : at + size]
                    found.update((label, at, len(own), c) for label, c in join.block(set(own)))
        return sorted(found, key=lambda b: (b[1], b[2], b[0], b[3]))


def _scan(raw: bytes, join: BlockJoin, phrases: dict[str, str]) -> dict:
    words = raw.split()
    if not words:
        return {"n_words": 0, "places": [], "blocks": []}
    distinct = set(words)
    could = {p: label for p, label in phrases.items() if all(w in distinct for w in p.encode().split())}
    places = sorted(({"label": label, "word": at} for label, at in phrase_places(words, could)), key=lambda x: (x["word"], x["label"]))
    blocks = [dict(zip(("label", "word", "words", "containment"), b, strict=True)) for b in join.blocks(raw, words, distinct)]
    return {"n_words": len(words), "places": places, "blocks": blocks}


def template_frequency(docs: DataFrame, text_col: str, templates: tuple[tuple[str, str], ...]) -> dict[str, int]:
    """In how many documents each template word stands; all documents, one row per word and task."""
    vocabulary = frozenset(w for _, t in templates for w in folded(t).split())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(vocabulary.intersection(folded(text.as_py()).split()))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(rows, "word string, n long")
    return dict(counted.groupBy("word").agg(F.sum("n")).collect())  # a row for each template word


def scan_licenses(docs: DataFrame, *, text_col: str = "text", out_col: str = "licenses", phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """``docs`` and a struct: n_words, phrase places, and matching blocks (label, first word, length in words, containment).

    A null or empty text has none; of an empty table there are no rows; repeated rows each get their own. A text of any length
    is read whole, in time that grows with its length and the number of window sizes. A column named ``out_col`` is
    replaced, other columns stay. Without templates, or with ones that have no words, only phrases are found.
    """
    phrases = PHRASES if phrases is None else phrases
    join = BlockJoin(templates, threshold, template_frequency(docs, text_col, templates), window)
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)
    kind = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))), ("blocks", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int32()), ("containment", pa.float64())])))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([_scan(folded(t.as_py()), join, phrases) for t in batch.column(at)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(rows, with_field(docs, out_col, LICENSES))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: the largest containment of a matching block; 1 where a phrase stands; 0 without either."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    places, blocks = F.col("licenses.places"), F.col("licenses.blocks")
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", F.col("licenses.n_words").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places.getField("word")).alias("first_word"), F.array_max(places.getField("word")).alias("last_word"),
        join(places.getField("label")).alias("base_labels"), join(F.concat(places.getField("label"), blocks.getField("label"))).alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce(F.array_max(blocks.getField("containment")), F.lit(0.0))).alias("score"),
    )
