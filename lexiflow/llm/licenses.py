"""Licence scan: which licences a text names or carries, and where.

Positional rare-token index.  The templates are short public licence notices.
One pass counts in how many documents each template word occurs.  The words of
a template with the highest inverse document frequency are its anchors, and
the index lists for each anchor the templates and positions that have it.  A
second pass looks up the anchors of each text: an occurrence at word p of an
anchor at position q of a template votes for that template at p - q.  Where
enough different anchors of a template agree on a place (to within ``SLACK``
words), the template's mandatory key phrases must stand there, and the share
of its words (weighted by IDF) that stand in place decides.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: The base phrases and their labels.
BASE_PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Fixed values: (label, notice, mandatory key phrases); phrases are part of the notice.
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction",
     ["permission is hereby granted free of charge", "associated documentation files"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0",
     ["except in compliance with the license", "apache org licenses"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License", ["gnu affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "Licensed under the BSD License", ["bsd license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted", ["with or without fee is hereby granted"]),
    ("mpl", "subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("epl", "made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ["boost software license"]),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software",
     ["express or implied warranty", "in no event will the authors be held liable"]),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
    ("cc0", "Licensed under CC0 1.0 Universal", ["cc0 1 0"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0", ["cc by nc sa"]),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0", ["cc by nc nd"]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License",
     ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
     ["creative commons attribution sharealike"]),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     ["creative commons attribution noncommercial 4 0"]),
]

ANCHORS = 4         # indexed words of a template, those with the highest IDF
SLACK = 3           # words by which places of one template may differ
AGREE = 0.5         # share of a template's anchors that must agree on a place
ACCEPT = 0.6        # least weighted share of a template's words in place

_SLICE = 1 << 20
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split()


class _Words:
    """Words of one text.  Only a slice of about a megabyte is split at a time."""

    def __init__(self, text: str, wanted: frozenset[bytes]):
        raw = text.encode("utf-8", "surrogatepass").translate(_WORD)
        self.slices, self.starts, self.held, self.hits, at, n = [], [], {}, [], 0, 0
        while at < len(raw):
            cut = raw.find(b" ", at + _SLICE)
            part = raw[at:] if cut < 0 else raw[at:cut]
            at += len(part)
            words = part.split()
            if not wanted.isdisjoint(words):
                self.hits += [(n + i, w) for i, w in enumerate(words) if w in wanted]
            self.slices.append(part)
            self.starts.append(n)
            n += len(words)
            self.held = {len(self.slices) - 1: words}
        self.n = n

    def __getitem__(self, i: int) -> bytes | None:
        if not 0 <= i < self.n:
            return None
        lo, hi = 0, len(self.starts) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.starts[mid] <= i else (lo, mid - 1)
        if lo not in self.held:
            if len(self.held) > 1:
                self.held.pop(next(iter(self.held)))
            self.held[lo] = self.slices[lo].split()
        return self.held[lo][i - self.starts[lo]]

    def stands(self, phrase: Sequence[bytes], at: int) -> bool:
        return all(self[at + k] == w for k, w in enumerate(phrase))


@dataclass
class Index:
    """Templates by label and words, their weights, and the postings of their anchors."""

    labels: list[str]
    words: list[list[bytes]]
    keys: list[list[tuple[int, list[bytes]]]]         # place in the template, phrase
    weights: list[list[float]]
    need: list[int]
    postings: dict[bytes, list[tuple[int, int]]]
    base: list[tuple[list[bytes], str]]

    @property
    def wanted(self) -> frozenset[bytes]:
        return frozenset(self.postings) | {p[0] for p, _ in self.base}


def _place(phrase: list[bytes], words: list[bytes]) -> int:
    for i in range(len(words) - len(phrase) + 1):
        if words[i:i + len(phrase)] == phrase:
            return i
    raise ValueError(f"key phrase {b' '.join(phrase).decode()!r} is not part of its notice")


def build_index(df: Mapping[bytes, int], n_docs: int, templates=TEMPLATES, base=BASE_PHRASES) -> Index:
    idf = lambda w: math.log1p(n_docs / (1 + df.get(w, 0)))
    postings, out = defaultdict(list), Index([], [], [], [], [], {}, [(words_of(p), label) for p, label in base])
    for t, (label, notice, phrases) in enumerate(templates):
        words = words_of(notice)
        anchors = sorted(set(words), key=lambda w: (-idf(w), w))[:ANCHORS]
        for q, w in enumerate(words):
            if w in anchors:
                postings[w].append((t, q))
        total = sum(map(idf, words)) or 1.0
        out.labels.append(label)
        out.words.append(words)
        out.keys.append([(_place(k, words), k) for k in map(words_of, phrases)])
        out.weights.append([idf(w) / total for w in words])
        out.need.append(max(1, math.ceil(AGREE * len(anchors))))
    out.postings = dict(postings)
    return out


def _candidates(votes: list[tuple[int, bytes]], need: int) -> set[int]:
    """Places that begin a run of ``SLACK`` words in which enough different anchors agree."""
    votes.sort()
    found, inside, j = set(), defaultdict(int), 0
    for i, (place, word) in enumerate(votes):
        while j < len(votes) and votes[j][0] <= place + SLACK:
            inside[votes[j][1]] += 1
            j += 1
        if len(inside) >= need:
            found.add(place)
        inside[word] -= 1
        if not inside[word]:
            del inside[word]
    return found


def _share(words, index: Index, t: int, place: int) -> float | None:
    """Weighted share of the template's words in place; None if a key phrase is missing."""
    for q, phrase in index.keys[t]:
        if not any(words.stands(phrase, place + q + d) for d in range(-SLACK, SLACK + 1)):
            return None
    return sum(weight for q, (w, weight) in enumerate(zip(index.words[t], index.weights[t]))
               if any(words[place + q + d] == w for d in range(-SLACK, SLACK + 1)))


def scan_text(text: str | None, index: Index, wanted: frozenset[bytes]) -> tuple[int, list[dict], list[dict]]:
    """Number of words, base places (label, start), and templates in place
    (label, template, start, share): of each template the best place in reach."""
    words = _Words(text or "", wanted)
    base = [{"label": label, "start": i} for i, w in words.hits for phrase, label in index.base
            if w == phrase[0] and words.stands(phrase, i)]
    votes = defaultdict(list)
    for p, w in words.hits:
        for t, q in index.postings.get(w, ()):
            votes[t].append((p - q, w))
    found = []
    for t, cast in votes.items():
        best = None
        for place in sorted(_candidates(cast, index.need[t])):
            share = _share(words, index, t, place)
            if share is None:
                continue
            if best is not None and place - best["start"] <= SLACK:
                if share > best["share"]:
                    best.update(start=place, share=share)
                continue
            best = {"label": index.labels[t], "template": t, "start": place, "share": share}
            found.append(best)
    return words.n, base, sorted(found, key=lambda m: (m["start"], m["template"]))


def _count_words(batches: Iterator[pa.RecordBatch], vocabulary: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    counts, n = defaultdict(int), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n += 1
            raw, at, seen = (text or "").encode("utf-8", "surrogatepass").translate(_WORD), 0, set()
            while at < len(raw):
                cut = raw.find(b" ", at + _SLICE)
                part = raw[at:] if cut < 0 else raw[at:cut]
                at += len(part)
                seen |= vocabulary.intersection(part.split())
            for w in seen:
                counts[w] += 1
    yield pa.RecordBatch.from_pydict({"word": [b"", *counts], "n": [n, *counts.values()]},
                                     schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))


def document_frequencies(texts: DataFrame, templates=TEMPLATES) -> tuple[dict[bytes, int], int]:
    """In how many rows each template word occurs, and the number of rows;
    what comes to the driver is bounded by the templates."""
    vocabulary = frozenset(w for _, notice, _ in templates for w in words_of(notice))
    rows = (texts.mapInArrow(lambda b: _count_words(b, vocabulary), "word binary, n long")
                 .groupBy("word").agg(F.sum("n").alias("n")).collect())
    counts = {bytes(r["word"]): r["n"] for r in rows}
    n = counts.pop(b"", 0)
    return counts, n


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("share", pa.float64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE_PHRASES) -> DataFrame:
    """doc_id, n_words, base (label, start) and found (label, template, start,
    share), a row per row of ``docs``.

    A-Z is lower-cased; words are runs of digits, letters a-z and characters
    beyond ASCII, counted from 0.  ``base`` lists every place where a base
    phrase stands; ``found`` every place where a template's key phrases stand
    and its anchors agree, with its share, which labels the text if it is
    ``ACCEPT`` or more.  A null text is empty; an empty one has no words;
    repeated rows and rows with a null id are scanned like any other; an empty
    table gives no rows; other columns are left out."""
    index = build_index(*document_frequencies(docs.select(F.col(text_col).alias("text")), templates), templates, base)
    wanted = index.wanted
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [scan_text(text, index, wanted) for text in batch.column(1).to_pylist()]
            n, places, found = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(to_arrow_type(kind)), pa.array(n, pa.int64()), pa.array(places, _PLACES), pa.array(found, _MATCHES)],
                ["doc_id", "n_words", "base", "found"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, n_words long, base array<struct<label:string,start:long>>, "
             "found array<struct<label:string,template:int,start:long,share:double>>")


def digest(docs: DataFrame) -> DataFrame:
    """The scan in one row per document: n_words, n_base, first_word and
    last_word (of the base places, else null), base_labels, labels (base and
    accepted templates) and score, the best share of a template in place (0
    without one)."""
    starts = F.transform("base", lambda b: b["start"])
    of_base = F.transform("base", lambda b: b["label"])
    of_found = F.transform(F.filter("found", lambda m: m["share"] >= ACCEPT), lambda m: m["label"])
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return scan(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(of_base).alias("base_labels"),
        joined(F.concat(of_base, of_found)).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0))).alias("score"))
