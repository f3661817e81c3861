"""The licence scan against a plain version without slices, index or votes."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lexiflow.llm import licenses as L
from test_llm import DOCS, awkward_rows

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows):
    """Every template is tried at every place of every text."""
    texts = [words(t) for _, t in rows]
    df = {}
    for w in texts:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    idf = lambda w: math.log1p(len(texts) / (1 + df.get(w, 0)))
    out = []
    for (doc, _), w in zip(rows, texts):
        at = lambda i: w[i] if 0 <= i < len(w) else None  # noqa: B023, E731
        base = [(label, i) for i in range(len(w)) for p, label in L.BASE_PHRASES if w[i:i + len(p.split())] == p.split()]
        labels, score = {x for x, _ in base}, 0.0
        for label, notice, keys in L.TEMPLATES:
            t = words(notice)
            anchors = sorted(set(t), key=lambda x: (-idf(x), x.encode()))[:L.ANCHORS]
            if not any(a in w for a in anchors):
                continue
            near = range(-L.SLACK, L.SLACK + 1)
            for place in range(-len(t), len(w)):
                votes = {x for x in anchors for q, y in enumerate(t) if x == y
                         for d in range(L.SLACK + 1) if at(place + q + d) == x}
                starts = any(at(place + q) == x for q, x in enumerate(t) if x in anchors)
                if not starts or len(votes) < math.ceil(L.AGREE * len(anchors)):
                    continue
                spots = [(next(q for q in range(len(t)) if t[q:q + len(words(k))] == words(k)), words(k)) for k in keys]
                if not all(any(all(at(place + q + d + j) == x for j, x in enumerate(k)) for d in near) for q, k in spots):
                    continue
                share = sum(idf(x) for q, x in enumerate(t) if any(at(place + q + d) == x for d in near)) / sum(map(idf, t))
                score = max(score, share)
                if share >= L.ACCEPT:
                    labels.add(label)
        starts = [i for _, i in base]
        out.append((doc, len(w), len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({x for x, _ in base})), ",".join(sorted(labels)), round(min(score, 1.0), 9)))
    return sorted(out, key=repr)


def got(docs):
    return sorted(((*r[:-1], round(r[-1], 9)) for r in map(tuple, L.digest(docs).collect())), key=repr)


NOTICES = [n for _, n, _ in L.TEMPLATES] + [
    "x " * 50 + "Permission is hereby granted, free of any charge, to any person obtaining a copy",
    "PERMISSION IS HEREBY GRANTED, FREE OF CHARGE, to anyone obtaining one copy of this software and its associated\n"
    "documentation files to deal in the software without restriction",
    "the mit licenses and apache-license, general public\nLICENSE; MIT  license", "mit", "license mit", "Größe mit licenseé",
    "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", "cc by nc sa 4 0 licensed under", "general public general public license"]


def test_notices_and_awkward_rows(spark):
    rows = awkward_rows() + [(100 + i, t, "en", "s", 1, "x", 1, 2, 3) for i, t in enumerate(NOTICES)]
    docs = spark.createDataFrame(rows, DOCS)
    extra = docs.withColumn("found", F.lit("x")).withColumn("n_words", F.lit(1))
    assert got(extra) == plain([(r[0], r[1]) for r in rows])
    by_id = {r[0]: r for r in got(docs)}
    for i, (label, _, _) in enumerate(L.TEMPLATES):
        assert label in by_id[100 + i][6].split(","), L.TEMPLATES[i]


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got(docs) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("size", [7, 64])
def test_long_text_in_slices(spark, monkeypatch, size):
    """A text of many slices is scanned like one; a text of megabytes passes."""
    text = " ".join(NOTICES * 3)
    index = L.build_index({}, 1)
    whole = L.scan_text(text, index, index.wanted)
    monkeypatch.setattr(L, "_SLICE", size)
    assert L.scan_text(text, index, index.wanted) == whole
    monkeypatch.undo()
    long = spark.createDataFrame([(1, "word " * 600_000 + "MIT License")], "doc_id long, text string")
    (row,) = L.digest(long).collect()
    assert (row["n_words"], row["first_word"], row["labels"]) == (600_002, 600_000, "mit")


def test_empty(spark):
    assert L.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_key_phrases_are_part_of_their_notices():
    with pytest.raises(ValueError):
        L.build_index({}, 1, [("x", "some notice", ["other words"])])
