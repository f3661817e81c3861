"""The Merkle manifest against plain hashlib, over several tiers of blocks and awkward rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexiflow.llm import merkle
from lexiflow.llm.scratch import Scratch

from test_llm import DOCS, awkward_rows

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(hashes):
    """Root, and for each leaf its steps (left, right)."""
    steps, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // 8 * 8
            steps[k].append(("".join(level[run:i]), "".join(level[i + 1:run + 8])))
            at[k] = i // 8
        level = [sha("".join(level[j:j + 8])) for j in range(0, len(level), 8)]
    return level[0], steps


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf([r[f] for f in FIELDS]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, tops = climb([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (_, _, h, r), low in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            way, cur = low + top, h
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                cur = leaf([r["text"].translate(LOWER) if f == "text" and r["text"] is not None else r[f] for f in FIELDS])
            for a, b in way:
                cur = sha(a + cur + b)
            out.append((r["doc_id"], h, trees[g][0], root, sha("".join(a + b for a, b in way)), cur, cur == root))
    return sorted(out, key=repr)


def run(docs, digits):
    low = "".join(map(chr, range(97, 123)))
    with Scratch() as scratch:
        got = merkle.manifest(docs, FIELDS, "doc_id", "lang", scratch,
                              altered={"text": F.translate("text", low.upper(), low)},
                              where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, digits=digits)
        return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("digits", [1, 2])
def test_tiers(spark, digits):
    """600 rows in one language (four levels), single ones in others, in blocks of 8 or 64."""
    rows = [(i, f"Text {i % 50} Ä", "en" if i < 600 else f"l{i}" if i < 620 else None, None if i % 7 else "s", i)
            for i in range(630)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = run(docs, digits)
    assert got == plain([r.asDict() for r in docs.collect()])
    assert {True, False} == {r[-1] for r in got}


def test_awkward_rows(spark):
    docs = spark.createDataFrame(awkward_rows() + [(77, "Long " * 300_000, "en", "s", 1, "x", 1, 2, 3)], DOCS)
    got = merkle.manifest_of_documents(docs.withColumn("root", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("g", F.lit("z")))
    assert sorted(map(tuple, got.collect()), key=repr) == plain([r.asDict() for r in docs.collect()])


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "Abc", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle.manifest_of_documents(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == sha("")
    assert merkle.manifest_of_documents(one.limit(0)).collect() == []
