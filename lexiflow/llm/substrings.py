"""Substring dedup: passages of ``length`` words or more that an earlier document has.

Level-wise doubling.  At half the length, each document gives the least hash of
every ``half + 1`` neighbouring windows of ``half`` words: any window of the
full length covers so many of them, so two equal full windows always have the
same least half window in common, and few hashes stand for a document.  Only
half windows that occur in several documents survive.  They are extended to
twice their length: the full windows around them are hashed, and those that
start in a document with a smaller id are removed, with all the words that they
cover.  Longer repeats consist of such windows, so no level beyond is needed.

Whole copies of a document are found first, by a hash of all its words, and
take no part: what they repeat starts in the document that they copy.

Counts are grouped aggregates of (hash, id), combined before the shuffle; a
passage that a third of the documents share is one row per task and salt there,
and the join back to the windows is by hash and salt.  Windows and whole
documents are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .rows import with_columns
from .scratch import Scratch
from .words import placed_sums, runs, sequence_hashes, word_hashes
from .workers import lean, small_batches

LENGTH = 50
#: A hot hash is dealt to so many keys.
SALTS = 32


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    done = 1
    m = x
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    return np.minimum(m[:len(x) - width + 1], m[width - done:]) if done < width else m


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _read(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    half = length // 2
    for b in batches:
        rows = []
        for _, run in runs(list(b["text"])):
            h, at, _, _ = word_hashes(run)
            for i, t in enumerate(run):
                w = h[at[i]:at[i + 1]]
                n = len(w)
                least = np.empty(0, np.int64)
                if n >= length:
                    least = np.unique(_sliding_min(sequence_hashes(w, half), length - half + 1)).view(np.int64)
                rows.append((n, *placed_sums(w), _sha(t.split()), least))
        yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": [r[0] for r in rows], "h1": [r[1] for r in rows],
                            "h2": [r[2] for r in rows], "sha": [r[3] for r in rows], "least": [r[4] for r in rows]})


def _extend(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Full windows around surviving half windows: (h, g, doc_id, at); h and g together are a hash of 128 bits."""
    half = length // 2
    for b in batches:
        for first, run in runs(list(b["text"])):
            h, at, _, _ = word_hashes(run)
            other = word_hashes(run, seed=1)[0]
            out = []
            for i in range(len(run)):
                w = h[at[i]:at[i + 1]]
                alive = np.asarray(b["alive"].iloc[first + i], np.int64).view(np.uint64)
                least = _sliding_min(sequence_hashes(w, half), length - half + 1)
                p = np.flatnonzero(np.isin(least, alive))
                out.append(pd.DataFrame({"h": sequence_hashes(w, length)[p].view(np.int64),
                                         "g": sequence_hashes(other[at[i]:at[i + 1]], length)[p].view(np.int64),
                                         "doc_id": b["doc_id"].iloc[first + i], "at": p.astype(np.int32)}))
            yield pd.concat(out)


def _without(text: bytes, starts: np.ndarray, length: int) -> tuple[bytes, int, list[bytes]]:
    """The text without the words that windows from ``starts`` cover (a removed
    word goes with the white space after it), their number, the words kept."""
    _, _, begin, end = word_hashes([text])
    n = len(begin)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + length, n), -1)
    gone = np.cumsum(cover[:n]) > 0
    kept_words = [text[s:e] for s, e in zip(begin[~gone].tolist(), end[~gone].tolist(), strict=True)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    out, at = [], 0
    for s, e in edges.reshape(-1, 2).tolist():
        out.append(text[at:begin[s]])
        at = int(begin[e]) if e < n else len(text)
    out.append(text[at:])
    return b"".join(out), int(gone.sum()), kept_words


class Repeats:
    """What to remove: ``read`` (a row per document: doc_id, n_words, sha, first:
    the smallest id of a document with the same words) and ``starts`` (doc_id,
    starts: windows that also start in a document with a smaller id)."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"):
        self.length = length
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        with small_batches(docs.sparkSession):
            read = materialize(self.texts.mapInPandas(lean(
                lambda b: _read(b, length)), "doc_id long, n_words long, h1 long, h2 long, sha string, least array<long>"), "substring-read")
        known = read.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= length))
        firsts = materialize(known.groupBy("h1", "h2", "n_words").agg(F.min("doc_id").alias("first")), "substring-firsts")
        ids = firsts.select(F.col("first").alias("doc_id"))
        with small_batches(docs.sparkSession), Scratch() as scratch:
            least = scratch.write(read.join(ids, "doc_id", "left_semi").select("doc_id", F.explode("least").alias("h")), "substring-half")
            several = (least.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("h"))
            alive = (least.join(several, "h", "left_semi").groupBy("doc_id").agg(F.collect_list("h").alias("alive")))
            self.candidates = materialize(self.texts.join(alive, "doc_id").dropDuplicates(["doc_id"]), "substring-texts")
            scratch.drop("substring-half")
            windows = scratch.write(self.candidates.mapInPandas(lean(lambda b: _extend(b, length)), "h long, g long, doc_id long, at int"), "substring-full")
            # a hash that very many documents have is dealt out by salt: first ids are found for each salt,
            # then for the hash, and go back to the salts that have it
            salted = windows.withColumn("salt", F.pmod("doc_id", F.lit(SALTS)).cast("int"))
            key = ["h", "g"]
            some = salted.groupBy(*key, "salt").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
            start = some.groupBy(*key).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.collect_set("salt").alias("salts"))
            start = start.filter("a <> b").select(*key, "a", F.explode("salts").alias("salt"))
            self.starts = materialize(salted.join(start, [*key, "salt"]).filter("doc_id > a").groupBy("doc_id").agg(
                F.collect_list("at").alias("starts")), "substring-starts")
        f = firsts.select("first", F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("n_words").alias("k"))
        self.read = read.join(f, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n_words") == F.col("k"))
                              & F.col("doc_id").isNotNull(), "left").select("doc_id", "n_words", "sha", "first")


def digest(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, a row per row of ``docs``.

    Null, empty and wordless texts have no words.  Rows with a null id are left
    as they are and remove nothing elsewhere; rows that share an id must share
    their text and are treated alike.  Other columns are left out; an empty
    table gives an empty result."""
    found = Repeats(docs, length, id_col, text_col)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = [_without(t.encode("utf-8"), np.asarray(s, np.int64), length)[1:] for t, s in zip(b["text"], b["starts"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "removed": [x[0] for x in r], "cut_sha": [_sha(x[1]) for x in r]})

    cuts = materialize(found.candidates.select("doc_id", "text").join(found.starts, "doc_id").mapInPandas(
        lean(cut), "doc_id long, removed long, cut_sha string"), "substring-cuts")
    copy = F.col("first") < F.col("doc_id")
    return found.read.join(cuts, "doc_id", "left").select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_sha([]))).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text; all columns, the
    text changed only where words go.  A text may end up empty.  See
    ``digest`` for nulls, repeated ids and empty tables."""
    found = Repeats(docs, length, id_col, text_col)
    copies = found.read.filter("first < doc_id").select("doc_id", F.array(F.lit(-1)).alias("starts")).distinct()
    todo = materialize(found.starts.unionByName(copies).select(
        F.col("doc_id").alias("__llm_id"), F.col("starts").alias("__llm_starts")), "substring-todo")

    def cut(texts: list, starts: list) -> list:
        return [[t if s is None or t is None else "" if s == [-1] else
                 _without(t.encode("utf-8"), np.asarray(s, np.int64), length)[0].decode("utf-8")
                 for t, s in zip(texts, starts, strict=True)]]

    joined = docs.join(todo, docs[id_col] == todo["__llm_id"], "left").drop("__llm_id")
    return with_columns(joined, [text_col, "__llm_starts"], cut, [(text_col, T.StringType())]).drop("__llm_starts")
