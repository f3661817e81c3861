"""A part-of-speech tagger trained here, for the tagger hook of the corpus.

A bigram hidden Markov model.  Training is one aggregation over tagged
documents: (word, tag), (word ending, tag) and (tag before, tag) are counted in
the row's arrays and combined before the shuffle.  Words and endings are counted
in a fixed number of buckets (CRC-32 of the lower case), so the counts that come
to the driver, and the model that goes to the workers, are bounded by buckets x
tags however large the vocabulary.

    P(tag | ending) = (count(ending, tag) + K P(tag)) / (count(ending) + K)
    P(tag | word)   = (count(word, tag) + K P(tag | ending)) / (count(word) + K)

A path scores the sum of log P(tag | word) - log P(tag) + log P(tag | tag before);
the best one (Viterbi) is the tagging.  Documents pass the workers in Arrow
batches, next to the columns they came with; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .tagging import Tagger

WORD_BUCKETS, ENDING_BUCKETS = 16_384, 4_096
ENDING = 3          # characters
K = 4.0             # what the coarser estimate is worth, in occurrences
START = ""          # the tag before the first one
TEXTS = 256         # documents that are tagged at a time


@dataclass(frozen=True)
class TagModel:
    tags: list[str]
    words: np.ndarray       # buckets x tags, counts
    endings: np.ndarray
    prior: np.ndarray       # P(tag)
    moves: np.ndarray       # (1 + tags) x tags, log P(tag | tag before); the last row is the start

    def evidence(self, words: Sequence[str]) -> np.ndarray:
        """log P(tag | word) - log P(tag) of each word, words x tags."""
        w = self.words[[bucket(x, WORD_BUCKETS) for x in words]]
        e = self.endings[[bucket(x[-ENDING:], ENDING_BUCKETS) for x in words]]
        by_ending = (e + K * self.prior) / (e.sum(1, keepdims=True) + K)
        by_word = (w + K * by_ending) / (w.sum(1, keepdims=True) + K)
        return np.log(by_word) - np.log(self.prior)

    def best_path(self, evidence: np.ndarray) -> np.ndarray:
        """Viterbi: the best tag of each row of ``evidence`` (ties: the tag that comes first)."""
        n, k = evidence.shape
        back = np.zeros((n, k), np.int32)
        score = self.moves[k] + evidence[0]
        for i in range(1, n):
            paths = score[:, None] + self.moves[:k]
            back[i] = paths.argmax(0)
            score = paths.max(0) + evidence[i]
        out = np.empty(n, np.int64)
        out[-1] = score.argmax()
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def best_paths(self, evidence: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``best_path`` of many texts at once: ``at`` has the texts' rows of
        ``evidence`` one after the other.  The longest texts come first, so those
        that still go on at a step are the first ones."""
        k = evidence.shape[1]
        order = np.argsort(-sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        going = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")      # texts longer than step i
        to_from = np.ascontiguousarray(self.moves[:k].T)
        back = np.zeros((len(at), k), np.int16)
        out = np.empty(len(at), np.int64)
        score = self.moves[k] + evidence[at[begin[:going[0]]]] if len(going) else None
        for i in range(1, len(going)):
            here = begin[:going[i]] + i
            out[begin[going[i]:going[i - 1]] + i - 1] = score[going[i]:].argmax(1)
            paths = score[:going[i], None, :] + to_from
            back[here] = best = paths.argmax(2)
            score = np.take_along_axis(paths, best[:, :, None], 2)[:, :, 0] + evidence[at[here]]
        if len(going):
            out[begin[:going[-1]] + len(going) - 1] = score.argmax(1)
        for i in range(len(going) - 1, 0, -1):
            here = begin[:going[i]] + i
            out[here - 1] = back[here, out[here]]
        return out

    def tag(self, words: Sequence[str]) -> list[str]:
        return self.tag_all(pa.array([list(words)], pa.list_(pa.string())))[0].as_py()

    def tag_all(self, texts: pa.Array) -> pa.Array:
        """The tags of each text of a list array; a null one stays null."""
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.fill_null(texts.flatten(), "").dictionary_encode()
        edges = np.concatenate([[0], np.cumsum(sizes)])
        found = np.zeros(0, np.int64)
        if edges[-1]:
            found = self.best_paths(self.evidence(coded.dictionary.to_pylist()), coded.indices.to_numpy(zero_copy_only=False), sizes)
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(self.tags, pa.string()).take(pa.array(found)), mask=texts.is_null())


def bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % buckets


def _bucket(word: Column, buckets: int) -> Column:
    return (F.crc32(word.cast("binary")) % buckets).cast("string")


def train_tagger(rows: DataFrame) -> TagModel:
    """From document (segment) rows with arrays ``low`` and ``tags``; a segment
    counts its own tokens.  Without a token the model knows one tag, ``FU``."""
    own = rows.select(F.slice("low", 1, F.col("n")).alias("low"), F.slice("tags", 1, F.col("n")).alias("tags"))
    each = own.withColumn("before", F.concat(F.array(F.lit(START)), "tags")) \
              .select(F.explode(F.arrays_zip("low", "tags", "before")).alias("x")).filter("x.tags IS NOT NULL")
    word, tag = F.col("x.low"), F.col("x.tags")
    facts = F.array(F.struct(F.lit("word").alias("kind"), _bucket(word, WORD_BUCKETS).alias("key")),
                    F.struct(F.lit("ending").alias("kind"), _bucket(F.right(word, F.lit(ENDING)), ENDING_BUCKETS).alias("key")),
                    F.struct(F.lit("move").alias("kind"), F.col("x.before").alias("key")))
    got = (each.select(tag.alias("tag"), F.explode(facts).alias("f")).groupBy("f.kind", "f.key", "tag")
               .agg(F.count(F.lit(1)).alias("n")).collect())      # at most (buckets + tags) x tags rows
    tags = sorted({r.tag for r in got}) or ["FU"]
    at = {t: i for i, t in enumerate(tags)}
    words, endings = np.zeros((WORD_BUCKETS, len(tags))), np.zeros((ENDING_BUCKETS, len(tags)))
    moves = np.zeros((len(tags) + 1, len(tags)))
    for r in got:
        table = {"word": words, "ending": endings, "move": moves}[r.kind]
        row = int(r.key) if r.kind != "move" else len(tags) if r.key == START else at[r.key]
        table[row, at[r.tag]] += r.n
    prior = (words.sum(0) + 1) / (words.sum() + len(tags))
    steps = (moves + K * prior) / (moves.sum(1, keepdims=True) + K)
    return TagModel(tags, words.astype(np.float32), endings.astype(np.float32), prior, np.log(steps))


def trained_tagger(model: TagModel) -> Tagger:
    """The hook: adds ``tags`` to document rows.  A null array stays null, an
    empty one empty; a segment is tagged with the tokens ahead of it."""

    def tag(rows: DataFrame) -> DataFrame:
        rows = rows.drop("tags")
        place = rows.columns.index("low")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, TEXTS):     # some documents at a time, so a batch's words are never all Python objects
                    some = b.slice(i, TEXTS)
                    yield pa.RecordBatch.from_arrays([*some.columns, model.tag_all(some.column(place))], [*some.schema.names, "tags"])
        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("tags", T.ArrayType(T.StringType()))]))
    return tag


def tag_agreement(rows: DataFrame, fold: Column) -> DataFrame:
    """(pos_tag, trained_tag, n): the given tags of document rows against those of
    a model that was trained on the other fold (0 or 1) of the documents."""
    rows = materialize(rows.select(fold.alias("fold"), "n", "low", "tags"), "tagged-rows")     # tokenized and tagged once, not per model and fold
    fold, parts = F.col("fold"), []
    for k in (0, 1):
        model = train_tagger(rows.filter(fold != k))
        part = rows.filter(fold == k).withColumnRenamed("tags", "given")
        both = trained_tagger(model)(part.select("n", "low", "given"))
        parts.append(both.select(F.explode(F.slice(F.arrays_zip("given", "tags"), 1, F.col("n"))).alias("x")))
    return (parts[0].unionByName(parts[1]).groupBy(F.col("x.given").alias("pos_tag"), F.col("x.tags").alias("trained_tag"))
                    .agg(F.count(F.lit(1)).alias("n")))
