"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mix, runs, shingle_set, word_hashes
from .workers import lean

#: Labelled rows of each class used to fit a classifier (parameter of the callers).
ROWS_PER_CLASS = 20_000


def in_fit_fold(id_col: str = "doc_id") -> Column:
    """True for ids whose CRC-32 (of the id as text) modulo 5 is not 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def _minima(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    salts = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for b in batches:
        out = np.zeros((len(b), 4), np.int64)
        for first, run in runs(list(b["text"])):
            h, at, _, _ = word_hashes(run, lower=True)
            for i in range(len(run)):
                s = shingle_set(h[at[i]:at[i + 1]], 4).view(np.uint64)
                if len(s):
                    out[first + i] = [mix(s ^ x).min().astype(np.int64) for x in salts]
        yield pd.DataFrame({"_row": b["_row"], **{f"m{k}": out[:, k] for k in range(4)}})


def without_copies(sample: DataFrame) -> DataFrame:
    """One document of each group of near copies in a bounded sample with
    ``_row`` and ``text``: no two that are kept share a minimum of one of four
    hashes of their word shingles."""
    ids = sample.select("_row", "text").mapInPandas(lean(_minima), "_row long, m0 long, m1 long, m2 long, m3 long")
    for k in range(4):
        ids = ids.groupBy(f"m{k}").agg(F.min(F.struct("_row", "m0", "m1", "m2", "m3")).alias("x")).select("x.*")
    return sample.join(F.broadcast(ids.select("_row")), "_row")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS_PER_CLASS,
                    id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """The documents of at most ``rows`` labelled ids of each class outside the
    held-out fold, chosen by hash, with columns ``y`` and ``_row`` (the id); and the size of each
    class among all such labels.  An id with several labels counts as 1 if any
    is.  The ids are at most ``2 * rows`` numbers, so they are broadcast and
    the texts are not shuffled."""
    y = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & in_fit_fold("doc_id"))
    y = y.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for c in (0, 1):
        part = y.filter(F.col("y") == c).orderBy(F.xxhash64("_id"), "_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.join(F.broadcast(chosen), docs[id_col] == F.col("_id")).withColumnRenamed("_id", "_row"), sizes
