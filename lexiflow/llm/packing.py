"""Packing: documents as token ids into sequences of a fixed length.

Each partition keeps at most ``open_windows`` unfinished sequences.  A piece
goes to the open one that it fills best; when none has room for it, the fullest
leaves: with its gap as padding if that is at most ``max_gap``, else filled up
with the head of the piece (documents may be cut anywhere).  A document longer
than a sequence gives full sequences first.  What is still open at the end of
a partition is merged in rounds: the leftovers of many partitions are the items
of the same procedure, until one partition is left, so no round takes more than
``FAN_IN * open_windows`` sequences into a task.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .bpe import ByteBpe
from .workers import lean, small_batches

LENGTH = 2048
END_ID = 1
OPEN_WINDOWS = 64
MAX_GAP = 16
#: Partitions whose leftovers meet in one task.
FAN_IN = 64
_PART = 1 << 32

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
         "sequence_id long, offset long, open boolean")


class Windows:
    """Open sequences, sorted by their fill; items are (length, payload)."""

    def __init__(self, length: int, most: int, max_gap: int):
        self.length, self.most, self.max_gap = length, most, max_gap
        self.held: list[tuple[int, int]] = []        # (fill, number), ascending
        self.content: dict[int, list] = {}
        self.made = 0

    def _new(self, fill: int, payload: list) -> None:
        bisect.insort(self.held, (fill, self.made))
        self.content[self.made] = payload
        self.made += 1

    def best(self, n: int) -> int:
        """Index of the fullest window with room for ``n``, or -1."""
        return bisect.bisect_right(self.held, (self.length - n, self.made)) - 1

    def put(self, n: int, payload: list) -> list | None:
        """Place a whole item; the window that it completes, or the one that has
        to leave for it, comes back."""
        i = self.best(n)
        if i < 0:
            gone = self.content.pop(self.held.pop()[1]) if len(self.held) >= self.most else None
            self._new(n, payload)
            return gone
        fill, k = self.held.pop(i)
        self.content[k].extend(payload)
        if fill + n == self.length:
            return self.content.pop(k)
        bisect.insort(self.held, (fill + n, k))
        return None

    def gap(self, n: int) -> int:
        """Room that the head of an item of ``n`` should fill first (0: none)."""
        if self.best(n) >= 0 or len(self.held) < self.most:
            return 0
        gap = self.length - self.held[-1][0]
        return gap if gap > self.max_gap else 0

    def rest(self) -> Iterator[list]:
        yield from self.content.values()


def _pieces(batches: Iterator[pd.DataFrame], vocabulary: str, length: int, most: int, max_gap: int):
    bpe = ByteBpe(vocabulary)
    part = TaskContext.get().partitionId()
    w = Windows(length, most, max_gap)
    closed = 0
    out: list[tuple] = []

    def close(pieces: list, is_open: bool = False) -> None:
        nonlocal closed
        at = 0
        for p in pieces:
            out.append((*p, part * _PART + closed, at, is_open))
            at += p[2]
        closed += 1

    for batch in batches:
        for doc_id, ids in zip(batch["doc_id"], bpe.encode(batch["text"]), strict=True):
            ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
            total, at = len(ids), 0

            def piece(n: int) -> tuple:
                return (doc_id, at, n, zlib.crc32(ids[at:at + n].tobytes()), total)  # noqa: B023 - used at once

            while at < total:
                n = min(length, total - at)
                if n == length:
                    close([piece(n)])
                    at += n
                    continue
                n = w.gap(n) or n
                full = w.put(n, [piece(n)])
                if full:
                    close(full)
                at += n
        yield _frame(out)
        out = []
    for pieces in w.rest():
        close(pieces, True)
    yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open"]
    f = pd.DataFrame(rows, columns=names)
    f["doc_id"] = f["doc_id"].astype("Int64")
    return f.astype({n: "int64" for n in names[1:-1]} | {"open": bool})


LEFTOVER = "pieces array<struct<doc_id:long,start:long,length:long,ids_crc32:long,doc_tokens:long>>, fill long, part int"
MERGED = ("pieces array<struct<doc_id:long,start:long,length:long,ids_crc32:long,doc_tokens:long>>, "
          "fill long, part int, sequence_id long, open boolean")


def _merge(batches: Iterator[pd.DataFrame], length: int, most: int, first: int, last: bool):
    """Whole windows as items; ids from ``first`` on belong to this round."""
    part = TaskContext.get().partitionId()
    w = Windows(length, most, length)
    made = 0

    def row(pieces: list, is_open: bool) -> dict:
        nonlocal made
        made += 1
        return {"pieces": pieces, "fill": sum(p["length"] for p in pieces), "part": part,
                "sequence_id": first + part * _PART + made, "open": is_open}

    names = ["pieces", "fill", "part", "sequence_id", "open"]
    for batch in batches:
        rows = []
        for n, pieces in zip(batch["fill"], batch["pieces"], strict=True):
            full = w.put(int(n), list(pieces))
            if full:
                rows.append(row(full, False))
        if rows:
            yield pd.DataFrame(rows, columns=names)
    rows = [row(p, not last) for p in w.rest()]
    if rows:
        yield pd.DataFrame(rows, columns=names)


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, open_windows: int = OPEN_WINDOWS,
         max_gap: int = MAX_GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row
    per piece.  A null text counts as empty, and an empty document is the end
    id alone.  Repeated rows and ids are packed each on its own; null ids stay
    null.  Other columns are left out; an empty table gives an empty result.

    ``vocabulary`` is a byte-level BPE file that every executor can read."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        first = materialize(slim.mapInPandas(
            lean(lambda b: _pieces(b, vocabulary, length, open_windows, max_gap), keeps=True), PIECE), "pack-pieces")
    done = first.filter(~F.col("open")).drop("open")

    piece = F.struct("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    # one row per open window: at most ``open_windows`` per partition, each of at most ``length`` pieces
    left = (first.filter("open").groupBy("sequence_id")
                 .agg(F.array_sort(F.collect_list(F.struct("offset", piece.alias("p")))).alias("x"),
                      F.sum("length").alias("fill"))
                 .select(F.col("x.p").alias("pieces"), "fill", F.shiftright("sequence_id", 32).cast("int").alias("part")))
    parts = (first.filter("open").agg(F.max(F.shiftright("sequence_id", 32))).first()[0] or 0) + 1
    numbered = 1 << 62
    results = [done]
    while True:
        tasks = math.ceil(parts / FAN_IN)
        merged = materialize(
            left.repartitionByRange(tasks, F.floor(F.col("part") / FAN_IN)).mapInPandas(
                lean(lambda b, f=numbered, last=tasks == 1: _merge(b, length, open_windows, f, last)), MERGED), "pack-merged")
        finished = merged.filter(~F.col("open"))
        results.append(finished.select("sequence_id", F.posexplode("pieces").alias("_i", "p"), F.expr(
            "aggregate(slice(pieces, 1, _i), 0L, (a, x) -> a + x.length)").alias("offset"))
            .select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "offset"))
        if tasks == 1:
            break
        left, parts, numbered = merged.filter("open").select("pieces", "fill", "part"), tasks, numbered + (1 << 58)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
