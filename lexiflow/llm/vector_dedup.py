"""Embedding near-duplicates by quantised tile products.

Equal vectors are one representative with a count.  Representatives are cut
into blocks; a block holds for each vector its direction as 8-bit integers, the
scale, the exact length of the quantisation error, and the original.  For a
tile (two blocks) the integer products are exact (float32 multiplies integers
below 2**24 without rounding; wider vectors are summed in slices).  For
directions u, v with codes' vectors û, v̂ and errors e, f:

    |u·v - û·v̂| = |û·f + e·v| <= (1 + |e|) |f| + |e|

so a product that far above the threshold is a link, one that far below is
none, and only what lies between is computed again in double precision.

Links are not emitted: a tile gives, for each vector with links in it, their
number and the smallest id of its component within the tile, which keeps
connectivity.  Components are then joined over all tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .components import components
from .vectors import stacked, usable

#: Vectors of a block; blocks on each side of a task's tiles; sides that a small input is cut into at least.
BLOCK, SIDE, LEAST_SIDES = 2048, 32, 8
#: Components whose products cannot leave the exact integers of float32.
_EXACT = (1 << 24) // (127 * 127)
_ROUNDING = 1e-6

_BLOCKS = "block long, dim int, ids binary, copies binary, codes binary, scale binary, error binary, original binary"


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and error lengths of the rows' directions."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(u).max(1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(u - codes * scale[:, None], axis=1)


def _normed(x: np.ndarray) -> np.ndarray:
    """Divided by the largest component, so that no square overflows or vanishes."""
    return x / np.abs(x).max(1, keepdims=True)


def _block_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    made = TaskContext.get().partitionId() << 32
    for b in batches:
        for dim, same in b.groupby(b["vector"].map(len)):
            for at in range(0, len(same), BLOCK):
                part = same.iloc[at:at + BLOCK]
                x = stacked(part["vector"].to_numpy())
                codes, scale, error = _quantise(_normed(x))
                yield pd.DataFrame([{
                    "block": made, "dim": dim, "ids": part["id"].to_numpy(np.int64).tobytes(),
                    "copies": part["copies"].to_numpy(np.int64).tobytes(), "codes": codes.tobytes(),
                    "scale": scale.tobytes(), "error": error.tobytes(), "original": x.tobytes()}])
                made += 1


class _Block:
    def __init__(self, r):
        self.key, d = r.block, r.dim
        self.ids, self.copies = np.frombuffer(r.ids, np.int64), np.frombuffer(r.copies, np.int64)
        self.codes = np.frombuffer(r.codes, np.int8).reshape(-1, d)
        self.scale, self.error = np.frombuffer(r.scale), np.frombuffer(r.error)
        self.x = np.frombuffer(r.original).reshape(-1, d)


def _products(a: _Block, b: _Block) -> np.ndarray:
    out = None
    for k in range(0, a.codes.shape[1], _EXACT):
        p = a.codes[:, k:k + _EXACT].astype(np.float32) @ b.codes[:, k:k + _EXACT].astype(np.float32).T
        out = p if out is None else out.astype(np.float64) + p
    return out * (a.scale[:, None] * b.scale[None]).astype(out.dtype)


def _links(a: _Block, b: _Block, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose cosine is at least ``least``, each pair once."""
    p = _products(a, b)
    most = (1 + a.error.max()) * b.error.max() + a.error.max() + _ROUNDING
    i, j = np.nonzero(p >= least - most)
    if a.key == b.key:
        i, j = i[i < j], j[i < j]
    bound = (1 + a.error[i]) * b.error[j] + a.error[i] + _ROUNDING
    value = p[i, j]
    link = value - bound >= least
    for at in range(0, len(i), 1 << 16):
        k = at + np.flatnonzero(np.abs(value[at:at + (1 << 16)] - least) <= bound[at:at + (1 << 16)])
        x, y = _normed(a.x[i[k]]), _normed(b.x[j[k]])
        link[k] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= least
    return i[link], j[link]


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, over links (i, j) of n nodes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _tile(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    # a side met with itself sends its rows once; another tile gets both sides
    left = [_Block(r) for r in rows.itertuples() if r.left]
    same = bool((rows["side"] == rows["other"]).any())
    right = left if same else [_Block(r) for r in rows.itertuples() if not r.left]
    out = []
    for a in left:
        for b in right:
            if a.x.shape[1] != b.x.shape[1] or (same and a.key > b.key):
                continue
            i, j = _links(a, b, least)
            if not len(i):
                continue
            ids = np.unique(np.concatenate([a.ids[i], b.ids[j]]))
            u, v = np.searchsorted(ids, a.ids[i]), np.searchsorted(ids, b.ids[j])
            n = np.bincount(u, b.copies[j], len(ids)) + np.bincount(v, a.copies[i], len(ids))
            out.append(pd.DataFrame({"id": ids, "n": n.astype(np.int64), "to": ids[_smallest(len(ids), u, v)]}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "n": [], "to": []}, dtype=np.int64)


def near_duplicates(table: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, a row per row of ``table``.

    n_links counts the other rows with a cosine of at least ``least`` (equal
    vectors included), component_id is the smallest id reachable, kept says
    that it is the row's own.  Vectors that are null, zero or hold null or
    non-finite components link with nothing, and so do vectors of different
    lengths with each other.  Rows with a null id link with nothing, have a
    null component and are not kept; rows that share an id are separate rows
    in the counts.  Other columns are left out; empty tables give empty results."""
    t = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    good = t.filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    reps = materialize(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "vector-reps")
    rows = reps.count()
    n_blocks = max(1, math.ceil(rows / BLOCK))
    blocks = materialize(
        reps.select("id", "copies", F.col("v").alias("vector")).repartition(n_blocks, F.xxhash64("id"))
            .mapInPandas(_block_rows, _BLOCKS), "vector-blocks")
    sides = max(min(LEAST_SIDES, n_blocks), math.ceil(n_blocks / SIDE))
    side = F.pmod(F.xxhash64("block"), F.lit(sides)).cast("int")
    # each side meets itself and the others: its rows go to one tile per side
    sent = (blocks.withColumn("side", side).select("*", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("other"))
                  .withColumn("tile", F.least("side", "other").cast("long") * sides + F.greatest("side", "other"))
                  .withColumn("left", F.col("side") <= F.col("other")))
    found = materialize(sent.groupBy("tile").applyInPandas(
        lambda rows: _tile(rows, least), "id long, n long, to long"), "vector-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    per_rep = materialize(reps.join(counts, "id", "left").join(groups, "id", "left").select(
        "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id")), "vector-result")
    usable_rows = good.join(per_rep, "v").select("vec_id", "n_links", "component_id")
    others = t.filter(~usable(F.col("v")) | F.col("vec_id").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable_rows.unionByName(others).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
