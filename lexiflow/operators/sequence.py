"""Skew-safe sequence primitives over ordered rows inside a document.

A window ``partitionBy(doc_id)`` puts a whole document into one task; one
document may hold a large share of a corpus, so every ordered operation here
works on fixed-size *blocks* of positions instead:

* ``prefix_sum``: running sums = running sum inside ``(doc, block)`` plus the
  total of earlier blocks (a tiny per-block table).
* ``with_context``: each row is owned by one block and copied, as read-only
  context, into the neighbouring block when it lies within ``before`` /
  ``after`` rows of the boundary, so frames of bounded reach can be evaluated
  per ``(doc, block)``.
* ``dense_rank_in_doc``: 0-based ordinal of the rows kept by a filter.

Blocks are ``BLOCK`` positions wide; documents shorter than that form one
block, so for ordinary corpora nothing is copied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _blk(order: str, block: int) -> Column:
    return F.expr(f"`{order}` div {int(block)}")


def prefix_sum(df: DataFrame, part: Sequence[str], order: str, value: Column, out: str,
               inclusive: bool = True, block: int | None = None) -> DataFrame:
    block = block or BLOCK
    part = list(part)
    d = df.withColumn("_pblk", _blk(order, block)).withColumn("_pv", value)
    w = Window.partitionBy(*part, "_pblk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_pin", F.sum("_pv").over(w))
    totals = d.groupBy(*part, "_pblk").agg(F.sum("_pv").alias("_pbt"))
    wb = Window.partitionBy(*part).orderBy("_pblk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, "_pblk", F.coalesce(F.sum("_pbt").over(wb), F.lit(0)).alias("_poff"))
    res = d.join(offsets, on=[*part, "_pblk"], how="inner")
    val = F.col("_poff") + F.col("_pin")
    if not inclusive:
        val = val - F.col("_pv")
    return res.withColumn(out, val).drop("_pblk", "_pv", "_pin", "_poff")


def dense_rank_in_doc(df: DataFrame, part: Sequence[str], order: str, out: str, block: int | None = None) -> DataFrame:
    """0-based ordinal of each row inside ``part`` by ``order`` (unique)."""
    return prefix_sum(df, part, order, F.lit(1).cast("long"), out, inclusive=False, block=block)


def with_context(df: DataFrame, order: str, before: int, after: int, block: int | None = None) -> DataFrame:
    """Add ``_blk`` and ``_own``; ``order`` must be dense (0..n-1 per document).

    Evaluate windows over ``partitionBy(<doc>, "_blk").orderBy(order)`` and keep
    ``_own`` rows: every owned row then sees ``before`` preceding and ``after``
    following rows of its document.
    """
    block = block or BLOCK
    if before >= block or after >= block:
        raise ValueError("context reach must be smaller than the block size")
    o = F.col(order)
    b = _blk(order, block)
    off = o - b * F.lit(block)
    entries = [F.struct(b.alias("b"), F.lit(True).alias("own"))]
    if after > 0:   # first rows of a block are following context of the block before
        entries.append(F.when((off < after) & (b > 0), F.struct((b - 1).alias("b"), F.lit(False).alias("own"))))
    if before > 0:  # last rows of a block are preceding context of the next block
        entries.append(F.when(off >= block - before, F.struct((b + 1).alias("b"), F.lit(False).alias("own"))))
    arr = F.array_compact(F.array(*entries)) if len(entries) > 1 else F.array(*entries)
    return (df.withColumn("_ctx", F.explode(arr))
              .withColumn("_blk", F.col("_ctx.b"))
              .withColumn("_own", F.col("_ctx.own"))
              .drop("_ctx"))
