"""Sharding: contiguous shards of groups that stay whole, least largest shard.

Documents with equal texts form a group, which no shard boundary may split.
Groups stand in the order of a SHA-256 of their text.  The smallest capacity
for which a greedy walk over that order needs at most ``n_shards`` shards is
found by binary search.  The walk shows where cuts may lie; the cuts are then
placed as near to even shares as that capacity allows, since the walk by itself
leaves all slack to the last shard.

The walk never sees single groups of a large corpus.  It runs over *blocks*:
sums of bytes by a prefix of the hash, one aggregate over a narrow table.  A
block counts once as if nothing in it could be cut (which can only need more
shards) and once as if it could be cut anywhere (which can only need fewer).
Where the two capacities differ, only the blocks that hold a possible cut are
split by one more hex digit; when they agree the capacity is exact.  The
driver holds a few thousand block sums at a time, whatever the corpus size.

A group larger than an even share gets a shard of its own (there are fewer
than ``n_shards`` such groups), the others share what is left.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Bytes that a document takes besides its text.
ROW_BYTES = 16
#: Hex digits of the first blocks: 4,096 sums.
FIRST_DIGITS = 3


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key): UTF-8 bytes plus ROW_BYTES, CRC-32 of
    the text, and the group's place in the order."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.sha2(F.coalesce(F.concat(F.lit("="), text), F.lit("null")), 256).alias("key"))


def _walk(blocks, capacity: int, whole: bool, shards: int) -> tuple[int, list[int]]:
    """Greedy walk: how many shards it takes (``shards`` + 1 if more), and the
    byte positions of the cuts.  ``whole``: no block may be cut; else those of
    several groups may be cut anywhere."""
    used, filled, at, cuts = 1, 0, 0, []
    for _, size, one in blocks:
        if filled + size <= capacity:
            filled += size
        elif whole or one:
            if size > capacity:
                return shards + 1, cuts
            cuts.append(at)
            used, filled = used + 1, size
        else:
            left, done = size, 0
            while filled + left > capacity:
                done += capacity - filled
                left -= capacity - filled
                cuts.append(at + done)
                used, filled = used + 1, 0
                if used > shards:
                    return used, cuts
            filled += left
        at += size
        if used > shards:
            return used, cuts
    return used, cuts


def _least(blocks, shards: int, whole: bool, low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        if _walk(blocks, mid, whole, shards)[0] <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def _sums(table: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
    rows = (table.groupBy(F.substring("key", 1, digits).alias("p"))
                 .agg(F.sum("size").alias("s"), (F.min("key") == F.max("key")).alias("one")).collect())
    return sorted((r["p"], r["s"], r["one"]) for r in rows)


def cut_keys(table: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Smallest capacity, and the key prefixes at which shards 1, 2, ... start."""
    digits = {}
    blocks = _sums(table, FIRST_DIGITS)
    digits = {p: FIRST_DIGITS for p, _, _ in blocks}
    total = sum(s for _, s, _ in blocks)
    while True:
        low = _least(blocks, shards, False, -(-total // shards), max(total, 1))
        high = _least(blocks, shards, True, low, max(total, 1))
        if low == high:
            break
        ranges = list(zip(_walk(blocks, low, True, 10 * shards)[1][:shards - 1],
                          _walk(blocks, high, False, 10 * shards)[1][:shards - 1], strict=False))
        first = _walk(blocks, low, True, 10 * shards)[1]
        if len(first) < shards - 1:      # the walk over whole blocks stopped early: a block exceeds the capacity
            ranges.append((first[-1] if first else 0, total))
        split, at = set(), 0
        for p, s, one in blocks:
            if not one and any(a < at + s and b >= at for a, b in ranges):
                split.add(p)
            at += s
        if not split:                    # nothing left to learn from the ranges: look into every block
            split = {p for p, _, one in blocks if not one}
        finer = []
        for d in sorted({digits[p] for p in split}):
            here = [p for p in split if digits[p] == d]
            finer += _sums(table.filter(F.substring("key", 1, d).isin(here)), d + 1)
        digits |= {p: len(p) for p, _, _ in finer}
        blocks = sorted([b for b in blocks if b[0] not in split] + finer)
    return low, [blocks[i][0] for i in _even_cuts(blocks, low, shards, total)]


def _even_cuts(blocks, capacity: int, shards: int, total: int) -> list[int]:
    """Among the cuts that keep the capacity, those nearest to even shares
    (the greedy walk alone would leave all the slack to the last shard).  A
    cut may lie no earlier than the walk from the end puts it, and no further
    than the capacity from the cut before."""
    ends = list(itertools.accumulate(s for _, s, _ in blocks))
    starts = [0, *ends[:-1]]
    earliest, edge, filled = [], total, 0
    for i in reversed(range(len(blocks))):
        if filled + blocks[i][1] > capacity:
            earliest.append(ends[i])
            filled = 0
        filled += blocks[i][1]
    earliest = [0] * (shards - 1 - len(earliest)) + earliest[::-1]
    cuts, before = [], 0
    for j in range(1, shards):
        low, high, ideal = max(earliest[j - 1], before), min(before + capacity, total), total * j // shards
        i = bisect.bisect_left(starts, low)
        if i == len(starts):
            break
        k = bisect.bisect_left(starts, ideal, lo=i)
        best = min((x for x in (i, k - 1, k) if i <= x < len(starts) and starts[x] <= high),
                   key=lambda x: abs(starts[x] - ideal), default=None)
        if best is None or abs(starts[best] - ideal) > abs(high - ideal):
            best = max(i, bisect.bisect_right(starts, min(high, ideal)) - 1)
        before = starts[best]
        cuts.append(best)
    return cuts


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to n_shards - 1), slot (gapless from
    0 in each shard).  Equal texts share a shard, and so do null texts, which
    weigh ROW_BYTES each; empty texts are another group.  Repeated rows and
    ids each get a slot; null ids are allowed.  Other columns are left out, so
    none can clash.  An empty table gives an empty result."""
    table = materialize(measured(docs, id_col, text_col), "shard-sizes")
    largest = (table.groupBy("key").agg(F.sum("size").alias("s"))
                    .orderBy(F.desc("s"), "key").limit(n_shards).collect())
    total, rows = table.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    alone: list[str] = []
    for g in largest:
        if n_shards - len(alone) < 2 or g["s"] * (n_shards - len(alone)) <= total:
            break
        alone.append(g["key"])
        total -= g["s"]
    rest = table.filter(~F.col("key").isin(alone)) if alone else table
    starts = cut_keys(rest, n_shards - len(alone))[1] if total else []

    number = F.lit(len(alone))
    for s in starts:
        number = number + (F.col("key") >= s).cast("int")
    for i, k in enumerate(alone):
        number = F.when(F.col("key") == k, i).otherwise(number)
    return with_slots(table.withColumn("shard", number.cast("int")), rows).drop("key")


def with_slots(table: DataFrame, rows: int) -> DataFrame:
    """Gapless numbers within each shard without a task per shard: rows are
    numbered within (bucket of the id, shard), and each bucket starts after
    the earlier buckets' counts."""
    buckets = min(1 << 16, max(1 << 12, rows >> 9))
    t = table.withColumn("_b", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int")).repartition("_b")
    starts = (t.groupBy("_b", "shard").agg(F.count(F.lit(1)).alias("_n"))
               .select("_b", "shard", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_at")))
    t = t.withColumn("_i", F.row_number().over(Window.partitionBy("_b", "shard").orderBy("doc_id", "key")))
    return (t.join(starts, ["_b", "shard"])
             .select("doc_id", "size", "text_crc32", "key", "shard", (F.col("_at") + F.col("_i") - 1).alias("slot")))
