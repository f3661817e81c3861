"""N-gram Jaccard join: documents whose shingle sets agree to a share or more.

Documents with the same set are one *class* from the start, so copies are never
compared.  Of each class only the *head* of its set takes part in the search:
shingles in a fixed order, rare ones first, as many that two sets with the
required overlap must share one of them.  (Any order is right; how rare a
shingle is comes from a table of hashed counts over all documents, a fixed
number of them.)

0. Sizes fall into bands that a link spans at most two of.  A shingle of a head
   counts only where another class has it in the same or a neighbouring band.
1. Groups: for each shingle of a head and band, the classes that have it are
   compared with the smallest of them.  What links is one group, and groups that
   share a class are one.
2. Token-group matrix: for each shingle and group, the smallest and largest set
   and the longest rest after the shingle.  A class and a group that share a
   shingle are compared only if these allow the required overlap.
3. Open groups: the members with that shingle whose own sizes and rests allow it.

Every link comes from whole sets.  A class is never compared with its own
group again, so many near copies cost one comparison each instead of all pairs.
Before whole sets move, counts of shingles per hash class, a byte for one or two
shingles, rule out pairs that cannot have the overlap.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .components import components
from .scratch import Scratch
from .words import mix, runs, shingle_set, word_hashes
from .workers import lean, small_batches

#: Hashed counts that order the shingles.
CELLS = 1 << 20
#: Ids of at most this number are broadcast; beyond it Spark joins by a shuffle.
BROADCAST_IDS = 1_000_000
_CELL_SHIFT = np.uint64(64 - 20)


def _sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    for _, run in runs(texts):
        h, at, _, _ = word_hashes(run, lower=True)
        for i in range(len(run)):
            yield shingle_set(h[at[i]:at[i + 1]], width)


def _cells(s: np.ndarray) -> np.ndarray:
    return (s.view(np.uint64) >> _CELL_SHIFT).astype(np.int64)


def _count_cells(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    total = np.zeros(CELLS, np.int64)
    for b in batches:
        held, size = [], 0
        for s in _sets(list(b["text"]), width):
            held.append(s)
            size += len(s)
            if size > 1 << 20:
                total += np.bincount(_cells(np.concatenate(held)), minlength=CELLS)
                held, size = [], 0
        if held:
            total += np.bincount(_cells(np.concatenate(held)), minlength=CELLS)
    parts = 64      # rows of 128 kB
    yield pd.DataFrame({"part": np.arange(parts), "n": [x.astype("<i4").tobytes() for x in total.reshape(parts, -1)]})


def _add_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for p, n in zip(b["part"], b["n"], strict=True):
            x = np.frombuffer(n, "<i4").astype(np.int64)
            total[p] = total[p] + x if p in total else x
    if total:
        yield pd.DataFrame({"part": list(total), "n": [np.minimum(x, 2 ** 31 - 1).astype("<i4").tobytes() for x in total.values()]})


def shingle_counts(texts: DataFrame, width: int) -> np.ndarray:
    """Level (logarithm) of the hashed count of shingles, CELLS bytes.  Each
    task counts into its own table; tables are added in rounds, so that neither
    a task nor the driver gets more than a few dozen of them."""
    with Scratch() as scratch:
        t = scratch.write(texts.mapInPandas(lean(lambda b: _count_cells(b, width)), "part int, n binary"), "shingle-counts")
        rows = t.count()
        while rows > 16 * 64:
            t = scratch.write(t.repartition(rows // (64 * 4)).mapInPandas(lean(_add_cells), t.schema), "shingle-counts")
            rows = t.count()
        total = np.zeros((64, CELLS // 64), np.int64)
        for r in t.toLocalIterator():
            total[r["part"]] += np.frombuffer(bytes(r["n"]), "<i4")
    return np.log2(total.ravel() + 1.0).astype(np.uint8)


def _needed(n: np.ndarray | int, share: int):
    """Least overlap of a set of ``n`` with any set that agrees to ``share`` %."""
    return -(-share * n // 100)


def _spread(s: np.ndarray) -> bytes:
    """Counts of the shingles by the leading bits of their mixed hashes, one or two a class."""
    order, bits = mix(s.view(np.uint64)), max(1, len(s).bit_length() - 1)
    while True:
        counts = np.bincount((order >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.max() < 256:
            return counts.astype(np.uint8).tobytes()
        bits += 1


def _most_common(x: bytes, y: bytes) -> tuple[int, int]:
    """At most so many hashes are in both sets, and the sum of their sizes: no
    class holds more common ones than its smaller count."""
    x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    k = min(len(x), len(y))
    x, y = x.reshape(k, -1).sum(axis=1), y.reshape(k, -1).sum(axis=1)
    return int(np.minimum(x, y).sum()), int(x.sum() + y.sum())


def _heads(batches: Iterator[pd.DataFrame], levels, width: int, share: int) -> Iterator[pd.DataFrame]:
    level = levels.value
    for b in batches:
        out = []
        for s in _sets(list(b["text"]), width):
            n = len(s)
            u = s.view(np.uint64)
            order = mix(u)
            h = np.lexsort((order, level[_cells(s)]))[:n - _needed(n, share) + 1] if n else []
            out.append((n, int(u.sum(dtype=np.uint64).astype(np.int64)), int(order.sum(dtype=np.uint64).astype(np.int64)), s[h]))
        yield pd.DataFrame({"doc_id": b["doc_id"], "n": [x[0] for x in out], "s1": [x[1] for x in out],
                            "s2": [x[2] for x in out], "head": [x[3] for x in out]})


def _bounded(batches: Iterator[pd.DataFrame], share: int) -> Iterator[pd.DataFrame]:
    """Pairs whose counts allow the overlap."""
    for b in batches:
        keep = []
        for x, y in zip(b["pa"], b["pb"], strict=True):
            both, sizes = _most_common(x, y)
            keep.append(100 * both >= share * (sizes - both))
        yield b.loc[keep, ["a", "b"]]


def _of_sets(batches: Iterator[pd.DataFrame], width: int, value: Callable[[np.ndarray], bytes]) -> Iterator[pd.DataFrame]:
    """Sets of a run of texts at a time, which bounds what a worker holds."""
    for b in batches:
        for first, run in runs(list(b["text"])):
            h, at, _, _ = word_hashes(run, lower=True)
            yield pd.DataFrame({"id": b["id"].iloc[first:first + len(run)],
                                "s": [value(shingle_set(h[at[i]:at[i + 1]], width)) for i in range(len(run))]})


def _compare(batches: Iterator[pd.DataFrame], share: int) -> Iterator[pd.DataFrame]:
    """Linked pairs from rows (a, b, second, s) in that order: the set of a, then that of b."""
    pair, first = None, None
    for batch in batches:
        out = []
        for a, b, second, s in zip(batch["a"], batch["b"], batch["second"], batch["s"], strict=True):
            s = np.frombuffer(s, np.int64)
            if not second:
                pair, first = (a, b), s
                continue
            assert pair == (a, b)
            both = len(np.intersect1d(first, s, assume_unique=True))
            if 100 * both >= share * (len(first) + len(s) - both):
                out.append(pair)
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _band(n: Column, share: int) -> Column:
    """Bands of sizes; sizes that may link are in the same or in neighbouring
    bands (a little wider than that takes, so rounding cannot matter)."""
    return F.floor(F.log(n) / max(math.log(100 / share) * 1.0001, 1e-3)).cast("int")


def _bit(band: Column) -> Column:
    """One of 64 bits for a band.  Bands 64 apart share one, which only keeps more."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(band, F.lit(64)).cast("int"))


def _may_reach(n: Column, rest: Column, m: Column, other_rest: Column, share: int) -> Column:
    """Whether sets of n and m that first share a shingle with so many left in
    each (that one counted) can have the overlap they need."""
    need = F.ceil((n + m) * share / F.lit(100.0 + share) - 1e-6)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * share) & (F.least(rest, other_rest) >= need)


def _small(ids: DataFrame) -> DataFrame:
    """Broadcast while there are few, so that texts need not be shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _linked(pairs: DataFrame, texts: DataFrame, repeated: bool, width: int, share: int) -> DataFrame:
    """The pairs (a, b) whose whole sets agree to ``share`` %.  Pairs that their
    counts rule out go first; sets are made from the texts of the documents in a
    remaining pair only, and move once, to the pair."""
    def ids_of(p: DataFrame) -> DataFrame:
        return p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id"))).distinct()

    def of_texts(ids: DataFrame, value: Callable[[np.ndarray], bytes]) -> DataFrame:
        wanted = texts.join(_small(ids), texts["doc_id"] == F.col("id")).select("id", "text")
        made = wanted.mapInPandas(lean(lambda b: _of_sets(b, width, value)), "id long, s binary")
        return made.dropDuplicates(["id"]) if repeated else made

    with Scratch() as scratch:
        ids = scratch.write(ids_of(pairs), "pair-ids")
        spread = scratch.write(of_texts(ids, _spread), "pair-spreads")
        likely = scratch.write(
            pairs.select("a", "b").join(spread.toDF("a", "pa"), "a").join(spread.toDF("b", "pb"), "b")
                 .mapInPandas(lean(lambda x: _bounded(x, share)), "a long, b long"), "bounded-pairs")
        ids = scratch.write(ids_of(likely), "pair-ids")
        sides = scratch.write(likely.select("a", "b", F.lit(False).alias("second"), F.col("a").alias("id")).unionByName(
            likely.select("a", "b", F.lit(True).alias("second"), F.col("b").alias("id"))), "pair-sides")
        sets = of_texts(ids, np.ndarray.tobytes)
        return materialize(
            sets.join(_small(sides), "id").select("a", "b", "second", "s").repartition("a", "b")
                .sortWithinPartitions("a", "b", "second").mapInPandas(lean(lambda x: _compare(x, share)), "a long, b long"), "links")


def _search(texts: DataFrame, heads: DataFrame, scratch: Scratch, share: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The classes, and links between them that join what belongs together."""
    known = heads.filter("n > 0 AND doc_id IS NOT NULL")
    repeated = not known.groupBy("doc_id").count().filter("count > 1").isEmpty()
    classes = known.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("class_id"))
    firsts = materialize(classes, "shingle-classes")

    # copies stay out of the search; a repeated id repeats its cells, which changes no result
    copies = scratch.write(known.select("doc_id").join(
        firsts.select(F.col("class_id").alias("doc_id")), "doc_id", "left_anti").distinct(), "shingle-copies")
    every = (known.select("doc_id", "n", "head").join(_small(copies), "doc_id", "left_anti")
                  .select(F.col("doc_id").alias("id"), "n", F.posexplode("head").alias("i", "t"))
                  .select("t", "id", "n", (F.col("n") - F.col("i")).alias("rest")))
    # of each shingle the bands that have it, and those that have it an odd number of times
    band = _band(F.col("n"), share)
    shared = (every.groupBy("t").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("times"),
                                     F.bit_or(_bit(band)).alias("bands"), F.bit_xor(_bit(band)).alias("odd"))
                   .filter("first <> last").drop("first", "last"))
    # as many as if each odd band had it once and each other band twice: then it is alone in the odd ones
    alone = ((F.col("times") == 2 * F.bit_count("bands") - F.bit_count("odd"))
             & (F.col("odd").bitwiseAND(_bit(band)) != 0))
    beside = F.col("bands").bitwiseAND(_bit(band - 1).bitwiseOR(_bit(band + 1))) != 0
    cells = scratch.write(every.join(shared, "t").filter(beside | ~alone).select("t", band.alias("band"), "id", "n", "rest"), "shared-cells")

    heads_of = cells.groupBy("t", "band").agg(F.min(F.struct("id", "n", "rest")).alias("f")).select(
        "t", "band", F.col("f.id").alias("first"), F.col("f.n").alias("fn"), F.col("f.rest").alias("frest"))
    tried = scratch.write(
        cells.join(heads_of, ["t", "band"]).filter("id <> first")
             .filter(_may_reach(F.col("n"), F.col("rest"), F.col("fn"), F.col("frest"), share))
             .select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "first-pairs")
    links = _linked(tried, texts, repeated, width, share)
    groups = components(links)

    cells = scratch.write(cells.select("t", "id", "n", "rest").join(_small(groups), "id", "left")
                             .withColumn("g", F.coalesce("component", "id")).drop("component"), "group-cells")
    scratch.drop("shared-cells")
    several = cells.groupBy("t").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 <> g1").select("t")
    cells = scratch.write(cells.join(several, "t", "left_semi"), "open-cells")
    scratch.drop("group-cells")
    matrix = cells.groupBy("t", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("longest"))
    # the smallest size in the group that n can agree with bounds the overlap that any member needs
    m = F.greatest(F.col("least"), F.ceil(F.col("n") * share / 100.0 - 1e-6))
    queries = (cells.alias("q").join(matrix.alias("m"), (F.col("q.t") == F.col("m.t")) & (F.col("q.g") < F.col("m.g")))
                    .filter((F.col("most") * 100 >= F.col("n") * share) & (F.col("least") * share <= F.col("n") * 100)
                            & (F.least("rest", "longest") >= F.ceil(
                                (F.col("n") + m) * share / F.lit(100.0 + share) - 1e-6)))
                    .select("q.t", "q.id", "q.n", "q.rest", F.col("m.g").alias("g")))
    members = cells.select("t", "g", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("rest").alias("brest"))
    opened = (queries.join(members, ["t", "g"])
                     .filter(_may_reach(F.col("n"), F.col("rest"), F.col("bn"), F.col("brest"), share))
                     .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
                     .join(tried, ["a", "b"], "left_anti"))
    opened = scratch.write(opened, "open-pairs")
    scratch.drop("open-cells")
    return firsts, links.unionByName(_linked(opened, texts, repeated, width, share))


def jaccard_join(docs: DataFrame, share: int = 85, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, a row per row of ``docs``.

    Texts are lower-cased (A-Z); a set holds the distinct ``width``-word
    shingles, or the whole sequence of a shorter text; ``share`` is the least
    Jaccard share in percent.  class_id is the smallest doc_id with the same
    set, component_id the smallest reachable by links.  Null, empty and
    wordless texts have an empty set and link with nothing.  Rows with one id
    must have one text.  A row with a null id links with nothing and has null
    class and component.  Other columns are left out; empty tables give empty
    results."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    with small_batches(spark), Scratch() as scratch:
        levels = spark.sparkContext.broadcast(shingle_counts(texts.select("text"), width))
        heads = scratch.write(texts.mapInPandas(lean(lambda b: _heads(b, levels, width, share)),
                                                "doc_id long, n long, s1 long, s2 long, head array<long>"), "shingle-heads")
        sizes = materialize(heads.select("doc_id", "n", "s1", "s2"), "shingle-sizes")
        firsts, links = _search(texts, heads, scratch, share, width)
    joined = components(links)
    named = firsts.join(joined.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.col("n").alias("k"), "class_id",
        F.coalesce("component", "class_id").alias("component_id"))
    return (sizes.join(named, (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2")) & (F.col("n") == F.col("k"))
                       & F.col("doc_id").isNotNull(), "left")
                 .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"),
                         F.coalesce("component_id", "doc_id").alias("component_id")))
