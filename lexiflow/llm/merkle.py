"""Merkle manifest of a table: a hash for every row, a tree for every group of
rows, a tree over the groups, and for every row the proof that it belongs there.

Nested-struct rollup.  A row's rank in its group is written in digits of base
``FAN``.  Inside a block of ``FAN ** digits`` consecutive rows the lowest digit
is grouped away first, then the next: each step hashes up to ``FAN`` children
and nests them as structs, so a block ends as one row of bounded size that
holds its whole subtree.  One shuffle by (group, block) serves all steps.  The
hashes of the blocks are the leaves of the next tier, until one is left.  Then,
from the top down, a block's row is exploded digit by digit; the hashes to the
left and right of a child are at hand in its parent's struct, so the proofs
need no join.  What a tier says about the blocks below it meets their rows in a
grouped merge.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .scratch import Scratch

FAN = 8
#: Digits grouped away inside a block: 8 ** 4 = 4096 leaves, under a megabyte of hashes.
DIGITS = 4

_PATH = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def row_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _active(level: int) -> Column:
    """More than one node is left below this level (1 is the lowest) of a tier of ``n`` leaves."""
    return F.col("n") > F.lit(FAN ** (level - 1))


def roll_up(leaves: DataFrame, digits: int) -> DataFrame:
    """Leaves (g, n, i, leaf struct with its hash ``h``) to blocks
    (g, n, block, h, kids); ``kids`` nests ``digits`` levels."""
    digit = [F.pmod(F.floor(F.col("i") / F.lit(FAN ** d)).cast("long"), F.lit(FAN)).cast("int").alias(f"d{d}")
             for d in range(digits)]
    rows = leaves.select("g", "n", F.floor(F.col("i") / F.lit(FAN ** digits)).cast("long").alias("block"), *digit, "leaf")
    rows = rows.repartition("g", "block").withColumn("node", F.struct(F.col("d0").alias("at"), F.col("leaf.*")))
    for level in range(1, digits + 1):
        above = [f"d{d}" for d in range(level, digits)]
        rows = rows.groupBy("g", "n", "block", *above).agg(F.sort_array(F.collect_list("node")).alias("kids"))
        hashes = F.transform("kids", lambda k: k["h"])
        rows = rows.withColumn("h", F.when(_active(level), F.sha2(F.array_join(hashes, ""), 256)).otherwise(hashes[0]))
        if above:
            rows = rows.withColumn("node", F.struct(F.col(above[0]).alias("at"), "h", "kids"))
    return rows.select("g", "n", "block", "h", "kids")


def unroll(blocks: DataFrame, digits: int, handed: Sequence[str]) -> DataFrame:
    """Blocks with the ``path`` above them and columns ``handed`` down, to
    leaves (g, i, leaf, path, handed): ``path`` lists the hashes left and right
    of the way to the root, lowest level first."""
    rows = blocks.select("g", "n", F.col("block").alias("i"), "kids", "path", *handed)
    for level in range(digits, 0, -1):
        rows = rows.withColumn("hashes", F.transform("kids", lambda k: k["h"]))
        rows = rows.select("g", "n", "i", "path", *handed, "hashes", F.posexplode("kids").alias("j", "kid"))
        step = F.struct(F.array_join(F.slice("hashes", F.lit(1), F.col("j")), "").alias("left"),
                        F.array_join(F.slice("hashes", F.col("j") + 2, F.lit(FAN)), "").alias("right"))
        rows = rows.select("g", "n", (F.col("i") * FAN + F.col("kid.at")).alias("i"), *handed,
                           F.when(_active(level), F.concat(F.array(step), "path")).otherwise(F.col("path")).alias("path"),
                           F.col("kid.kids").alias("kids") if level > 1 else F.col("kid").alias("leaf"))
    return rows


def tree(leaves: DataFrame, digits: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """The tiers of blocks over leaves (g, n, i, leaf), lowest first; in the last each g has one block."""
    tiers = []
    while True:
        blocks = scratch.write(roll_up(leaves, digits), f"{name}-tier-{len(tiers)}")
        tiers.append(blocks)
        most = blocks.agg(F.max("block")).first()[0]
        if not most:
            return tiers
        leaves = blocks.select("g", F.ceil(F.col("n") / F.lit(FAN ** digits)).cast("long").alias("n"),
                               F.col("block").alias("i"), F.struct("h").alias("leaf"))


def _merged(blocks: DataFrame, news: DataFrame, handed: Sequence[str]) -> DataFrame:
    """Blocks with what ``news`` (g, block, path, handed) says of them, by a grouped merge."""
    both = blocks.select("g", "block", "n", "kids").unionByName(news.select("g", "block", "path", *handed), allowMissingColumns=True)
    return both.groupBy("g", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", *handed)])


def proofs(tiers: Sequence[DataFrame], top: DataFrame, digits: int, handed: Sequence[str]) -> DataFrame:
    """Leaves of a tree with their paths; ``top`` (g, block, path, handed) is what is known above its last tier."""
    for blocks in reversed(tiers):
        found = unroll(_merged(blocks, top, handed), digits, handed)
        top = found.withColumnRenamed("i", "block")
    return found


def manifest(rows: DataFrame, fields: Sequence[str], key: str, group: str, scratch: Scratch,
             altered: Mapping[str, Column] | None = None, where: Column | None = None, digits: int = DIGITS) -> DataFrame:
    """A row per row of ``rows``: key, leaf, subroot (of its ``group``), root,
    proof_sha256, folded_root and verified.  ``rows`` is read once.

    A leaf is the SHA-256 of the ``fields`` in order.  Leaves of a group ascend
    by ``key`` (null first; equal keys by their leaves); every ``FAN``
    consecutive nodes become one while there are several.  The groups' roots,
    by group (null first, then by bytes), form the tree above.  Where ``where``
    holds, the root is folded from a leaf over the ``altered`` values, so
    ``verified`` is false exactly if an alteration changed the row.

    Nulls in any field count as such; repeated rows are leaves of their own;
    columns beyond the fields play no part, whatever their names; an empty
    table gives no rows.  The result must be used before ``scratch`` ends.
    """
    changed = F.lit(None).cast("string")
    if altered:
        other = row_hash([altered.get(f, F.col(f)) for f in fields])
        changed = F.when(F.lit(True) if where is None else where, other)
    leaves = rows.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
                         F.col(key).alias("key"), row_hash([F.col(f) for f in fields]).alias("h"), changed.alias("changed"))
    leaves = scratch.write(leaves, "leaves")      # texts are read and hashed once; ranking needs two looks
    leaves = ranked(leaves, "g", ["key", "h"], scratch, "ranked")
    lower = tree(leaves.select("g", "n", F.col("rank").alias("i"), F.struct("h", "key", "changed").alias("leaf")),
                 digits, scratch, "group")
    scratch.drop("leaves", "ranked")

    roots = lower[-1].select(F.lit("").alias("all"), F.col("g").alias("key"), "h")
    roots = ranked(roots, "all", ["key"], scratch, "roots")
    upper = tree(roots.select(F.col("all").alias("g"), "n", F.col("rank").alias("i"), F.struct("h", "key").alias("leaf")),
                 digits, scratch, "all")

    nothing = F.array().cast(_PATH)
    top = upper[-1].select("g", "block", nothing.alias("path"), F.col("h").alias("root"))
    groups = proofs(upper, top, digits, ["root"])
    groups = groups.select(F.col("leaf.key").alias("g"), F.lit(0).cast("long").alias("block"), "path", "root",
                           F.col("leaf.h").alias("subroot"))
    found = proofs(lower, groups, digits, ["root", "subroot"])

    folded = F.aggregate("path", F.coalesce("leaf.changed", "leaf.h"),
                         lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    found = found.select(F.col("leaf.key").alias(key), F.col("leaf.h").alias("leaf"), "subroot", "root",
                         F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_of_documents(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by language.  Where the CRC-32 of the
    decimal doc_id is divisible by three, the tampered text is in lower case
    (A to Z only); a null doc_id or text is never tampered with."""
    upper = "".join(map(chr, range(65, 91)))
    with Scratch() as scratch:
        found = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", scratch,
                         altered={"text": F.translate("text", upper, upper.lower())},
                         where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
        return scratch.keep(found, "manifest")
