"""Keyness between two corpora or two parts of one corpus.

Instead of building two frequency tables and a full outer join, the counting
rows of both sides (``operators.freq``) are tagged with a ``side`` flag,
unioned, and summed in one aggregation on the key: one vocabulary-sized
shuffle.  N1, N2 and the document counts are one scalar subquery over that
result, so nothing runs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import LL_CRITICAL, erfc, xlogx_ratio
from ..functions.tags import UNCLASSIFIED_TAG, UNTAGGED
from .freq import document_marks, unit_counts


def side_counts(target: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., AF, AF_Ref, D, D_Ref) from the counting rows of two corpora;
    the row with null keys has the document counts."""
    u = (target.select(*keys, "n", "docs", F.lit(True).alias("_t"))
               .unionByName(reference.select(*keys, "n", "docs", F.lit(False).alias("_t"))))
    t = F.col("_t")
    part = lambda side, c: F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).cast("long")
    return u.groupBy(*keys).agg(part(t, "n").alias("AF"), part(~t, "n").alias("AF_Ref"),
                                part(t, "docs").alias("D"), part(~t, "docs").alias("D_Ref"),
                                F.max(F.col(keys[0]).isNotNull()).alias("_key"))


def keyness_stats(counts: DataFrame, per: float) -> DataFrame:
    keys = [c for c in counts.columns if c not in ("AF", "AF_Ref", "D", "D_Ref", "_key")]
    key = F.col("_key")
    marked = lambda c: F.max(F.when(~key, F.col(c))).cast("double")
    whole = lambda c: F.sum(F.when(key, F.col(c))).cast("double")
    totals = counts.select(F.struct(whole("AF").alias("n1"), whole("AF_Ref").alias("n2"), marked("D").alias("d1"),
                                    marked("D_Ref").alias("d2"))).scalar()
    counts = counts.filter(key).withColumn("_t", totals)
    n1, n2, d1, d2 = (F.col(f"_t.{c}") for c in ("n1", "n2", "d1", "d2"))
    o1, o2 = F.col("AF").cast("double"), F.col("AF_Ref").cast("double")
    tot = n1 + n2
    e1 = n1 * (o1 + o2) / tot
    e2 = n2 * (o1 + o2) / tot
    g2 = F.lit(2.0) * (xlogx_ratio(o1, e1) + xlogx_ratio(o2, e2))
    rf1, rf2 = o1 / n1, o2 / n2
    ll = F.when(rf1 < rf2, -g2).otherwise(g2)
    lr = F.log2((F.greatest(o1, F.lit(0.5)) / n1) / (F.greatest(o2, F.lit(0.5)) / n2))
    return counts.select(
        *keys, ll.alias("LL"), lr.alias("LR"), erfc(F.sqrt(F.abs(ll) / 2.0)).alias("PV"),
        (rf1 * per).alias("RF"), (rf2 * per).alias("RF_Ref"),
        F.col("AF"), F.col("AF_Ref"),
        (F.col("D") * F.lit(100.0) / d1).alias("Range"), (F.col("D_Ref") * F.lit(100.0) / d2).alias("Range_Ref"))


def significance_filter(df: DataFrame, threshold: float = 0.05, direction: str = "positive") -> DataFrame:
    """p < threshold (via the LL critical value for .05/.01/.001, else PV);
    ``direction='positive'`` keeps only keywords of the target."""
    if threshold in LL_CRITICAL:
        keep = F.abs(F.col("LL")) > F.lit(LL_CRITICAL[threshold])
    else:
        keep = F.col("PV") < F.lit(threshold)
    if direction == "positive":
        keep = keep & (F.col("LL") > 0)
    elif direction != "both":
        raise ValueError("direction must be 'positive' or 'both'")
    return df.filter(keep)


def keyness(target: DataFrame, reference: DataFrame, tags_only: bool = False, threshold: float = 0.05,
            direction: str = "positive", swap_target: bool = False) -> DataFrame:
    """Keyness of the counting rows of a target corpus against those of a reference."""
    if swap_target:
        target, reference = reference, target
    keys = ["Tag"] if tags_only else ["Token", "Tag"]
    stats = keyness_stats(side_counts(target, reference, keys), 100.0 if tags_only else 1_000_000.0)
    return significance_filter(stats, threshold, direction)


def keyness_table(target: DataFrame, reference: DataFrame, tags_only: bool = False, **how) -> DataFrame:
    """The same from unit tables (doc_id, Token, Tag, ...); documents are those that have a unit."""
    keys = ["Tag"] if tags_only else ["Token", "Tag"]
    counts = lambda u: unit_counts(u, keys).unionByName(document_marks(u, keys))
    return keyness(counts(target), counts(reference), tags_only, **how)


def keyness_sort(df: DataFrame, by: str = "LL", descending: bool = True) -> DataFrame:
    keys = [c for c in ("Token", "Tag") if c in df.columns]
    order = F.col(by).desc() if descending else F.col(by).asc()
    return df.orderBy(order, *keys)


def tag_filter(df: DataFrame, tags: Sequence[str] | None = None, drop_unclassified: bool = True) -> DataFrame:
    out = df
    if tags:
        out = out.filter(F.col("Tag").isin(list(tags)))
    if drop_unclassified:
        out = out.filter(~F.col("Tag").isin(UNCLASSIFIED_TAG, UNTAGGED))
    return out


def compare_bar_data(keyness_tags: DataFrame) -> DataFrame:
    """(Tag, Mean, Corpus, RF) with Corpus in {Target, Reference}, by Mean descending."""
    mean = (F.col("RF") + F.col("RF_Ref")) / 2.0
    return (keyness_tags.select("Tag", mean.alias("Mean"), F.col("RF").alias("Target"), F.col("RF_Ref").alias("Reference"))
                        .unpivot(["Tag", "Mean"], ["Target", "Reference"], "Corpus", "RF")
                        .orderBy(F.col("Mean").desc(), "Tag", F.col("Corpus").desc()))
