"""Corpus quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_doc_ids(ids: DataFrame) -> DataFrame:
    """Ids (spaces removed) that occur at least twice, with their count."""
    return (ids.select(F.regexp_replace("doc_id", " ", "").alias("doc_id"))
               .groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))


def target_reference_overlap(target_ids: DataFrame, reference_ids: DataFrame) -> DataFrame:
    return target_ids.select("doc_id").distinct().join(reference_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def corpus_size(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Bytes of text; without a limit any size is within it."""
    return (docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))
                .withColumn("limit", F.lit(limit).cast("long"))
                .withColumn("within_limit", F.coalesce(F.col("bytes") <= F.col("limit"), F.lit(True))))


def corpus_readiness(target_ids: DataFrame, reference_ids: DataFrame, docs: DataFrame,
                     limit: int | None = None, language_rejects: DataFrame | None = None,
                     decode_rejects: DataFrame | None = None) -> DataFrame:
    """One row of booleans; each check is a scalar subquery of one small
    aggregate (no joins between the one-row results)."""
    dup = duplicate_doc_ids(target_ids).select(F.count(F.lit(1))).scalar()
    ovl = target_reference_overlap(target_ids, reference_ids).select(F.count(F.lit(1))).scalar()
    size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).scalar()
    n = docs.select(F.count(F.lit(1))).scalar()
    cols = [(dup == 0).alias("no_duplicates"), (ovl == 0).alias("no_overlap"),
            (F.lit(True) if limit is None else size <= F.lit(limit)).alias("size_ok"), (n > 0).alias("not_empty")]
    for rejects, name in ((language_rejects, "language_ok"), (decode_rejects, "decode_ok")):
        if rejects is not None:
            cols.append((rejects.select(F.count(F.lit(1))).scalar() == 0).alias(name))
    spark = docs.sparkSession
    row = spark.range(1).select(*cols)
    verdict = F.lit(True)
    for c in row.columns:
        verdict = verdict & F.col(c)
    return row.withColumn("ready", verdict)
