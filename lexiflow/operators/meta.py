"""Corpus metadata and document categories."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import (COMMON_DICTIONARY, COMMON_DICTIONARY_MARKERS, LARGE_DICTIONARY, PUNCT_TAG,
                              UNTAGGED)
from ..functions.text import category, first_segment

# Accepted number of document categories.
MIN_CATEGORIES, MAX_CATEGORIES = 2, 20


def corpus_summary(kinds: DataFrame) -> DataFrame:
    """One row: tokens_pos, tokens_ds, ndocs, model, tags_ds, tags_pos.

    ``kinds`` has a row (kind, Tag, punct, n) for every kind of unit, tag and
    whether it is punctuation, and a row of kind ``doc`` with the documents
    (``Corpus.unit_kinds``); it is bounded by the tagsets, so the closed tag
    lists are gathered from it in one aggregate.  The id list is
    ``doc_ids(corpus)``, a DataFrame, because it grows with the corpus.
    """
    tag, n = F.col("Tag"), F.col("n")
    of = lambda kind: F.col("kind") == kind
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, tag)))
    marked = functools.reduce(lambda a, b: a | b, [tag.contains(m) for m in COMMON_DICTIONARY_MARKERS])
    common = F.max(of("ds") & marked)
    return kinds.agg(
        total(of("pos") & ~F.col("punct")).alias("tokens_pos"), total(of("ds") & ~F.col("punct")).alias("tokens_ds"),
        total(of("doc")).alias("ndocs"),
        F.when(common, F.lit(COMMON_DICTIONARY)).otherwise(F.lit(LARGE_DICTIONARY)).alias("model"),
        names(of("ds") & (tag != UNTAGGED)).alias("tags_ds"), names(of("pos") & (tag != PUNCT_TAG)).alias("tags_pos"))


def doc_ids(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id").distinct()


def doc_categories(doc_ids_df: DataFrame) -> DataFrame:
    """(doc_id, category), empty if any id lacks ``_`` or any category is empty.

    The all-ids guard is a one-row aggregate used as a scalar subquery."""
    d = doc_ids_df.select("doc_id", category("doc_id").alias("category"))
    ok = d.agg(F.coalesce(F.min(F.col("doc_id").contains("_") & (F.length("category") > 0)), F.lit(False))).scalar()
    return d.filter(ok)


def category_gate(cats: DataFrame) -> DataFrame:
    """One row: n_categories and whether 2..20 categories are present."""
    return cats.agg(F.countDistinct("category").alias("n_categories")).withColumn(
        "accepted", F.col("n_categories").between(MIN_CATEGORIES, MAX_CATEGORIES))


def category_counts(cats: DataFrame) -> DataFrame:
    return cats.groupBy("category").agg(F.count(F.lit(1)).alias("n_docs")).orderBy("category")


def category_labels(counts: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Add ``description``; unmapped categories keep their code.  The
    mapping is a fixed small dict, inlined as a map literal (no join)."""
    if not mapping:
        return counts.withColumn("description", F.col("category"))
    m = F.create_map(*[F.lit(x) for k in sorted(mapping) for x in (k, mapping[k])])
    return counts.withColumn("description", F.coalesce(m[F.col("category")], F.col("category")))


def subset_by_category(tokens: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Keep documents whose id before the first ``_`` is listed."""
    return tokens.filter(first_segment("doc_id").isin(list(categories)))


def split_corpus_counts(tokens: DataFrame, tar_prefixes: Sequence[str], ref_prefixes: Sequence[str]) -> DataFrame:
    """Two parts by id prefix: tokens, words (tag not starting with Y), documents."""
    def starts(prefixes):
        cond = F.lit(False)
        for p in prefixes:
            cond = cond | F.col("doc_id").startswith(p)
        return cond
    tar, ref = starts(tar_prefixes), starts(ref_prefixes)
    word = ~F.col("pos_tag").startswith("Y")
    return tokens.agg(
        F.count_if(tar).alias("tar_tokens"), F.count_if(tar & word).alias("tar_words"),
        F.count_distinct(F.when(tar, F.col("doc_id"))).alias("tar_ndocs"),
        F.count_if(ref).alias("ref_tokens"), F.count_if(ref & word).alias("ref_words"),
        F.count_distinct(F.when(ref, F.col("doc_id"))).alias("ref_ndocs"))
