"""POS / DS units: tokens sharing (doc_id, id, tag), concatenated in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import PUNCT_TAG, UNTAGGED
from ..functions.text import PUNCT_SPACE_PATTERN, norm, rstrip_ws

KINDS = {"pos": ("pos_id", "pos_tag"), "ds": ("ds_id", "ds_tag")}


def unit_key(token: str | Column) -> Column:
    """Lower case, trailing whitespace removed, inner whitespace runs -> one space."""
    return F.lower(F.regexp_replace(rstrip_ws(token), r"\s+", " "))


def ordered_concat(token_idx: str, token: str) -> Column:
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(token_idx, token))), lambda x: x[token]), "")


def units(tokens: DataFrame, kind: str = "pos", single_token: bool = False) -> DataFrame:
    """-> (doc_id, unit_id, Tag, pos, utext, Token).

    ``pos`` is the first token index of the unit (the order key), ``token`` the
    raw concatenation with whitespace (``utext``), ``Token`` the normalised key.  With
    ``single_token=True`` (ids known to be unique per token, as our POS tagger
    produces) the grouping shuffle is skipped.
    """
    id_col, tag_col = KINDS[kind]
    if single_token:
        u = tokens.select("doc_id", F.col(id_col).alias("unit_id"), F.col(tag_col).alias("Tag"),
                          F.col("token_idx").alias("pos"), F.col("token").alias("utext"))
        return u.withColumn("Token", norm("utext"))      # a token has no inner whitespace
    u = (tokens.groupBy("doc_id", F.col(id_col).alias("unit_id"), F.col(tag_col).alias("Tag"))
               .agg(F.min("token_idx").alias("pos"), ordered_concat("token_idx", "token").alias("utext")))
    return u.withColumn("Token", unit_key("utext"))


def is_punct_unit(kind: str) -> Column:
    """Units that analyses skip: POS ``Y``; DS Untagged units made only of
    punctuation and spaces."""
    if kind == "pos":
        return F.col("Tag") == F.lit(PUNCT_TAG)
    return (F.col("Tag") == F.lit(UNTAGGED)) & F.col("utext").rlike(PUNCT_SPACE_PATTERN)


def analytic_units(tokens: DataFrame, kind: str = "pos", single_token: bool = False) -> DataFrame:
    """Units counted by frequency tables: POS without ``Y``; all DS units (D5)."""
    u = units(tokens, kind, single_token)
    return u.filter(~is_punct_unit("pos")) if kind == "pos" else u
