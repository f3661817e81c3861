"""Corpus sources: tables of documents, plain-text files, token parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values (ours): the comparison used throughout the registered queries.
TARGET_SOURCES = [f"src{i}" for i in range(0, 10)]
REFERENCE_SOURCES = [f"src{i}" for i in range(10, 20)]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus_documents(spark: SparkSession, sf_dir: str, sources: Sequence[str] | None = None,
                     lang: str | None = None, category_from: str = "source") -> DataFrame:
    """(doc_id, text) from the ``documents`` table.

    ``doc_id`` = ``<category>_<id>`` so that categories follow the
    ``category_rest`` naming convention; filters reach the parquet scan.
    """
    d = read_table(spark, sf_dir, "documents")
    if lang is not None:
        d = d.filter(F.col("lang") == lang)
    if sources is not None:
        d = d.filter(F.col("source").isin(list(sources)))
    return d.select(F.concat(F.col(category_from), F.lit("_"), F.col("doc_id").cast("string")).alias("doc_id"),
                 F.col("text"))


def documents_from_text_files(spark: SparkSession, path: str, fold_ascii: bool = False) -> DataFrame:
    """One document per file: doc_id = file name without extension and
    spaces; text trimmed (optionally folded to ASCII)."""
    from ..operators.ingest import clean_documents

    raw = (spark.read.option("wholetext", True).text(path)
                .select(F.url_decode(F.col("_metadata.file_name")).alias("file_name"), F.col("value").alias("text")))
    return clean_documents(raw, fold=fold_ascii)


def with_segment_offsets(segments: DataFrame, segment: str = "segment", ahead: int | None = None) -> DataFrame:
    """Documents stored as several rows ``(doc_id, <segment>, text)``, cut
    between tokens: (doc_id, _seg, text, _toks, _off, _ahead).

    ``_off`` is the number of tokens in the earlier segments, so token
    positions are global; ``_ahead`` holds the first ``ahead`` tokens after the
    segment (default: what the longest phrase needs), so that phrases run
    across segment edges.  Segments without a token are left out; a segment
    that does not end in whitespace is followed by a line break.  Offsets are a
    blocked prefix sum and the tokens ahead come from bounded frames, so a
    document with very many segments is spread over many tasks."""
    from ..functions.text import TOKEN_PATTERN, WHITESPACE, token_array
    from ..operators.sequence import dense_rank_in_doc, prefix_sum, with_context
    from ..operators.tagging import phrase_length

    ahead = phrase_length() - 1 if ahead is None else ahead
    s = segments.select("doc_id", F.col(segment).cast("long").alias("_seg"), "text").filter(F.col("text").rlike(r"\S"))
    s = s.join(s.groupBy("doc_id").agg(F.max("_seg").alias("_last")), "doc_id")
    ended = F.when(F.right("text", F.lit(1)).isin(*WHITESPACE), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    is_last = F.col("_seg") == F.col("_last")
    s = s.withColumn("_toks", F.when(is_last, token_array("text")).otherwise(F.regexp_extract_all(ended, F.lit(TOKEN_PATTERN), 0)))
    s = s.drop("_last")
    narrow = s.select("doc_id", "_seg", F.size("_toks").cast("long").alias("_n"), F.slice("_toks", 1, max(ahead, 1)).alias("_head"))
    placed = dense_rank_in_doc(prefix_sum(narrow, ["doc_id"], "_seg", F.col("_n"), "_off", inclusive=False), ["doc_id"], "_seg", "_at")
    placed = with_context(placed, "_at", before=0, after=max(ahead, 1))
    after = Window.partitionBy("doc_id", "_blk").orderBy("_at").rowsBetween(1, max(ahead, 1))
    placed = placed.withColumn("_ahead", F.slice(F.flatten(F.collect_list("_head").over(after)), 1, max(ahead, 1)))
    placed = placed.filter("_own").select("doc_id", "_seg", "_off", "_ahead" if ahead else F.array().cast("array<string>").alias("_ahead"))
    return s.join(placed, ["doc_id", "_seg"])
