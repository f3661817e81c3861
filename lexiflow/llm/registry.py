"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import read_table
from . import dialogues, jaccard, licenses, merkle, neighbours, oracle, packing, pieces, quality, samples, sharding, substrings, toxicity, urls, vector_dedup

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {"op1_vector_dedup": oracle.VECTOR_DEDUP, "op4_ngram_jaccard": oracle.NGRAM_JACCARD,
                        "op8_substring_dedup": oracle.SUBSTRING_DEDUP, "op12_merkle_manifest": oracle.MERKLE}

#: Fixed values of the URL query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _query(fn):
    _QUERIES[fn.__name__] = fn
    return fn


@_query
def op3_sharding(spark, sf):
    out = sharding.shard(read_table(spark, sf, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@_query
def op5_url_filter(spark, sf):
    return urls.judge_pages(read_table(spark, sf, "pages"), URL_RULES)


@_query
def op7_packing(spark, sf):
    return packing.pack(read_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op10_toxicity(spark, sf):
    return toxicity.toxicity(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


@_query
def op6_quality(spark, sf):
    docs = read_table(spark, sf, "documents")
    return quality.judge(docs, read_table(spark, sf, "labels")).drop("text", "n_chars").withColumn(
        "held_out", ~samples.in_fit_fold())


@_query
def op4_ngram_jaccard(spark, sf):
    return jaccard.jaccard_join(read_table(spark, sf, "documents"))


@_query
def op8_substring_dedup(spark, sf):
    return substrings.digest(read_table(spark, sf, "documents"))


@_query
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)


@_query
def op1_vector_dedup(spark, sf):
    return vector_dedup.near_duplicates(read_table(spark, sf, "embeddings"))


@_query
def op2_sentencepiece(spark, sf):
    return pieces.round_trip(read_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op9_neighbours(spark, sf):
    return neighbours.search(read_table(spark, sf, "embeddings"))


@_query
def op12_merkle_manifest(spark, sf):
    return merkle.manifest_of_documents(read_table(spark, sf, "documents"))


@_query
def op13_conversation_repair(spark, sf):
    return dialogues.digest(read_table(spark, sf, "conversations"))


@_query
def op11_license_scan(spark, sf):
    return licenses.digest(read_table(spark, sf, "documents"))
