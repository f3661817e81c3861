"""From raw documents to packed sequences, in five stages.

Each stage gets ``(spark, docs, sf_dir)``, works on all that the one before it
kept and returns a DataFrame, which ``run`` writes as Parquet in the shared
scratch area and reads again as the next stage's documents.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import jaccard, packing, quality, substrings, toxicity
from lexiflow.llm.ranks import ranked
from lexiflow.llm.scratch import Scratch
from lexiflow.sources.documents import read_table
from lexiflow.storage import materialize

#: Dropped ids of at most this number are broadcast; beyond it Spark joins by a shuffle.
BROADCAST_IDS = 1_000_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  Null and empty texts
    and repeated rows are judged like any other; an empty table stays empty;
    other columns pass through whatever their names."""
    judged = quality.judge(docs, read_table(spark, sf_dir, "labels"))
    return judged.filter(~F.col("rejected")).select(*docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.  A null or empty text
    has the score of no evidence; else as ``keep_good``."""
    scorer = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, scorer, name="__llm_toxic").filter(F.col("__llm_toxic") < 0.5).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-duplicate shingle sets (five words, a share of
    80 % or more) the one with the smallest id stays.

    Rows with a null id, without words or without a near copy stay; of rows
    with one id and one text one stays; rows with one id and different texts
    are different documents (rows are then numbered for the search, as it needs
    unique ids); other columns pass through whatever their names;
    an empty table stays empty."""
    repeated = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    if repeated.isEmpty():
        found = jaccard.jaccard_join(docs, share=80, width=5).select("doc_id", "component_id")
        gone = materialize(found.filter("doc_id <> component_id").select("doc_id"), "near-copies")
        return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    null = docs.filter("doc_id IS NULL")
    known = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.struct("*").alias("row"), F.sha2("text", 256).alias("said"),
                                                     F.lit("").alias("all")).dropDuplicates(["doc_id", "said"])
    with Scratch() as scratch:      # numbered by id, so that the smallest number of a group has its smallest id
        numbered = scratch.write(ranked(known, "all", ["doc_id", "said"], scratch), "numbered")
        found = jaccard.jaccard_join(numbered.select("rank", "text"), share=80, width=5, id_col="rank").select("doc_id", "component_id")
        gone = materialize(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("rank")), "near-copies")
        kept = materialize(numbered.join(gone, "rank", "left_anti").select("row.*"), "kept")
    return kept.unionByName(null)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out."""
    cut = substrings.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2048; a row per piece.  A null text is empty (its
    end token alone); repeated rows are packed each; an empty table gives no row."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_civil),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]

#: The learned stages have no SQL form; the tests hold the kept documents of the third and fourth stage and the
#: ids of the fifth against brute-force versions, and the learned ones against their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
