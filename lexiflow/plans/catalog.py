"""Registered queries: one per operator of the inventory.

Every entry reads the given tables (``documents`` and friends under
``sf_dir``) and returns a DataFrame; ``SQL`` holds the DuckDB twin when the
operator is expressible in SQL.  Doubles are rounded to 6 places on both
sides; every computed column is aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import REFERENCE_SOURCES, TARGET_SOURCES, corpus_documents
from . import oracle as O
from .corpus import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, nd: int = O.ROUND) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), nd).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
                       for c, t in df.dtypes])


#: Session setting: documents are dealt to so many tasks before they are tagged (unset: as the files are split).
PARTITIONS = "spark.lexiflow.corpus.partitions"


def corpus(spark: SparkSession, sf_dir: str, sources=None) -> Corpus:
    partitions = spark.conf.get(PARTITIONS, None)
    return Corpus.from_documents(corpus_documents(spark, sf_dir, sources=sources), partitions=int(partitions or 0) or None)


def target(spark, sf_dir) -> Corpus:
    return corpus(spark, sf_dir, TARGET_SOURCES)


def reference(spark, sf_dir) -> Corpus:
    return corpus(spark, sf_dir, REFERENCE_SOURCES)


# SQL prefixes shared by many twins
ALL = O.corpus_ctes(None, None, "tok")
TAR = O.corpus_ctes(TARGET_SOURCES, None, "tar")
REF = O.corpus_ctes(REFERENCE_SOURCES, None, "ref")


def import_all():
    """Import the modules that register queries."""
    from . import q_core, q_compare, q_sequence, q_stats, q_docs, q_hygiene, q_usage  # noqa: F401
    return QUERIES
