"""Collocations of a node word -- no self-join, no window.

For every word, the number of nodes within reach is read from its sequence's
array (``operators.docrows``); one aggregation by (Token, Tag) yields both the
span and the total frequency.  N and f(node) are scalar subqueries over that
vocabulary-sized result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .docrows import near_nodes
from .ngrams import validate_node_word

STATISTICS = ("pmi", "npmi", "pmi2", "pmi3")


def span_counts(sequences: DataFrame, node_word: str, node_tag: str | None = None, preceding: int = 4,
                following: int = 4) -> DataFrame:
    """(Token, Tag, freq_span, freq_total, _is_node) over words (units that are no punctuation)."""
    validate_node_word(node_word)
    if not (0 <= preceding <= 9 and 0 <= following <= 9):
        raise ValueError("reach must be between 0 and 9")

    return near_nodes(sequences, node_word.lower(), node_tag, preceding, following).groupBy("Token", "Tag").agg(
        F.sum("nodes").alias("freq_span"), F.sum("n").alias("freq_total"), F.max("is_node").alias("_is_node"))


def association(freq_span: Column, freq_total: Column, f_node: Column, n: Column, statistic: str) -> Column:
    o = freq_span.cast("double")
    if statistic == "pmi":
        return F.log2(o * n / (f_node * freq_total))
    if statistic == "pmi2":
        return F.log2(o * o / (f_node * freq_total))
    if statistic == "pmi3":
        return F.log2(o * o * o / (f_node * freq_total * n))
    if statistic == "npmi":
        return F.when(o == n, F.lit(None).cast("double")).otherwise(
            F.log2(o * n / (f_node * freq_total)) / -F.log2(o / n))
    raise ValueError(f"statistic must be one of {STATISTICS}")


def coll_table(sequences: DataFrame, node_word: str, node_tag: str | None = None, preceding: int = 4,
               following: int = 4, statistic: str = "npmi") -> DataFrame:
    """Token, Tag, freq_span, freq_total, mi -- collocates with freq_span > 0."""
    counts = span_counts(sequences, node_word, node_tag, preceding, following)
    totals = counts.select(F.struct(F.sum("freq_total").cast("double").alias("n"),
                                    F.sum(F.when(F.col("_is_node") == 1, F.col("freq_total"))).cast("double").alias("f"))).scalar()
    return (counts.filter(F.col("freq_span") > 0).withColumn("_t", totals)
                  .select("Token", "Tag", "freq_span", "freq_total",
                          association(F.col("freq_span"), F.col("freq_total"), F.col("_t.f"), F.col("_t.n"), statistic).alias("mi")))
