"""Keyword in context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_ws, surface
from .ngrams import validate_node_word
from .sequence import with_context

SEARCH_TYPES = ("fixed", "starts_with", "ends_with", "contains")


def _hit(s: Column, word: str, search_type: str, ignore_case: bool) -> Column:
    if ignore_case:
        s, word = F.lower(s), word.lower()
    if search_type == "fixed":
        return s == F.lit(word)
    if search_type == "starts_with":
        return s.startswith(word)
    if search_type == "ends_with":
        return s.endswith(word)
    if search_type == "contains":
        return s.contains(word)
    raise ValueError(f"search_type must be one of {SEARCH_TYPES}")


def kwic(tokens: DataFrame, node_word: str, search_type: str = "fixed", ignore_case: bool = True,
         reach: int = 10) -> DataFrame:
    """(doc_id, token_idx, pre, node, post): raw tokens around each hit,
    inside its document.  Documents without a hit are dropped first (left
    semi join), contexts come from bounded frames per (doc, block)."""
    validate_node_word(node_word)
    t = tokens.select("doc_id", "token_idx", "token").withColumn("_hit", _hit(surface("token"), node_word, search_type, ignore_case))
    docs_with_hit = t.filter("_hit").select("doc_id")
    t = with_context(t.join(docs_with_hit, "doc_id", "left_semi"), "token_idx", before=reach, after=reach)
    w = Window.partitionBy("doc_id", "_blk").orderBy("token_idx")
    pre = F.array_join(F.collect_list("token").over(w.rowsBetween(-reach, -1)), "")
    post = F.array_join(F.collect_list("token").over(w.rowsBetween(1, reach)), "")
    return (t.withColumn("pre", strip_ws(pre)).withColumn("post", strip_ws(post))
             .filter(F.col("_own") & F.col("_hit"))
             .select("doc_id", "token_idx", "pre", surface("token").alias("node"), "post"))


def kwic_in_documents(rows: DataFrame, node_word: str, search_type: str = "fixed", ignore_case: bool = True,
                      reach: int = 10) -> DataFrame:
    """Same result from whole document rows ``(doc_id, n, toks)``: hits are
    found and their contexts sliced inside each document's token array, so
    nothing is shuffled and only hit positions produce rows.  Documents whose
    text cannot contain the node are skipped by a cheap string test first."""
    validate_node_word(node_word)
    joined = F.array_join("toks", "")
    probe = F.lower(joined).contains(node_word.lower()) if ignore_case else joined.contains(node_word)
    i = F.col("_i")
    before = F.least(i, F.lit(reach))
    pre = F.array_join(F.slice("toks", i - before + 1, before), "")
    post = F.array_join(F.slice("toks", i + 2, F.lit(reach)), "")
    node = surface(F.get("toks", i))
    places = F.when((F.col("n") > 0) & probe, F.sequence(F.lit(0), F.col("n") - 1))
    return (rows.select("doc_id", "toks", F.explode_outer(places).alias("_i"))
                .filter(i.isNotNull() & _hit(node, node_word, search_type, ignore_case))
                .select("doc_id", i.cast("long").alias("token_idx"), strip_ws(pre).alias("pre"), node.alias("node"),
                        strip_ws(post).alias("post")))
