"""N-grams and anchored clusters.

Input are word sequences (``operators.docrows``): a row per document, or per
block of a document of any length with a few words of its neighbours.  An
n-gram is read from its sequence's array, so there is no window and no join.
Whole documents are counted by pieces of Arrow batches (``arrow_counting``), and
one shuffle on the n-gram follows; blocks are first counted by document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_counting
from .docrows import counted_grams, gram_keys, grams
from .freq import relative, summed, unit_counts
from .sequence import dense_rank_in_doc

MATCH_MODES = ("fixed", "starts_with", "ends_with", "contains")


def ordered_units(units: DataFrame, dense: bool = False) -> DataFrame:
    """Add ``ord``: 0..n-1 per document by unit position.  ``dense=True``
    when ``pos`` is already dense (one token per unit, nothing filtered)."""
    if dense:
        return units.withColumn("ord", F.col("pos"))
    return dense_rank_in_doc(units, ["doc_id"], "pos", "ord")


def check_span(span: int) -> None:
    if not 2 <= span <= 10:
        raise ValueError("span must be between 2 and 10")


def match(col: Column, word: str, mode: str) -> Column:
    w = word.lower()
    if mode == "fixed":
        return col == F.lit(w)
    if mode == "starts_with":
        return col.startswith(w)
    if mode == "ends_with":
        return col.endswith(w)
    if mode == "contains":
        return col.contains(w)
    raise ValueError(f"mode must be one of {MATCH_MODES}")


def ngrams(sequences: DataFrame | text_counting.Texts, span: int = 2, min_rf: float | None = 10.0, n_units: Column | None = None,
           ndocs: Column | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """N-gram frequency table: Token_i, Tag_i, AF, RF (per million units), Range.

    Sequences of whole documents carry their totals; for blocks they are given.  ``keep`` tests the n-gram as a struct."""
    check_span(span)
    keys = gram_keys(span)
    if "words" not in sequences.columns:
        if isinstance(sequences, text_counting.Texts) and keep is None and min_rf is not None and min_rf >= text_counting.LEAST_RF:
            found = text_counting.frequent_grams(sequences, span, min_rf)
        else:
            found = counted_grams(sequences, span, keep)
        agg = summed(found, keys)
        out = relative(agg, keys, 1_000_000.0, total=lambda t: t["marked"])
    else:
        found = grams(sequences, span)
        if keep is not None:
            found = found.filter(keep(F.struct(*keys)))
        out = relative(summed(unit_counts(found, keys), keys), keys, 1_000_000.0, ndocs=ndocs, total=n_units)
    return out if min_rf is None else out.filter(F.col("RF") > F.lit(min_rf))


def clusters_by_token(sequences: DataFrame, node_word: str, node_position: int = 1, span: int = 2, mode: str = "fixed",
                      n_units: Column | None = None, ndocs: Column | None = None) -> DataFrame:
    if not 1 <= node_position <= span:
        raise ValueError("node_position must be within the span")
    validate_node_word(node_word)
    return ngrams(sequences, span, None, n_units, ndocs, lambda g: match(g[f"Token_{node_position}"], node_word, mode))


def clusters_by_tag(sequences: DataFrame, tag: str, tag_position: int = 1, span: int = 2,
                    n_units: Column | None = None, ndocs: Column | None = None) -> DataFrame:
    if not 1 <= tag_position <= span:
        raise ValueError("tag_position must be within the span")
    return ngrams(sequences, span, None, n_units, ndocs, lambda g: g[f"Tag_{tag_position}"] == F.lit(tag))


def ngram_tag_filter(table: DataFrame, tags_by_position: dict[int, Sequence[str]]) -> DataFrame:
    """AND of per-position tag lists; an empty list leaves a position free."""
    cond = F.lit(True)
    for pos, tags in tags_by_position.items():
        if tags:
            cond = cond & F.col(f"Tag_{pos}").isin(list(tags))
    return table.filter(cond)


def validate_node_word(word: str) -> None:
    if not word or " " in word:
        raise ValueError("node word must be one word without spaces")
