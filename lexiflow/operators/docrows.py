"""Counts and sequences of words straight from document rows.

A document row (``operators.tagging.document_rows``) holds its whole document
as arrays, so whatever concerns one document needs no shuffle: its sequence of
words, and which (Token, Tag) it has for the first time.  Rows that count are

    keys..., n, docs

``n`` occurrences, ``docs`` documents that have the key, both added up over some
documents; and rows whose keys are null: ``n`` the units of these documents that
count, ``docs`` those with a token.  So AF, document counts and totals come from one
aggregation with one vocabulary-sized shuffle, and the texts are read once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tags import PUNCT_TAG
from . import arrow_counting, text_counting
from .sequence import with_context
from .units import is_punct_unit

#: Words before and after a chunk of a sequence: n-grams and collocations reach 9 words at most.
CONTEXT = 10


def unit_lists(kind: str) -> dict[str, Column]:
    """The units of a document row as parallel arrays; those with the tag ``uncounted(kind)`` do not count."""
    if kind == "pos":
        return {"Token": F.col("low"), "Tag": F.col("tags")}
    return {"Token": F.col("units.key"), "Tag": F.col("units.tag")}


def uncounted(kind: str) -> str | None:
    return PUNCT_TAG if kind == "pos" else None


def counted(rows: DataFrame, lists: dict[str, Column], without: str | None = None) -> DataFrame:
    """Counting rows (keys..., n, docs) of parallel arrays of keys per document
    row, counted by pieces of Arrow batches; ``without``: a tag that does not count."""
    columns = [c.alias(k) for k, c in lists.items()]
    schema = ", ".join([f"{k} string" for k in lists] + ["n bigint", "docs bigint"])
    return rows.select(F.col("n").alias("size"), *columns).mapInArrow(
        arrow_counting.unit_counter(list(lists), without), schema)


def counted_units(rows: DataFrame, kind: str) -> DataFrame:
    return counted(rows, unit_lists(kind), uncounted(kind))


def counted_tags(rows: DataFrame, kind: str) -> DataFrame:
    return counted(rows, {"Tag": unit_lists(kind)["Tag"]}, uncounted(kind))


def tag_matrix(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, Tag, n) of whole document rows; what rows of one document have is added up."""
    found = rows.select("doc_id", unit_lists(kind)["Tag"].alias("Tag")).mapInArrow(
        arrow_counting.tag_matrix(uncounted(kind)), T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("Tag string, n bigint")]))
    return found.groupBy("doc_id", "Tag").agg(F.sum("n").alias("n"))


def words(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, n, Token, Tag, punct_<kind>): the units of whole documents as parallel
    arrays.  Those that are punctuation are left out when words are counted
    (``arrow_counting.words_of``): for ``pos`` by their tag, for ``ds`` by ``punct``."""
    punct = F.col("units.punct") if kind == "ds" else F.lit(None).cast("array<boolean>")
    return rows.select("doc_id", "n", *[c.alias(k) for k, c in unit_lists(kind).items()], punct.alias(f"punct_{kind}"))


def whole_words(sequences: DataFrame) -> tuple[list[Column], str | None]:
    """Columns of the units of whole documents (none for blocks), and the tag that punctuation has, if a tag tells."""
    if "punct_ds" in sequences.columns:
        return [F.col("Token"), F.col("Tag"), F.col("punct_ds").alias("punct")], None
    return [F.col("Token"), F.col("Tag")] if "punct_pos" in sequences.columns else [], PUNCT_TAG


def words_of_units(ordered: DataFrame, kind: str, block: int) -> DataFrame:
    """The same from unit rows with a dense ``ord`` (documents of any length):
    a row per ``block`` words of a document, with ``CONTEXT`` words of its
    neighbours before (``lead``) and after."""
    from .sequence import prefix_sum

    is_word = (~is_punct_unit(kind)).cast("long")
    u = prefix_sum(ordered, ["doc_id"], "ord", is_word, "_word").filter(~is_punct_unit(kind))
    u = with_context(u.withColumn("_word", F.col("_word") - 1), "_word", before=CONTEXT, after=CONTEXT, block=block)
    d = u.groupBy("doc_id", "_blk").agg(
        F.array_sort(F.collect_list(F.struct("_word", "ord", "Token", "Tag"))).alias("w"), F.count_if("_own").alias("own"))
    found = F.transform("w", lambda x, i: F.struct(
        x["Token"].alias("Token"), x["Tag"].alias("Tag"), F.coalesce(F.get("w", i - 1)["ord"] + 1 != x["ord"], F.lit(True)).alias("brk")))
    lead = (F.col("_blk") * F.lit(block) - F.get("w", F.lit(0))["_word"]).cast("int")
    return (d.filter("own > 0")
             .select("doc_id", lead.alias("lead"), F.col("own").cast("int").alias("own"), found.alias("words")))


def _own(sequences: DataFrame) -> Column:
    return F.when(F.col("own") > 0, F.sequence(F.col("lead"), F.col("lead") + F.col("own") - 1)).otherwise(F.array().cast("array<int>"))


def gram_struct(i: Column, span: int) -> Column:
    """The n-gram that begins at word ``i``; null if punctuation or the end breaks it."""
    unbroken = F.lit(True)
    for k in range(1, span):
        unbroken = unbroken & F.coalesce(~F.get("words", i + k)["brk"], F.lit(False))
    at = [F.get("words", i + k) for k in range(span)]
    return F.when(unbroken, F.struct(*[w["Token"].alias(f"Token_{k + 1}") for k, w in enumerate(at)],
                                     *[w["Tag"].alias(f"Tag_{k + 1}") for k, w in enumerate(at)]))


def gram_keys(span: int) -> list[str]:
    return [f"Token_{i}" for i in range(1, span + 1)] + [f"Tag_{i}" for i in range(1, span + 1)]


def counted_grams(sequences: DataFrame | text_counting.Texts, span: int, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Counting rows of the n-grams of whole documents (one row each), with the total of units that count."""
    keys = gram_keys(span)
    if isinstance(sequences, text_counting.Texts):
        return _kept(text_counting.counted_grams(sequences, span), keys, keep)
    columns, punct_tag = whole_words(sequences)
    found = sequences.select(F.col("n").alias("size"), *columns).mapInArrow(
        arrow_counting.gram_counter(span, keys, punct_tag), ", ".join([f"{k} string" for k in keys] + ["n bigint", "docs bigint"]))
    return _kept(found, keys, keep)


def _kept(found: DataFrame, keys: Sequence[str], keep: Callable[[Column], Column] | None) -> DataFrame:
    return found if keep is None else found.filter(F.col(keys[0]).isNull() | keep(F.struct(*keys)))


def grams(sequences: DataFrame, span: int) -> DataFrame:
    """One row per n-gram occurrence: doc_id, Token_1..n, Tag_1..n."""
    d = sequences.select("doc_id", "words", F.explode_outer(_own(sequences)).alias("_i")).filter("_i IS NOT NULL")
    return d.select("doc_id", gram_struct(F.col("_i"), span).alias("_g")).filter("_g IS NOT NULL").select("doc_id", "_g.*")


def near_nodes(sequences: DataFrame | text_counting.Texts, node: str, node_tag: str | None, preceding: int, following: int) -> DataFrame:
    """(Token, Tag, nodes, n, is_node): how many nodes (of the given token, with a tag that begins as given) a
    word's ``n`` places stand 1..preceding before or 1..following behind; added up by pieces of Arrow batches."""
    if isinstance(sequences, text_counting.Texts):
        return text_counting.near_nodes(sequences, node, node_tag, preceding, following)
    columns, punct_tag = whole_words(sequences)
    blocks = ["lead", "own", F.col("words.Token").alias("Token"), F.col("words.Tag").alias("Tag")]
    return sequences.select(*(columns or blocks)).mapInArrow(
        arrow_counting.neighbour_counter(node, node_tag, preceding, following, bool(columns), punct_tag),
        "Token string, Tag string, nodes bigint, n bigint, is_node bigint")
