"""Single-document views, built for all documents at once,
and tagged-text rendering (§2.11).

Whole document rows (``operators.tagging``) are viewed in place: spans are listed
from Arrow batches, texts are joined in the row, and nothing is shuffled.  Unit rows of any origin, documents larger than a
row included, take the blocked prefix sum instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tags import OTHER, PUNCT_TAG, UNCLASSIFIED_TAG, UNTAGGED, simplify_tag
from ..functions.text import WHITESPACE, strip_ws
from . import arrow_counting
from .sequence import dense_rank_in_doc, prefix_sum
from .tagging import unit_text

NOT_WRAPPED = {"pos": PUNCT_TAG, "simple": OTHER, "ds": UNTAGGED}


def _viewed(tag: Column, view: str) -> Column:
    return simplify_tag(tag) if view == "simple" else tag


def _span_text(utext: Column, tag: Column, plain: str) -> Column:
    """A unit as HTML: wrapped unless it has the view's plain tag; one trailing whitespace stays."""
    last = F.right(utext, F.lit(1))
    return _wrapped(strip_ws(utext), F.when(last.isin(*WHITESPACE), last).otherwise(F.lit("")), tag, plain)


def _wrapped(token: Column, last: Column, tag: Column, plain: str) -> Column:
    wrapped = F.concat(F.lit('<span class="'), tag, F.lit('">'), token, F.lit("</span>"))
    return F.concat(F.when(tag != F.lit(plain), wrapped).otherwise(token), last)


def doc_spans(units: DataFrame, view: str = "pos") -> DataFrame:
    """(doc_id, pos, token, Tag, tag_start, tag_end, Text) per unit.

    ``units`` are POS units for views 'pos'/'simple' (simplified after the
    units are formed) and DS units for 'ds'."""
    u = units.withColumn("Tag", _viewed(F.col("Tag"), view)).withColumn("token", strip_ws("utext"))
    u = prefix_sum(u, ["doc_id"], "pos", F.length("token").cast("long"), "tag_end")
    return u.select("doc_id", "pos", "token", "Tag", (F.col("tag_end") - F.length("token")).alias("tag_start"),
                    "tag_end", _span_text(F.col("utext"), F.col("Tag"), NOT_WRAPPED[view]).alias("Text"))


def row_units(rows: DataFrame, view: str) -> DataFrame:
    """(doc_id, us): the units of whole document rows as struct(pos, utext, Tag)."""
    if view == "ds":
        us = F.transform("units", lambda u: F.struct(u["pos"].alias("pos"), unit_text(u).alias("utext"), u["tag"].alias("Tag")))
    else:
        both = F.zip_with("toks", "tags", lambda t, tag: F.struct(t.alias("utext"), tag.alias("Tag")))
        us = F.transform(both, lambda x, i: F.struct(i.cast("long").alias("pos"), x["utext"].alias("utext"), x["Tag"].alias("Tag")))
    return rows.select("doc_id", us.alias("us"))


def _one_text(units: DataFrame, text: Column) -> DataFrame:
    """A row (doc_id, text) for each document with units, exploded as a filter on the array's size would compute it once more."""
    some = F.when(F.size("us") > 0, F.array(text))
    return units.select("doc_id", F.explode_outer(some).alias("text")).filter("text IS NOT NULL")


def doc_spans_in_rows(rows: DataFrame, view: str = "pos") -> DataFrame:
    """``doc_spans`` of whole document rows, listed by pieces of Arrow batches."""
    phrases = view == "ds"
    units = [F.col("units.pos").alias("pos"), F.col("units.n").alias("n"), F.col("units.tag").alias("Tag")] if phrases else [F.col("tags").alias("Tag")]
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("pos bigint, token string, Tag string, tag_end bigint, last string")])
    u = rows.select("doc_id", "toks", *units).mapInArrow(arrow_counting.span_lister(phrases), schema)
    return u.withColumn("Tag", _viewed(F.col("Tag"), view)).select(
        "doc_id", "pos", "token", "Tag", (F.col("tag_end") - F.length("token")).alias("tag_start"), "tag_end",
        _wrapped(F.col("token"), F.col("last"), F.col("Tag"), NOT_WRAPPED[view]).alias("Text"))


def doc_html_in_rows(rows: DataFrame, view: str = "ds") -> DataFrame:
    """One HTML string per whole document row."""
    return _one_text(row_units(rows, view), F.array_join(F.transform(
        "us", lambda u: _span_text(u["utext"], _viewed(u["Tag"], view), NOT_WRAPPED[view])), "")).withColumnRenamed("text", "html")


def ordered_join(value: str, order: str, sep: str = "") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), sep)


def doc_html(spans: DataFrame) -> DataFrame:
    """One HTML string per document: its span Texts in order."""
    return spans.groupBy("doc_id").agg(ordered_join("Text", "pos").alias("html"))


def doc_tag_counts(units: DataFrame, view: str = "pos") -> DataFrame:
    """(doc_id, Tag, AF, RF %) without the view's plain tag; per document by AF descending, then Tag."""
    u = units.withColumn("Tag", _viewed(F.col("Tag"), view))
    c = u.filter(F.col("Tag") != F.lit(NOT_WRAPPED[view])).groupBy("doc_id", "Tag").agg(F.count(F.lit(1)).alias("AF"))
    tot = c.groupBy("doc_id").agg(F.sum("AF").alias("_t"))
    return (c.join(tot, "doc_id").select("doc_id", "Tag", "AF", (F.col("AF") / F.col("_t") * 100).alias("RF"))
             .orderBy("doc_id", F.col("AF").desc(), "Tag"))


def doc_tag_positions(units: DataFrame, tags: Sequence[str], dense: bool = False) -> DataFrame:
    """(doc_id, pos, Tag, X): X = (unit index + 1) / units in the document."""
    u = units.withColumn("ord", F.col("pos")) if dense else dense_rank_in_doc(units, ["doc_id"], "pos", "ord")
    n = u.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return (u.filter(F.col("Tag").isin(list(tags))).join(n, "doc_id")
             .select("doc_id", "pos", "Tag", ((F.col("ord") + 1) / F.col("_n")).alias("X")))


def doc_tag_positions_in_rows(rows: DataFrame, tags: Sequence[str], view: str = "ds") -> DataFrame:
    """``doc_tag_positions`` of whole document rows."""
    d = row_units(rows, view).select("doc_id", F.size("us").alias("_n"), F.posexplode_outer("us").alias("_i", "u")).filter("u IS NOT NULL")
    return (d.filter(F.col("u.Tag").isin(list(tags)))
             .select("doc_id", F.col("u.pos").alias("pos"), F.col("u.Tag").alias("Tag"), ((F.col("_i") + 1) / F.col("_n")).alias("X")))


def _tagged_item(utext: Column, tag: Column, kind: str) -> Column:
    plain = [PUNCT_TAG, UNCLASSIFIED_TAG] if kind == "pos" else [UNTAGGED]
    tok = F.replace(strip_ws(utext), F.lit(" "), F.lit("_"))
    return F.when(tag.isin(plain), tok).otherwise(F.concat(tok, F.lit("|"), tag))


def _with_file_name(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", F.concat(F.col("doc_id"), F.lit("_tagged.txt")).alias("file_name"), "text")


def tagged_text(units: DataFrame, kind: str = "pos") -> DataFrame:
    """(doc_id, file_name, text): units stripped, spaces -> '_', ``tok|TAG``
    except Y/FU (POS) or Untagged (DS); one space between units."""
    items = units.withColumn("_item", _tagged_item(F.col("utext"), F.col("Tag"), kind))
    return _with_file_name(items.groupBy("doc_id").agg(ordered_join("_item", "pos", " ").alias("text")))


def tagged_text_in_rows(rows: DataFrame, kind: str = "pos") -> DataFrame:
    """``tagged_text`` of whole document rows."""
    return _with_file_name(_one_text(row_units(rows, kind), F.array_join(F.transform(
        "us", lambda u: _tagged_item(u["utext"], u["Tag"], kind)), " ")))
