"""Tokenizer and the two stand-in taggers.

Output is the token table::

    doc_id STRING, token_idx BIGINT, token STRING, pos_tag STRING,
    ds_tag STRING, pos_id BIGINT, ds_id BIGINT

``pos_id`` is the token index (one token per POS unit); ``ds_id`` is the token
index of the first token of the rhetorical unit, so tokens sharing a phrase
share an id.  Tokenizing and both taggers work on the token array of a
document's row, so building the token table shuffles nothing.

A document too large for a row comes as segment rows (see
``sources.documents.with_segment_offsets``).  A phrase may then begin in one
segment and end in a later one: each segment knows the first tokens after it
(``_ahead``), and how many of its own tokens an earlier phrase covers
(``_skip``).  The scan of a segment maps each possible value of ``_skip`` to
that of the next segment; these small maps are composed along the document,
block by block.

(In these expressions a lambda reads an outer array only if the same
projection reads it more than once.  An array that is read once is otherwise
computed inside the lambda, once for every element.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import DS_LEXICON, POS_LEXICON
from ..functions.tags import PUNCT_TAG, UNCLASSIFIED_TAG, UNTAGGED
from ..functions.text import rstrip_ws, token_array
from . import arrow_tagging
from .sequence import dense_rank_in_doc

TOKEN_COLUMNS = ["doc_id", "token_idx", "token", "pos_tag", "ds_tag", "pos_id", "ds_id"]

# Fixed values (ours): suffix rules for open-class words, first match wins.
SUFFIX_RULES = [
    (("ing",), "VVG"),
    (("ed",), "VVD"),
    (("ly",), "RR"),
    (("ous", "ful", "ive", "al", "able", "ible"), "JJ"),
    (("s",), "NN2"),
]


def _offset(df: DataFrame) -> Column:
    """Token offset of a document row: 0, or ``_off`` of a segment."""
    return F.col("_off") if "_off" in df.columns else F.lit(0).cast("long")


#: Adds an array ``tags`` to rows with arrays ``toks`` and ``low``: the part of speech of each token.
Tagger = Callable[[DataFrame], DataFrame]


def rule_tagger(lexicon: dict[str, str] | None = None) -> Tagger:
    """The default tagger: closed-class words by a lexicon, then suffix rules
    on arrays of tokens (``arrow_tagging``).  A null array stays null."""
    lex = POS_LEXICON if lexicon is None else lexicon
    tags = F.arrow_udf(arrow_tagging.word_tagger(lex, SUFFIX_RULES, PUNCT_TAG, UNCLASSIFIED_TAG), "array<string>")

    def tag(rows: DataFrame) -> DataFrame:
        beyond = F.regexp_replace(F.array_join("toks", ""), r"[\x00-\x7F]+", "")      # one quick scan; both patterns are beyond ASCII
        marks, digits = (F.regexp_extract_all("_beyond", F.lit(p), 0) for p in (r"[^\x00-\x7F\s\p{L}\p{N}]", r"[\p{N}&&[^\x00-\x7F]]"))
        return rows.withColumn("_beyond", beyond).withColumn("tags", tags("toks", "low", marks, digits)).drop("_beyond")
    return tag


def document_rows(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, n, toks, low, tags[, _off, _seg]): token strings, their lower
    case and parts of speech per document (segment) row.  A segment's arrays go
    on with the tokens ahead of it; ``n`` is the number of its own."""
    if "_ahead" in docs.columns:
        d = docs.select("doc_id", "_off", "_seg", F.size("_toks").alias("n"), F.concat("_toks", "_ahead").alias("toks"))
    else:
        d = docs.select("doc_id", token_array("text").alias("toks")).withColumn("n", F.size("toks"))
    return (tagger or rule_tagger())(d.withColumn("low", F.transform("toks", lambda t: F.lower(rstrip_ws(t)))))


def tokens_from_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, token_idx, token, pos_tag, pos_id); narrow, no shuffle."""
    d = rows.select("doc_id", _offset(rows).alias("_o"), "toks", "tags",
                    F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))).alias("i")).filter("i IS NOT NULL")
    at = (F.col("_o") + F.col("i")).cast("long")
    return d.select("doc_id", at.alias("token_idx"), F.get("toks", F.col("i")).alias("token"),
                    F.get("tags", F.col("i")).alias("pos_tag"), at.alias("pos_id"))


UNIT_TYPE = "array<struct<pos:bigint,n:int,tag:string,key:string,punct:boolean>>"
SPAN_TYPE = "array<struct<s:bigint,n:int,tag:string>>"
FOLD_CHUNK = 256


def phrase_length(lexicon: dict[str, str] | None = None) -> int:
    return max(len(p.split(" ")) for p in (DS_LEXICON if lexicon is None else lexicon))


def in_chunks(values: Column, empty: str) -> Column:
    """An array cut into arrays of ``FOLD_CHUNK``, so that a fold that appends stays near-linear."""
    n = F.ceil(F.size(values) / F.lit(FOLD_CHUNK)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.slice(values, j * FOLD_CHUNK + 1, FOLD_CHUNK))) \
            .otherwise(F.array().cast(f"array<{empty}>"))


SCAN_BLOCK = 1024     # segments whose maps are composed in one row


def _with_skip(rows: DataFrame, max_len: int) -> DataFrame:
    """Add ``_skip``: how many own tokens a phrase of an earlier segment covers.

    A segment's scan turns the tokens it must skip (0 .. max_len - 1) into
    those that the next one must.  Maps of ``SCAN_BLOCK`` segments are
    composed in a row, then those of a document's blocks, and the states go
    back down; no row holds more than a block's maps."""
    own = F.col("n").cast("long")
    left = lambda c: F.greatest(F.aggregate("_dc", c, lambda e, x: F.when(x["s"] >= e, x["s"] + x["n"]).otherwise(e)) - own,
                                F.lit(0).cast("long")).cast("int")
    following = F.array(*[left(F.lit(c).cast("long")) for c in range(max_len)])
    maps = dense_rank_in_doc(rows.select("doc_id", "_seg", following.alias("m")), ["doc_id"], "_seg", "at")
    maps = maps.withColumn("b", F.expr(f"at div {SCAN_BLOCK}"))
    blocks = maps.groupBy("doc_id", "b").agg(F.array_sort(F.collect_list(F.struct("at", "_seg", "m"))).alias("l"))

    def passed(state, m):
        return F.get(m, state)

    whole = F.transform(F.array(*[F.lit(c) for c in range(max_len)]),
                        lambda c: F.aggregate("l", c, lambda state, x: passed(state, x["m"])))
    tops = blocks.select("doc_id", "b", whole.alias("m")).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("b", "m"))).alias("l"))

    def states_before(fields):
        """Each element of ``l`` with the state in which it begins."""
        kind = "array<struct<" + ",".join(f"{a}:{t}" for a, t in fields) + ",c:int>>"
        step = lambda acc, x: F.struct(passed(acc["c"], x["m"]).alias("c"), F.array_append(
            acc["o"], F.struct(*[x[a].alias(a) for a, _ in fields], acc["c"].alias("c"))).alias("o"))
        return lambda begin: F.aggregate("l", F.struct(begin.alias("c"), F.array().cast(kind).alias("o")), step)["o"]

    tops = tops.select("doc_id", F.explode(states_before([("b", "bigint")])(F.lit(0))).alias("s")).select(
        "doc_id", "s.b", F.col("s.c").alias("begin"))
    found = (blocks.join(tops, ["doc_id", "b"])
                   .select("doc_id", F.explode(states_before([("_seg", "bigint")])(F.col("begin"))).alias("s"))
                   .select("doc_id", "s._seg", F.col("s.c").cast("long").alias("_skip")))
    return rows.join(found, ["doc_id", "_seg"])


def with_ds_units(rows: DataFrame, lexicon: dict[str, str] | None = None) -> DataFrame:
    """Add the rhetorical units that begin in each row as an ordered array
    ``units`` of ``struct(pos, n, tag, key, punct)`` (the normalised text, and
    whether it is punctuation that analyses skip); the units of a document
    cover every token exactly once.

    The longest lexicon phrase is looked up at each word; from left to right
    those that overlap none taken before stay; words outside are Untagged units
    of one token.  Work is O(tokens x max phrase length) per document.
    """
    phrases = arrow_tagging.Phrases(DS_LEXICON if lexicon is None else lexicon, UNTAGGED)
    skip = F.lit(0).cast("long")
    if "_seg" in rows.columns:
        candidates = F.arrow_udf(phrases.candidates, SPAN_TYPE)
        rows = _with_skip(rows.withColumn("_dc", candidates("low", "n")), phrase_length(lexicon))
        skip = F.col("_skip")
    return rows.withColumn("units", F.arrow_udf(phrases.units, UNIT_TYPE)("toks", "low", "n", skip)).drop("_dc", "_skip")


def tokens_from_units(doc_units: DataFrame) -> DataFrame:
    """Token rows (TOKEN_COLUMNS) of a document's units; ``ds_id`` is the first
    token index of the unit.  Narrow, no shuffle; a unit that runs into the
    next segment brings its tokens along."""
    o, u, j = F.col("_o"), F.col("u"), F.col("j").cast("int")
    each = (doc_units.select("doc_id", _offset(doc_units).alias("_o"), "toks", "tags", F.explode_outer("units").alias("u")).filter("u IS NOT NULL")
                     .select("doc_id", "_o", "toks", "tags", "u", F.explode(F.sequence(u["pos"], u["pos"] + u["n"] - 1)).alias("j")))
    at = (o + F.col("j")).cast("long")
    return each.select("doc_id", at.alias("token_idx"), F.get("toks", j).alias("token"), F.get("tags", j).alias("pos_tag"),
                       u["tag"].alias("ds_tag"), at.alias("pos_id"), (o + u["pos"]).alias("ds_id")).select(*TOKEN_COLUMNS)


def unit_text(u: Column) -> Column:
    """Raw text of a unit of a document row."""
    return F.when(u["n"] == 1, F.get("toks", u["pos"].cast("int"))).otherwise(
        F.array_join(F.slice("toks", (u["pos"] + 1).cast("int"), u["n"]), ""))


def ds_units_from_documents(doc_units: DataFrame) -> DataFrame:
    """DS unit rows (doc_id, unit_id, Tag, pos, utext, Token) straight from the
    document arrays: no grouping shuffle."""
    u = F.col("u")
    at = F.col("_o") + u["pos"]
    return (doc_units.select("doc_id", _offset(doc_units).alias("_o"), "toks", F.explode_outer("units").alias("u"))
                     .filter("u IS NOT NULL").select("doc_id", at.alias("unit_id"), u["tag"].alias("Tag"), at.alias("pos"),
                             unit_text(u).alias("utext"), u["key"].alias("Token")))


def document_units(docs: DataFrame, lexicon: dict[str, str] | None = None, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, n, toks, low, tags, units[, _off, _seg]) per document (segment) row."""
    return with_ds_units(document_rows(docs, tagger), lexicon)
