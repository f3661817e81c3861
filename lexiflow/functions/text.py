"""Column expressions for tokens and document ids (JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (pinned tokenizer, SURVEY D1): a word with inner apostrophes, a
# run of digits, or one other non-space character; trailing whitespace stays on
# the token so that concatenating tokens rebuilds the text.
TOKEN_PATTERN = r"(?:\p{L}+(?:['’]\p{L}+)*|\p{N}+|[^\s\p{L}\p{N}])\s*"
# The word and number alternatives of the same pattern (tokens that are not
# punctuation).
WORD_OR_NUMBER_PATTERN = r"\p{L}+(?:['’]\p{L}+)*|\p{N}+"
# A unit made only of ASCII punctuation and spaces (metadata filter for DS units).
PUNCT_SPACE_PATTERN = r"^[\p{Punct} ]+\z"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters that ``\s`` stands for.
WHITESPACE = " \t\n\x0b\f\r"


def rstrip_ws(c: str | Column) -> Column:
    return F.rtrim(col_(c), F.lit(WHITESPACE))


def strip_ws(c: str | Column) -> Column:
    return F.trim(col_(c), F.lit(WHITESPACE))


def token_array(text: str | Column) -> Column:
    """Ordered token strings of a text (trailing whitespace kept per token)."""
    return F.regexp_extract_all(rstrip_ws(text), F.lit(TOKEN_PATTERN), 0)


def surface(token: str | Column) -> Column:
    """Token without its trailing whitespace (D2)."""
    return rstrip_ws(token)


def norm(token: str | Column) -> Column:
    """Lower-cased surface: the key of frequency, n-gram, collocation, KWIC."""
    return F.lower(rstrip_ws(token))


def category(doc_id: str | Column) -> Column:
    """Category of a document id: the id with its last ``_<non-space>`` run removed
    (document categories, corpus metadata)."""
    return F.regexp_replace(col_(doc_id), r"_\S+$", "")


def first_segment(doc_id: str | Column) -> Column:
    """Text before the first ``_`` (subsetting, grouped scatter and box plots)."""
    return F.split(col_(doc_id), "_", 2).getItem(0)
