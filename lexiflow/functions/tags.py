"""Tag vocabularies and tag rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# Special tags.
PUNCT_TAG = "Y"
UNCLASSIFIED_TAG = "FU"
UNTAGGED = "Untagged"
OTHER = "Other"

# Simplified part-of-speech classes, first matching pattern wins.
SIMPLE_TAG_RULES = [
    (r"^NN\S*$", "NounCommon"),
    (r"^VV\S*$", "VerbLex"),
    (r"^J\S*$", "Adjective"),
    (r"^R\S*$", "Adverb"),
    (r"^P\S*$", "Pronoun"),
    (r"^I\S*$", "Preposition"),
    (r"^C\S*$", "Conjunction"),
    (r"^N\S*$", "NounOther"),
    (r"^VB\S*$", "VerbBe"),
    (r"^V\S*$", "VerbOther"),
]

# Rhetorical tags that only the common dictionary uses; if any
# tag contains one of them the corpus was tagged with the common dictionary.
COMMON_DICTIONARY_MARKERS = ["Actors", "Organization", "Planning", "Sentiment", "Signposting", "Stance"]
COMMON_DICTIONARY = "Common Dictionary"
LARGE_DICTIONARY = "Large Dictionary"

# Tags that plots and PCA leave out.
NON_ANALYTIC_TAGS = [OTHER, UNCLASSIFIED_TAG, UNTAGGED]


def simplify_tag(tag: str | Column) -> Column:
    """Map a CLAWS-style POS tag to its lexical class; anything else -> Other."""
    c = col_(tag)
    expr = None
    for pattern, label in SIMPLE_TAG_RULES:
        cond = c.startswith(pattern[1:-len(r"\S*$")])       # (the rest of the patterns is tested once, below)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    # A tag with whitespace or an empty tag is left as it is (the rewrite
    # patterns need one or more non-space characters).
    return F.when(c.rlike(r"^\S+$"), expr.otherwise(F.lit(OTHER))).otherwise(c)


def simplify_tag_sql(tag: str) -> str:
    """The same rule as a DuckDB SQL expression (oracle side)."""
    parts = [f"WHEN regexp_matches({tag}, '{p}') THEN '{lab}'" for p, lab in SIMPLE_TAG_RULES]
    return f"(CASE {' '.join(parts)} WHEN regexp_matches({tag}, '^\\S+$') THEN 'Other' ELSE {tag} END)"
