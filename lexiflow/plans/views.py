"""SQL surface and table lookup by display name.

``register_views`` exposes a corpus's tables as temporary views so users can
query them with ``spark.sql``; ``table_by_name`` resolves the display names
of the stored tables to the operators that build them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import freq as fq
from ..storage import materialize
from .corpus import Corpus


def register_views(corpus: Corpus, prefix: str = "") -> list[str]:
    tables = {
        "tokens": corpus.tokens, "pos_units": corpus.units("pos"), "ds_units": corpus.units("ds"),
        "ft_pos": corpus.frequency("pos"), "ft_ds": corpus.frequency("ds"),
        "tt_pos": corpus.tags("pos"), "tt_ds": corpus.tags("ds"),
        "dtm_pos": corpus.dtm("pos"), "dtm_ds": corpus.dtm("ds"),
    }
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in tables]


# Display names of the stored tables (our wording for the
# rhetorical tagset; the part-of-speech names follow the original).
CORPUS_TABLES = {
    "Tags Table: Rhetorical Categories": "tt_ds",
    "Tags Table: Parts-of-Speech": "tt_pos",
    "Tags Table: Parts-of-Speech Simplified": "dtm_pos",
    "Document-Term Matrix: Rhetorical Categories": "dtm_ds",
    "Document-Term Matrix: Parts-of-Speech": "dtm_pos",
    "Document-Term Matrix: Parts-of-Speech Simplified": "dtm_pos",
}
KEYNESS_TABLES = {
    "Keywords: Rhetorical Categories": "kw_ds",
    "Keywords: Parts-of-Speech": "kw_pos",
    "Keywords: Parts-of-Speech Simplified": "kt_pos",   # resolves to the key-tags table, as in the original
    "Keytags: Rhetorical Categories": "kt_ds",
    "Keytags Table: Parts-of-Speech": "kt_pos",
}


def _dtm(corpus: Corpus, kind: str) -> DataFrame:
    """The document-term matrix, written once: what is made of it reads it in several passes."""
    return corpus.dtm(kind) if f"dtm_{kind}" in corpus.tables else materialize(corpus.dtm(kind), f"dtm-{kind}")


def _prop_long(dtm: DataFrame, group: bool) -> DataFrame:
    dense = fq.dtm_dense(dtm)
    p = fq.dtm_weight_prop(dense).select("doc_id", "Tag", "RF")
    return fq.with_group(p).select("doc_id", "Group", "Tag", "RF") if group else p


def table_by_name(corpus: Corpus, name: str, scope: str = "Target", reference: Corpus | None = None,
                  threshold: float = 0.05) -> DataFrame | None:
    """Scope: Target / Reference (pass the corpus itself), Grouped (Group
    from the document id), Keywords (needs ``reference``)."""
    if scope in ("Target", "Reference", "Grouped"):
        key = CORPUS_TABLES.get(name)
        if key is None:
            return None
        kind = "ds" if key.endswith("_ds") else "pos"
        simple = name.endswith("Simplified")
        if scope != "Grouped":
            if key.startswith("tt_"):
                return corpus.tags(kind)
            if name == "Tags Table: Parts-of-Speech Simplified":
                return fq.tags_simplify(corpus.dtm("pos"), corpus.ndocs())
            d = fq.dtm_simplify(_dtm(corpus, kind)) if simple else _dtm(corpus, kind)
            return _prop_long(d, group=False)
        d = fq.dtm_simplify(_dtm(corpus, kind)) if simple else _dtm(corpus, kind)
        if name.startswith("Tags Table"):
            return fq.tags_table_grouped(fq.with_group(fq.dtm_dense(d)))
        return _prop_long(d, group=True)
    if scope == "Keywords":
        key = KEYNESS_TABLES.get(name)
        if key is None or reference is None:
            return None
        kind = "ds" if key.endswith("_ds") else "pos"
        return corpus.keyness(reference, kind, tags_only=key.startswith("kt_"), threshold=threshold)
    return None
