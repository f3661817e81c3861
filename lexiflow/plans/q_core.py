"""Registered queries: tokens, tags, metadata, frequency, DTM (§2.3, §2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tags import simplify_tag, simplify_tag_sql
from ..operators import freq as fq
from ..operators import trained_tagger
from ..operators.langid import fold_of
from . import oracle as O
from .catalog import ALL, corpus, register, rounded

U_POS = O.unit_ctes("tok", "pos", "upos", analytic=True)
U_DS = O.unit_ctes("tok", "ds", "uds")
ND = O.ndocs_sql("tok")


def _freq_sql(units: str, per: str) -> str:
    return O.with_(ALL + (U_POS if units == "upos" else U_DS) + [
        f"base AS (SELECT doc_id, Token, Tag, count(*) AS n FROM {units} GROUP BY doc_id, Token, Tag)"],
        f"SELECT Token, Tag, CAST(sum(n) AS BIGINT) AS AF, "
        f"{O.r(f'sum(n) / (SELECT sum(n) FROM base) * {per}')} AS RF, "
        f"{O.r(f'count(*) * 100.0 / {ND}')} AS Range FROM base GROUP BY Token, Tag")


def _tags_sql(units: str, tag_expr: str = "Tag") -> str:
    return O.with_(ALL + (U_POS if units == "upos" else U_DS) + [
        f"base AS (SELECT doc_id, {tag_expr} AS Tag, count(*) AS n FROM {units} GROUP BY ALL)"],
        f"SELECT Tag, CAST(sum(n) AS BIGINT) AS AF, {O.r('sum(n) / (SELECT sum(n) FROM base) * 100.0')} AS RF, "
        f"{O.r(f'count(*) * 100.0 / {ND}')} AS Range FROM base GROUP BY Tag")


@register("tokenize", O.with_(ALL, "SELECT doc_id, token_idx, token FROM tok"))
def tokenize(spark, sf):
    return corpus(spark, sf).tokens.select("doc_id", "token_idx", "token")


#: No twin (a Viterbi per document); held against a plain Viterbi in the tests.
@register("pos_tag_trained")
def pos_tag_trained(spark, sf):
    rows = corpus(spark, sf).rows
    return trained_tagger.tag_agreement(rows, fold_of(F.col("doc_id")))


@register("pos_tag", O.with_(ALL, "SELECT doc_id, token_idx, pos_tag, pos_id FROM tok"))
def pos_tag(spark, sf):
    return corpus(spark, sf).tokens.select("doc_id", "token_idx", "pos_tag", "pos_id")


@register("ds_phrase_tag", O.with_(ALL, "SELECT doc_id, token_idx, ds_tag, ds_id FROM tok"))
def ds_phrase_tag(spark, sf):
    return corpus(spark, sf).tokens.select("doc_id", "token_idx", "ds_tag", "ds_id")


@register("token_units", O.with_(ALL + O.unit_ctes("tok", "ds", "u"),
                                 "SELECT doc_id, unit_id, Tag, pos, utext, Token FROM u"))
def token_units(spark, sf):
    return corpus(spark, sf).units("ds")


@register("token_freq_pos", _freq_sql("upos", "1000000.0"))
def token_freq_pos(spark, sf):
    return rounded(corpus(spark, sf).frequency("pos"))


@register("token_freq_ds", _freq_sql("uds", "1000000.0"))
def token_freq_ds(spark, sf):
    return rounded(corpus(spark, sf).frequency("ds"))


@register("tag_freq_pos", _tags_sql("upos"))
def tag_freq_pos(spark, sf):
    return rounded(corpus(spark, sf).tags("pos"))


@register("tag_freq_ds", _tags_sql("uds"))
def tag_freq_ds(spark, sf):
    return rounded(corpus(spark, sf).tags("ds"))


@register("dtm_pos", O.with_(ALL + U_POS, "SELECT doc_id, Tag, CAST(count(*) AS BIGINT) AS n FROM upos GROUP BY doc_id, Tag"))
def dtm_pos(spark, sf):
    return corpus(spark, sf).dtm("pos")


@register("dtm_ds", O.with_(ALL + U_DS, "SELECT doc_id, Tag, CAST(count(*) AS BIGINT) AS n FROM uds GROUP BY doc_id, Tag"))
def dtm_ds(spark, sf):
    return corpus(spark, sf).dtm("ds")


@register("freq_simplify", O.with_(ALL + U_POS + [
    "base AS (SELECT doc_id, Token, Tag, count(*) AS n FROM upos GROUP BY doc_id, Token, Tag)"],
    f"SELECT Token, {simplify_tag_sql('Tag')} AS Tag, CAST(sum(n) AS BIGINT) AS AF, "
    f"{O.r('sum(n) / (SELECT sum(n) FROM base) * 1000000.0')} AS RF, "
    f"{O.r(f'count(*) * 100.0 / {ND}')} AS Range FROM base GROUP BY Token, base.Tag"))
def freq_simplify(spark, sf):
    return rounded(fq.freq_simplify(corpus(spark, sf).frequency("pos")))


@register("freq_simplify_agg", O.with_(ALL + U_POS + [
    f"base AS (SELECT doc_id, Token, {simplify_tag_sql('Tag')} AS Tag, count(*) AS n FROM upos GROUP BY ALL)"],
    f"SELECT Token, Tag, CAST(sum(n) AS BIGINT) AS AF, "
    f"{O.r('sum(n) / (SELECT sum(n) FROM base) * 1000000.0')} AS RF, "
    f"{O.r(f'count(*) * 100.0 / {ND}')} AS Range FROM base GROUP BY Token, Tag"))
def freq_simplify_agg(spark, sf):
    return rounded(corpus(spark, sf).simplified_frequency())


@register("tags_simplify", _tags_sql("upos", simplify_tag_sql("Tag")))
def tags_simplify(spark, sf):
    c = corpus(spark, sf)
    return rounded(fq.tags_simplify(c.dtm("pos"), c.ndocs()))


@register("dtm_simplify", O.with_(ALL + U_POS,
    f"SELECT doc_id, {simplify_tag_sql('Tag')} AS Tag, CAST(count(*) AS BIGINT) AS n FROM upos GROUP BY ALL"))
def dtm_simplify(spark, sf):
    return fq.dtm_simplify(corpus(spark, sf).dtm("pos"))


@register("corpus_summary", O.with_(ALL + O.unit_ctes("tok", "pos", "up") + O.unit_ctes("tok", "ds", "ud"),
    "SELECT (SELECT count(*) FROM up WHERE Tag <> 'Y') AS tokens_pos, "
    f"(SELECT count(*) FROM ud WHERE NOT {O.punct_unit_sql('ds')}) AS tokens_ds, "
    "(SELECT count(DISTINCT doc_id) FROM tok) AS ndocs, "
    "(SELECT CASE WHEN bool_or(regexp_matches(ds_tag, 'Actors|Organization|Planning|Sentiment|Signposting|Stance')) "
    "THEN 'Common Dictionary' ELSE 'Large Dictionary' END FROM tok) AS model, "
    "(SELECT list_sort(list(DISTINCT ds_tag) FILTER (WHERE ds_tag <> 'Untagged')) FROM tok) AS tags_ds, "
    "(SELECT list_sort(list(DISTINCT pos_tag) FILTER (WHERE pos_tag <> 'Y')) FROM tok) AS tags_pos"))
def corpus_summary(spark, sf):
    return corpus(spark, sf).summary()


# --- SQL surface and table lookup (§2.13, §2.14) ---------------------------
from ..functions.tags import simplify_tag_sql as _simp  # noqa: E402
from .views import register_views, table_by_name  # noqa: E402


@register("sql_surface", O.with_(ALL + U_POS + [
    "base AS (SELECT doc_id, Token, Tag, count(*) AS n FROM upos GROUP BY ALL)"],
    "SELECT Tag, CAST(sum(n) AS BIGINT) AS AF, count(DISTINCT Token) AS types FROM base GROUP BY Tag"))
def sql_surface(spark, sf):
    register_views(corpus(spark, sf), prefix="lf_")
    return spark.sql("SELECT Tag, CAST(sum(AF) AS BIGINT) AS AF, count(*) AS types FROM lf_ft_pos GROUP BY Tag")


@register("table_by_name", O.with_(ALL + U_POS + [
    f"s AS (SELECT doc_id, {_simp('Tag')} AS Tag, count(*) AS n FROM upos GROUP BY ALL)",
    "sd AS (SELECT DISTINCT doc_id FROM s)", "st AS (SELECT DISTINCT Tag FROM s)",
    "dn AS (SELECT sd.doc_id, st.Tag, coalesce(s.n, 0) AS n FROM sd CROSS JOIN st LEFT JOIN s ON s.doc_id = sd.doc_id AND s.Tag = st.Tag)"],
    "SELECT doc_id, split_part(doc_id, '_', 1) AS \"Group\", Tag, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS RF FROM dn"))
def table_by_name_q(spark, sf):
    return rounded(table_by_name(corpus(spark, sf), "Document-Term Matrix: Parts-of-Speech Simplified", "Grouped"))
