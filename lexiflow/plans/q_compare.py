"""Registered queries: keyness and comparison views (§2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import LL_CRITICAL, erfc_sql
from ..functions.text import first_segment
from ..operators import keyness as K
from ..operators.units import is_punct_unit
from ..sources.documents import REFERENCE_SOURCES, TARGET_SOURCES
from . import oracle as O
from .catalog import ALL, corpus, reference, register, rounded, target

PART_TAR = [f"src{i}" for i in range(0, 6)]     # src5 is on both sides on purpose
PART_REF = [f"src{i}" for i in range(5, 10)]


def _units_sql(kind: str) -> list[str]:
    return O.unit_ctes("tok", kind, "u0", analytic=True)


def keyness_sql(kind: str, tags_only: bool, threshold: float = 0.05, direction: str = "positive",
                tar=TARGET_SOURCES, ref=REFERENCE_SOURCES, swap: bool = False) -> str:
    keys = "Tag" if tags_only else "Token, Tag"
    per = "100.0" if tags_only else "1000000.0"
    cat = "split_part(doc_id, '_', 1)"
    t_in, r_in = O.in_list(tar), O.in_list(ref)
    if swap:
        t_in, r_in = r_in, t_in
    ctes = ALL + _units_sql(kind) + [
        f"u AS (SELECT doc_id, {keys}, true AS t FROM u0 WHERE {cat} IN {t_in} "
        f"UNION ALL SELECT doc_id, {keys}, false AS t FROM u0 WHERE {cat} IN {r_in})",
        f"base AS (SELECT t, doc_id, {keys}, count(*) AS n FROM u GROUP BY ALL)",
        f"c AS (SELECT {keys}, CAST(sum(CASE WHEN t THEN n ELSE 0 END) AS BIGINT) AS AF, "
        f"CAST(sum(CASE WHEN NOT t THEN n ELSE 0 END) AS BIGINT) AS AF_Ref, "
        f"count(*) FILTER (WHERE t) AS D, count(*) FILTER (WHERE NOT t) AS D_Ref FROM base GROUP BY {keys})",
        "tot AS (SELECT CAST(sum(AF) AS DOUBLE) AS n1, CAST(sum(AF_Ref) AS DOUBLE) AS n2 FROM c)",
        f"nd AS (SELECT count(DISTINCT doc_id) FILTER (WHERE {cat} IN {t_in}) AS d1, "
        f"count(DISTINCT doc_id) FILTER (WHERE {cat} IN {r_in}) AS d2 FROM tok)",
        "e AS (SELECT c.*, tot.*, nd.*, CAST(AF AS DOUBLE) AS o1, CAST(AF_Ref AS DOUBLE) AS o2 FROM c, tot, nd)",
        "g AS (SELECT *, 2.0 * ((CASE WHEN o1 > 0 THEN o1 * ln(o1 / (n1 * (o1 + o2) / (n1 + n2))) ELSE 0 END) + "
        "(CASE WHEN o2 > 0 THEN o2 * ln(o2 / (n2 * (o1 + o2) / (n1 + n2))) ELSE 0 END)) AS g2 FROM e)",
        "s AS (SELECT *, CASE WHEN o1 / n1 < o2 / n2 THEN -g2 ELSE g2 END AS LL, "
        "log2((greatest(o1, 0.5) / n1) / (greatest(o2, 0.5) / n2)) AS LR FROM g)",
    ]
    if threshold in LL_CRITICAL:
        keep = f"abs(LL) > {LL_CRITICAL[threshold]!r}"
    else:
        keep = f"{erfc_sql('sqrt(abs(LL) / 2.0)')} < {threshold!r}"
    if direction == "positive":
        keep += " AND LL > 0"
    final = (f"SELECT {keys}, {O.r('LL')} AS LL, {O.r('LR')} AS LR, {O.r(erfc_sql('sqrt(abs(LL) / 2.0)'))} AS PV, "
             f"{O.r(f'o1 / n1 * {per}')} AS RF, {O.r(f'o2 / n2 * {per}')} AS RF_Ref, AF, AF_Ref, "
             f"{O.r('D * 100.0 / d1')} AS Range, {O.r('D_Ref * 100.0 / d2')} AS Range_Ref FROM s WHERE {keep}")
    return O.with_(ctes, final)


def _keyness(spark, sf, kind, tags_only, threshold=0.05, direction="positive", swap=False):
    return rounded(target(spark, sf).keyness(reference(spark, sf), kind, tags_only, threshold=threshold, direction=direction,
                                             swap_target=swap))


@register("keyness_tokens_pos", keyness_sql("pos", False))
def keyness_tokens_pos(spark, sf):
    return _keyness(spark, sf, "pos", False)


@register("keyness_tokens_ds", keyness_sql("ds", False))
def keyness_tokens_ds(spark, sf):
    return _keyness(spark, sf, "ds", False)


@register("keyness_tags_pos", keyness_sql("pos", True, 1.0, "both"))
def keyness_tags_pos(spark, sf):
    return _keyness(spark, sf, "pos", True, 1.0, "both")


@register("keyness_tags_ds", keyness_sql("ds", True, 1.0, "both"))
def keyness_tags_ds(spark, sf):
    return _keyness(spark, sf, "ds", True, 1.0, "both")


@register("keyness_swap", keyness_sql("pos", False, 0.01, "both", swap=True))
def keyness_swap(spark, sf):
    return _keyness(spark, sf, "pos", False, 0.01, "both", swap=True)


@register("keyness_sort", keyness_sql("pos", False, 0.001, "positive"))
def keyness_sort(spark, sf):
    return K.keyness_sort(_keyness(spark, sf, "pos", False, 0.001, "positive"), by="LR", descending=True)


def keyness_parts_table(spark, sf, kind="pos", tags_only=False):
    c = corpus(spark, sf, PART_TAR + PART_REF)
    part = lambda names: c.subset(first_segment("doc_id").isin(names))
    return rounded(part(PART_TAR).keyness(part(PART_REF), kind, tags_only))


@register("keyness_parts", keyness_sql("pos", False, tar=PART_TAR, ref=PART_REF))
def keyness_parts(spark, sf):
    return keyness_parts_table(spark, sf)


@register("keyness_parts_counts", O.with_(ALL + O.unit_ctes("tok", "pos", "up") + O.unit_ctes("tok", "ds", "ud") + [
    f"sides AS (SELECT * FROM (VALUES ('target'), ('reference')) v(side))",
    f"cats AS (SELECT 'target' AS side, unnest({[*PART_TAR]}) AS cat UNION ALL SELECT 'reference', unnest({[*PART_REF]}))"],
    "SELECT sides.side, "
    "(SELECT count(*) FROM up JOIN cats ON split_part(up.doc_id, '_', 1) = cats.cat WHERE cats.side = sides.side AND up.Tag <> 'Y') AS tokens_pos, "
    f"(SELECT count(*) FROM ud JOIN cats ON split_part(ud.doc_id, '_', 1) = cats.cat WHERE cats.side = sides.side AND NOT {O.punct_unit_sql('ds').replace('Tag', 'ud.Tag')}) AS tokens_ds, "
    "(SELECT count(DISTINCT doc_id) FROM tok JOIN cats ON split_part(tok.doc_id, '_', 1) = cats.cat WHERE cats.side = sides.side) AS ndocs "
    "FROM sides"))
def keyness_parts_counts(spark, sf):
    c = corpus(spark, sf, PART_TAR + PART_REF)
    cat = first_segment("doc_id")
    side = F.explode(F.array_compact(F.array(F.when(cat.isin(PART_TAR), F.lit("target")),
                                             F.when(cat.isin(PART_REF), F.lit("reference")))))
    pos = c.units("pos").filter(F.col("Tag") != "Y").select(side.alias("side")).groupBy("side").agg(F.count(F.lit(1)).alias("tokens_pos"))
    ds = c.units("ds").filter(~is_punct_unit("ds")).select(side.alias("side")).groupBy("side").agg(F.count(F.lit(1)).alias("tokens_ds"))
    nd = c.rows.filter("n > 0").select("doc_id", side.alias("side")).groupBy("side").agg(F.countDistinct("doc_id").alias("ndocs"))
    return pos.join(ds, "side").join(nd, "side")


@register("compare_bar_data")
def compare_bar_data(spark, sf):
    return rounded(K.compare_bar_data(_keyness(spark, sf, "pos", True, 1.0, "both")))


@register("tag_filter")
def tag_filter(spark, sf):
    return K.tag_filter(_keyness(spark, sf, "ds", True, 1.0, "both"), tags=None)


def _wrap(sql: str, final: str) -> str:
    """Turn a twin into a CTE ``k`` and select from it."""
    return f"WITH k AS ({sql}) {final}"


O_TAGS_POS = keyness_sql("pos", True, 1.0, "both")
O_TAGS_DS = keyness_sql("ds", True, 1.0, "both")
from .catalog import SQL  # noqa: E402

SQL["compare_bar_data"] = _wrap(O_TAGS_POS, "SELECT Tag, round((RF + RF_Ref) / 2.0, 6) AS Mean, 'Target' AS Corpus, RF FROM k "
                                            "UNION ALL SELECT Tag, round((RF + RF_Ref) / 2.0, 6), 'Reference', RF_Ref FROM k")
SQL["tag_filter"] = _wrap(O_TAGS_DS, "SELECT * FROM k WHERE Tag NOT IN ('FU', 'Untagged')")


# the other three corpus-parts tables (the parts view builds all four)
@register("keyness_parts_tokens_ds", keyness_sql("ds", False, tar=PART_TAR, ref=PART_REF))
def keyness_parts_tokens_ds(spark, sf):
    return keyness_parts_table(spark, sf, "ds", False)


@register("keyness_parts_tags_pos", keyness_sql("pos", True, tar=PART_TAR, ref=PART_REF))
def keyness_parts_tags_pos(spark, sf):
    return keyness_parts_table(spark, sf, "pos", True)


@register("keyness_parts_tags_ds", keyness_sql("ds", True, tar=PART_TAR, ref=PART_REF))
def keyness_parts_tags_ds(spark, sf):
    return keyness_parts_table(spark, sf, "ds", True)
