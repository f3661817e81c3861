"""Registered queries: DTM weighting and reshaping, grouped tables, box /
scatter data, correlation, trend, PCA (§2.4, §2.8, §2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import student_t_p_sql
from ..functions.tags import SIMPLE_TAG_RULES, simplify_tag_sql
from ..functions.text import first_segment
from ..operators import freq as fq
from ..operators import groupstats as G
from ..operators import pca as P
from . import oracle as O
from ..storage import materialize
from .catalog import ALL, corpus, register, rounded

SIMPLE_TAGS = sorted({lab for _, lab in SIMPLE_TAG_RULES} | {"Other"})
GRP_A = [f"src{i}" for i in range(0, 5)]
GRP_B = [f"src{i}" for i in range(5, 10)]
BOX_TAGS = ["Adjective", "NounCommon", "VerbLex"]
X, Y = "NounCommon", "VerbLex"
SIMP = simplify_tag_sql("Tag")
CAT = "split_part(doc_id, '_', 1)"

U_POS = O.unit_ctes("tok", "pos", "upos", analytic=True)
BASE = ALL + U_POS + [
    "dtm AS (SELECT doc_id, Tag, count(*) AS n FROM upos GROUP BY doc_id, Tag)",
    f"dtm_s AS (SELECT doc_id, {SIMP} AS Tag, count(*) AS n FROM upos GROUP BY ALL)",
    "d1 AS (SELECT * FROM dtm_s WHERE Tag NOT IN ('Other', 'FU', 'Untagged'))",
    "prop AS (SELECT doc_id, Tag, n / sum(n) OVER (PARTITION BY doc_id) AS RF FROM d1)",
    "dd AS (SELECT DISTINCT doc_id FROM d1)", "dt AS (SELECT DISTINCT Tag FROM d1)",
    "dense AS (SELECT dd.doc_id, dt.Tag, coalesce(prop.RF, 0.0) AS RF FROM dd CROSS JOIN dt "
    "LEFT JOIN prop ON prop.doc_id = dd.doc_id AND prop.Tag = dt.Tag)",
    f"box AS (SELECT doc_id, Tag, RF * 100 AS RF FROM dense WHERE Tag IN {O.in_list(BOX_TAGS)})",
    f"boxg AS (SELECT *, CASE WHEN {CAT} IN {O.in_list(GRP_A)} THEN {O.q(', '.join(GRP_A))} "
    f"WHEN {CAT} IN {O.in_list(GRP_B)} THEN {O.q(', '.join(GRP_B))} END AS \"Group\" FROM box)",
    f"wide AS (SELECT doc_id, coalesce(max(RF) FILTER (WHERE Tag = '{X}'), 0) * 100 AS {X}, "
    f"coalesce(max(RF) FILTER (WHERE Tag = '{Y}'), 0) * 100 AS {Y} FROM dense GROUP BY doc_id)",
    f"wideg AS (SELECT *, {CAT} AS \"Group\" FROM wide)",
]


def S(final: str, extra: list[str] | None = None) -> str:
    return O.with_(BASE + (extra or []), final)


def _c(spark, sf):
    return corpus(spark, sf)


def _dtm(c):
    """The POS document-term matrix (docs x tags, small next to the tokens),
    written once to the checkpoint folder: the statistics below read it in
    several passes (tag list, pivots, quantile ranks, ML fits) without
    re-tokenizing."""
    return materialize(c.dtm("pos"), "dtm-pos")


def dense_prop_simple(c):
    """Simplified POS DTM, non-analytic columns dropped BEFORE weighting, row
    proportions, zero-filled (pivot over the present tags)."""
    d = fq.drop_non_analytic(fq.dtm_simplify(_dtm(c)))
    return fq.dtm_dense(fq.dtm_weight_prop(d).select("doc_id", "Tag", "RF"), value="RF")


@register("dtm_weight_prop", S(f"SELECT doc_id, Tag, {O.r('n / sum(n) OVER (PARTITION BY doc_id)')} AS RF FROM dtm"))
def dtm_weight_prop(spark, sf):
    return rounded(fq.dtm_weight_prop(_c(spark, sf).dtm("pos")).select("doc_id", "Tag", "RF"))


@register("dtm_weight_scale", S(
    "SELECT doc_id, Tag, round(CASE WHEN s IS NULL OR s = 0 THEN 0.0 ELSE (RF - m) / s END, 6) AS Z FROM "
    "(SELECT *, avg(RF) OVER (PARTITION BY Tag) AS m, stddev_samp(RF) OVER (PARTITION BY Tag) AS s FROM dz)",
    ["pp AS (SELECT doc_id, Tag, n / sum(n) OVER (PARTITION BY doc_id) AS RF FROM dtm)",
     "zd AS (SELECT DISTINCT doc_id FROM dtm)", "zt AS (SELECT DISTINCT Tag FROM dtm)",
     "dz AS (SELECT zd.doc_id, zt.Tag, coalesce(pp.RF, 0.0) AS RF FROM zd CROSS JOIN zt LEFT JOIN pp "
     "ON pp.doc_id = zd.doc_id AND pp.Tag = zt.Tag)"]))
def dtm_weight_scale(spark, sf):
    dense = fq.dtm_dense(fq.dtm_weight_prop(_dtm(_c(spark, sf))).select("doc_id", "Tag", "RF"), value="RF")
    return rounded(fq.dtm_weight_scale(dense, "RF", "Z").select("doc_id", "Tag", "Z"))


@register("dtm_long", S(f"SELECT doc_id, {CAT} AS \"Group\", Tag, {O.r('n / sum(n) OVER (PARTITION BY doc_id)')} AS RF FROM dtm_s"))
def dtm_long(spark, sf):
    d = fq.dtm_weight_prop(fq.dtm_simplify(_c(spark, sf).dtm("pos")))
    return rounded(fq.with_group(d).select("doc_id", "Group", "Tag", "RF"))


@register("dtm_pivot", S("SELECT doc_id, " + ", ".join(
    f"round(coalesce(max(RF) FILTER (WHERE Tag = '{t}'), 0.0), 6) AS {t}" for t in SIMPLE_TAGS) + " FROM pp2 GROUP BY doc_id",
    ["pp2 AS (SELECT doc_id, Tag, n / sum(n) OVER (PARTITION BY doc_id) AS RF FROM dtm_s)"]))
def dtm_pivot(spark, sf):
    d = fq.dtm_weight_prop(fq.dtm_simplify(_c(spark, sf).dtm("pos")))
    return rounded(fq.dtm_wide(d, SIMPLE_TAGS, value="RF"))


G_EXTRA = ["gd AS (SELECT DISTINCT doc_id FROM dtm)", "gt AS (SELECT DISTINCT Tag FROM dtm)",
           f"gdense AS (SELECT gd.doc_id, {CAT.replace('doc_id', 'gd.doc_id')} AS \"Group\", gt.Tag, coalesce(dtm.n, 0) AS n "
           "FROM gd CROSS JOIN gt LEFT JOIN dtm ON dtm.doc_id = gd.doc_id AND dtm.Tag = gt.Tag)",
           "gtot AS (SELECT \"Group\", sum(n) AS gt FROM gdense GROUP BY \"Group\")",
           "gtab AS (SELECT Tag, g.\"Group\", CAST(sum(n) AS BIGINT) AS AF, sum(n) / any_value(gt) AS RF, "
           "count(*) FILTER (WHERE n > 0) * 100.0 / count(*) AS Range FROM gdense g JOIN gtot USING (\"Group\") GROUP BY Tag, g.\"Group\")"]


def _grouped_dense(c):
    return fq.with_group(fq.dtm_dense(_dtm(c)))


@register("tags_table_grouped", S(f"SELECT Tag, \"Group\", AF, {O.r('RF')} AS RF, {O.r('Range')} AS Range FROM gtab", G_EXTRA))
def tags_table_grouped(spark, sf):
    return rounded(fq.tags_table_grouped(_grouped_dense(_c(spark, sf))))


@register("make_percent", S(f"SELECT Tag, \"Group\", AF, {O.r('RF * 100')} AS RF, {O.r('Range')} AS Range FROM gtab", G_EXTRA))
def make_percent(spark, sf):
    return rounded(fq.make_percent(fq.tags_table_grouped(_grouped_dense(_c(spark, sf)))))


@register("dtm_simplify_grouped", S(
    "SELECT sd.doc_id, " + CAT.replace("doc_id", "sd.doc_id") + " AS \"Group\", st.Tag, CAST(coalesce(dtm_s.n, 0) AS BIGINT) AS n "
    "FROM sd CROSS JOIN st LEFT JOIN dtm_s ON dtm_s.doc_id = sd.doc_id AND dtm_s.Tag = st.Tag",
    ["sd AS (SELECT DISTINCT doc_id FROM dtm_s)", "st AS (SELECT DISTINCT Tag FROM dtm_s)"]))
def dtm_simplify_grouped(spark, sf):
    d = fq.dtm_dense(fq.dtm_simplify(_dtm(_c(spark, sf))))
    return fq.with_group(d).select("doc_id", "Group", "Tag", F.col("n").cast("long").alias("n"))


@register("box_data", S(f"SELECT doc_id, Tag, {O.r('RF')} AS RF, {O.r('quantile_cont(RF, 0.5) OVER (PARTITION BY Tag)')} AS Median FROM box"))
def box_data(spark, sf):
    return rounded(G.box_data(dense_prop_simple(_c(spark, sf)), BOX_TAGS))


@register("box_data_grouped", S(f"SELECT doc_id, Tag, {O.r('RF')} AS RF, \"Group\", "
                                f"{O.r('quantile_cont(RF, 0.5) OVER (PARTITION BY \"Group\", Tag)')} AS Median FROM boxg WHERE \"Group\" IS NOT NULL"))
def box_data_grouped(spark, sf):
    return rounded(G.box_data_grouped(dense_prop_simple(_c(spark, sf)), BOX_TAGS, GRP_A, GRP_B))


def _stats_sql(src: str, keys: str) -> str:
    return S(f"SELECT {keys}, count(*) AS count, {O.r('avg(RF)')} AS mean, {O.r('quantile_cont(RF, 0.5)')} AS median, "
             f"{O.r('stddev_samp(RF)')} AS std, {O.r('min(RF)')} AS min, {O.r('quantile_cont(RF, 0.25)')} AS q25, "
             f"{O.r('quantile_cont(RF, 0.75)')} AS q75, {O.r('max(RF)')} AS max FROM {src} GROUP BY {keys}")


@register("box_stats", _stats_sql("box", "Tag"))
def box_stats(spark, sf):
    return rounded(G.box_stats(G.box_values(dense_prop_simple(_c(spark, sf)), BOX_TAGS), ["Tag"]))


@register("box_stats_grouped", _stats_sql("(SELECT * FROM boxg WHERE \"Group\" IS NOT NULL)", "\"Group\", Tag"))
def box_stats_grouped(spark, sf):
    return rounded(G.box_stats(G.box_values(dense_prop_simple(_c(spark, sf)), BOX_TAGS, GRP_A, GRP_B), ["Group", "Tag"]))


@register("box_hover_stats", S(f"SELECT Tag, {O.r('avg(RF)')} AS mean, {O.r('quantile_cont(RF, 0.5)')} AS median, "
                               f"{O.r('quantile_cont(RF, 0.75) - quantile_cont(RF, 0.25)')} AS iqr, {O.r('min(RF)')} AS min, "
                               f"{O.r('max(RF)')} AS max FROM box GROUP BY Tag"))
def box_hover_stats(spark, sf):
    return rounded(G.box_hover_stats(G.box_values(dense_prop_simple(_c(spark, sf)), BOX_TAGS), ["Tag"]))


@register("scatter_data", S(f"SELECT doc_id, {O.r(X)} AS {X}, {O.r(Y)} AS {Y} FROM wide"))
def scatter_data(spark, sf):
    return rounded(G.scatter_data(dense_prop_simple(_c(spark, sf)), X, Y))


@register("scatter_data_grouped", S(f"SELECT doc_id, {O.r(X)} AS {X}, {O.r(Y)} AS {Y}, \"Group\" FROM wideg"))
def scatter_data_grouped(spark, sf):
    return rounded(G.scatter_data_grouped(dense_prop_simple(_c(spark, sf)), X, Y))


@register("scatter_axis_share", S(
    f"SELECT doc_id, round(coalesce(max(RF) FILTER (WHERE Tag = '{X}'), 0.0), 6) AS {X}, "
    f"round(coalesce(max(RF) FILTER (WHERE Tag = '{Y}'), 0.0), 6) AS {Y}, {CAT} AS \"Group\" FROM sh WHERE Tag <> 'Other' GROUP BY doc_id",
    [f"fo AS (SELECT doc_id, CASE WHEN Tag IN ('{X}', '{Y}') THEN Tag ELSE 'Other' END AS Tag, sum(n) AS n FROM dtm_s GROUP BY ALL)",
     "sh AS (SELECT doc_id, Tag, n / sum(n) OVER (PARTITION BY doc_id) * 100 AS RF FROM fo)"]))
def scatter_axis_share(spark, sf):
    return rounded(G.scatter_axis_share(fq.dtm_simplify(_dtm(_c(spark, sf))), [X, Y]))


@register("pearson", S(f"SELECT round(corr({X}, {Y}), 3) AS r, count(*) - 2 AS df FROM wide"))
def pearson(spark, sf):
    return G.pearson(G.scatter_data(dense_prop_simple(_c(spark, sf)), X, Y), X, Y)


@register("pearson_p", S("SELECT round(r, 3) AS r, n - 2 AS df, round(" + student_t_p_sql("r", "n") + ", 5) AS p FROM "
                        f"(SELECT corr({X}, {Y}) AS r, count(*) AS n FROM wide)"))
def pearson_p(spark, sf):
    return G.pearson_p(G.scatter_data(dense_prop_simple(_c(spark, sf)), X, Y), X, Y)


@register("pearson_groups", S(
    "SELECT highlight, CASE WHEN n > 2 THEN round(r, 3) END AS r, CASE WHEN n > 2 THEN n - 2 END AS df, "
    "CASE WHEN n > 2 THEN round(" + student_t_p_sql("r", "n") + ", 5) END AS p FROM "
    f"(SELECT highlight, corr({X}, {Y}) AS r, count(*) AS n FROM "
    f"(SELECT *, \"Group\" IN {O.in_list(GRP_A)} AS highlight FROM wideg) GROUP BY highlight)"))
def pearson_groups(spark, sf):
    w = G.scatter_data_grouped(dense_prop_simple(_c(spark, sf)), X, Y)
    return G.pearson_groups(w, X, Y, GRP_A)


@register("correlation_matrix", S(
    "SELECT a.Tag AS tag_a, b.Tag AS tag_b, round(CASE WHEN var_pop(a.RF) > 0 AND var_pop(b.RF) > 0 THEN corr(a.RF, b.RF) END, 6) AS r "
    "FROM dall a JOIN dall b ON a.doc_id = b.doc_id AND a.Tag < b.Tag GROUP BY a.Tag, b.Tag",
    ["ad AS (SELECT * FROM dtm WHERE Tag NOT IN ('Other', 'FU', 'Untagged'))",
     "ap AS (SELECT doc_id, Tag, n / sum(n) OVER (PARTITION BY doc_id) AS RF FROM ad)",
     "adoc AS (SELECT DISTINCT doc_id FROM ad)", "atag AS (SELECT DISTINCT Tag FROM ad)",
     "dall AS (SELECT adoc.doc_id, atag.Tag, coalesce(ap.RF, 0.0) AS RF FROM adoc CROSS JOIN atag "
     "LEFT JOIN ap ON ap.doc_id = adoc.doc_id AND ap.Tag = atag.Tag)"]))
def correlation_matrix(spark, sf):
    """Over all tags, not only their simplified classes."""
    d = fq.dtm_weight_prop(fq.drop_non_analytic(_dtm(_c(spark, sf)))).select("doc_id", "Tag", "RF")
    tags = sorted(r[0] for r in d.select("Tag").distinct().collect())   # closed tagset, bounded
    return rounded(G.correlation_matrix(fq.dtm_wide(d, tags, value="RF"), tags))


@register("linear_trend", S(f"SELECT {O.r(f'regr_slope({Y}, {X})')} AS slope, {O.r(f'regr_intercept({Y}, {X})')} AS intercept FROM wide"))
def linear_trend(spark, sf):
    return rounded(G.linear_trend(G.scatter_data(dense_prop_simple(_c(spark, sf)), X, Y), X, Y))


@register("highlight_split", S(f"SELECT doc_id, \"Group\", \"Group\" IN ('src0', 'src1') AS highlight FROM wideg"))
def highlight_split(spark, sf):
    w = G.scatter_data_grouped(dense_prop_simple(_c(spark, sf)), X, Y)
    return G.highlight_split(w, ["src0", "src1"]).select("doc_id", "Group", "highlight")


@register("tag_bar_data", O.with_(ALL + U_POS + [
    "base AS (SELECT doc_id, Tag, count(*) AS n FROM upos GROUP BY ALL)"],
    f"SELECT Tag, CAST(sum(n) AS BIGINT) AS AF, {O.r('sum(n) / (SELECT sum(n) FROM base) * 100.0')} AS RF, "
    f"{O.r(f'count(*) * 100.0 / {O.ndocs_sql()}')} AS Range FROM base GROUP BY Tag ORDER BY RF DESC, Tag"))
def tag_bar_data(spark, sf):
    return rounded(fq.tag_bar_data(_c(spark, sf).tags("pos")))


# --- PCA: Spark ML; checked against numpy in tests, and by what all components give back ---------

PCA_SQL = [
    "pa AS (SELECT doc_id, Tag, n / sum(n) OVER (PARTITION BY doc_id) AS RF FROM dtm_s)",
    "pd AS (SELECT a.doc_id, t.Tag, coalesce(pa.RF, 0.0) AS RF FROM (SELECT DISTINCT doc_id FROM pa) a "
    "CROSS JOIN (SELECT DISTINCT Tag FROM pa) t LEFT JOIN pa ON pa.doc_id = a.doc_id AND pa.Tag = t.Tag)",
    "pz AS (SELECT doc_id, Tag, CASE WHEN s IS NULL OR s = 0 THEN 0.0 ELSE (RF - m) / s END AS Z FROM (SELECT *, "
    "avg(RF) OVER (PARTITION BY Tag) AS m, stddev_samp(RF) OVER (PARTITION BY Tag) AS s FROM pd) "
    "WHERE Tag NOT IN ('Other', 'FU', 'Untagged'))",
]


def pca_input(c):
    """dtm_pos -> simplify -> prop -> scale; drop Other/FU/Untagged AFTER
    scaling; wide with Group."""
    d = fq.dtm_simplify(_dtm(c))
    dense = fq.dtm_dense(fq.dtm_weight_prop(d).select("doc_id", "Tag", "RF"), value="RF")
    z = fq.drop_non_analytic(fq.dtm_weight_scale(dense, "RF", "Z"))
    tags = sorted(r[0] for r in z.select("Tag").distinct().collect())   # closed tagset
    wide = z.groupBy("doc_id").pivot("Tag", tags).agg(F.first("Z")).na.fill(0.0)
    # the PCA fit makes several passes: read them from one written table
    return materialize(wide.withColumn("Group", first_segment("doc_id")), "pca-input"), tags


@register("pca_scores")
def pca_scores(spark, sf):
    wide, tags = pca_input(_c(spark, sf))
    return rounded(P.pca_scores(wide, tags, min(len(tags), wide.count())))


@register("pca_variance")
def pca_variance(spark, sf):
    wide, tags = pca_input(_c(spark, sf))
    return rounded(P.pca_variance(wide, tags))


@register("pca_contrib")
def pca_contrib(spark, sf):
    wide, tags = pca_input(_c(spark, sf))
    return rounded(P.pca_contrib(wide, tags))


@register("pca_top_contrib")
def pca_top_contrib(spark, sf):
    wide, tags = pca_input(_c(spark, sf))
    return P.pca_top_contrib(P.pca_contrib(wide, tags), ["PC1", "PC2"])


@register("pca_contrib_bar")
def pca_contrib_bar(spark, sf):
    wide, tags = pca_input(_c(spark, sf))
    return rounded(P.pca_contrib_bar(P.pca_contrib(wide, tags), "PC1", "PC2"))


@register("pca_reconstruction", S(f"SELECT a.Tag AS Tag_a, b.Tag AS Tag_b, {O.r('covar_samp(a.Z, b.Z)')} + 0.0 AS cov "
                                  "FROM pz a JOIN pz b ON a.doc_id = b.doc_id GROUP BY a.Tag, b.Tag", PCA_SQL))
def pca_reconstruction(spark, sf):
    wide, tags = pca_input(_c(spark, sf))
    return P.pca_reconstruction(wide, tags).withColumn("cov", F.round("cov", O.ROUND) + F.lit(0.0))


@register("pca_score_norms", S(f"SELECT doc_id, {O.r('sum(Z * Z)')} AS norm2 FROM pz GROUP BY doc_id", PCA_SQL))
def pca_score_norms(spark, sf):
    wide, tags = pca_input(_c(spark, sf))
    return rounded(P.pca_score_norms(P.pca_scores(wide, tags)))
