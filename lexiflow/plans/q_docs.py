"""Registered queries: document views, tagged text, sinks (§2.10, §2.11)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.tags import simplify_tag_sql
from ..operators import docview as D
from ..operators.text_counting import tabulated
from ..sinks import export as X
from ..storage import materialize, scratch_path
from . import oracle as O
from .catalog import ALL, corpus, register, rounded

STRIP = "regexp_replace(utext, '^\\s+|\\s+$', '', 'g')"


def spans_sql(kind: str, view: str) -> str:
    tag = simplify_tag_sql("Tag") if view == "simple" else "Tag"
    plain = {"pos": "Y", "simple": "Other", "ds": "Untagged"}[view]
    return O.with_(ALL + O.unit_ctes("tok", kind, "u0") + [
        f"u AS (SELECT doc_id, pos, {tag} AS Tag, {STRIP} AS token, coalesce(regexp_extract(utext, '(\\s)$', 1), '') AS ws FROM u0)",
        "e AS (SELECT *, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tag_end FROM u)"],
        f"SELECT doc_id, pos, token, Tag, CAST(tag_end - length(token) AS BIGINT) AS tag_start, CAST(tag_end AS BIGINT) AS tag_end, "
        f"CASE WHEN Tag <> '{plain}' THEN '<span class=\"' || Tag || '\">' || token || '</span>' ELSE token END || ws AS Text FROM e")


@register("doc_spans_pos", spans_sql("pos", "pos"))
def doc_spans_pos(spark, sf):
    return corpus(spark, sf).spans("pos")


@register("doc_spans_simple", spans_sql("pos", "simple"))
def doc_spans_simple(spark, sf):
    return corpus(spark, sf).spans("simple")


@register("doc_spans_ds", spans_sql("ds", "ds"))
def doc_spans_ds(spark, sf):
    return corpus(spark, sf).spans("ds")


@register("doc_html", "WITH s AS (" + spans_sql("ds", "ds") + ") SELECT doc_id, string_agg(Text, '' ORDER BY pos) AS html FROM s GROUP BY doc_id")
def doc_html(spark, sf):
    return corpus(spark, sf).html("ds")


def counts_sql(kind: str, view: str) -> str:
    tag = simplify_tag_sql("Tag") if view == "simple" else "Tag"
    plain = {"pos": "Y", "simple": "Other", "ds": "Untagged"}[view]
    return O.with_(ALL + O.unit_ctes("tok", kind, "u0") + [
        f"c AS (SELECT doc_id, Tag, count(*) AS AF FROM (SELECT doc_id, {tag} AS Tag FROM u0) WHERE Tag <> '{plain}' GROUP BY ALL)"],
        f"SELECT doc_id, Tag, AF, {O.r('AF / sum(AF) OVER (PARTITION BY doc_id) * 100')} AS RF FROM c")


@register("doc_tag_counts", counts_sql("pos", "pos"))
def doc_tag_counts(spark, sf):
    return rounded(D.doc_tag_counts(corpus(spark, sf).units("pos"), "pos"))


@register("doc_tag_counts_simple", counts_sql("pos", "simple"))
def doc_tag_counts_simple(spark, sf):
    return rounded(D.doc_tag_counts(corpus(spark, sf).units("pos"), "simple"))


@register("doc_tag_counts_ds", counts_sql("ds", "ds"))
def doc_tag_counts_ds(spark, sf):
    return rounded(D.doc_tag_counts(corpus(spark, sf).units("ds"), "ds"))


@register("doc_tag_positions", O.with_(ALL + O.unit_ctes("tok", "ds", "u0") + [
    "o AS (SELECT doc_id, pos, Tag, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM u0)"],
    f"SELECT doc_id, pos, Tag, {O.r('rn / n')} AS X FROM o WHERE Tag IN ('Narrative', 'InformationStates')"))
def doc_tag_positions(spark, sf):
    return rounded(corpus(spark, sf).tag_positions(["Narrative", "InformationStates"]))


def tagged_sql(kind: str) -> str:
    plain = "('Y', 'FU')" if kind == "pos" else "('Untagged')"
    item = f"CASE WHEN Tag IN {plain} THEN replace({STRIP}, ' ', '_') ELSE replace({STRIP}, ' ', '_') || '|' || Tag END"
    return O.with_(ALL + O.unit_ctes("tok", kind, "u0"),
                   f"SELECT doc_id, doc_id || '_tagged.txt' AS file_name, string_agg({item}, ' ' ORDER BY pos) AS text FROM u0 GROUP BY doc_id")


@register("tagged_text_pos", tagged_sql("pos"))
def tagged_text_pos(spark, sf):
    return corpus(spark, sf).tagged_text("pos")


@register("tagged_text_ds", tagged_sql("ds"))
def tagged_text_ds(spark, sf):
    return corpus(spark, sf).tagged_text("ds")


def table_counts_sql(tables: dict[str, str], formats: list[str] | None = None) -> str:
    """Row counts of the corpus tables (twin of the write-then-read sinks)."""
    ctes = ALL + O.unit_ctes("tok", "pos", "up", analytic=True) + O.unit_ctes("tok", "ds", "ud") + [
        "ft_pos AS (SELECT DISTINCT Token, Tag FROM up)", "ft_ds AS (SELECT DISTINCT Token, Tag FROM ud)",
        "tt_pos AS (SELECT DISTINCT Tag FROM up)", "tt_ds AS (SELECT DISTINCT Tag FROM ud)",
        "dtm_pos AS (SELECT DISTINCT doc_id, Tag FROM up)", "dtm_ds AS (SELECT DISTINCT doc_id, Tag FROM ud)"]
    parts = []
    for name, cte in tables.items():
        for fmt in (formats or [None]):
            fcol = f", '{fmt}' AS format" if fmt else ""
            parts.append(f"SELECT '{name}' AS \"table\"{fcol}, count(*) AS rows FROM {cte}")
    return O.with_(ctes, " UNION ALL ".join(parts))


@register("export_tokens", O.with_(ALL, "SELECT * FROM tok"))
def export_tokens(spark, sf):
    path = X.export_tokens(corpus(spark, sf), scratch_path(spark, "export-tokens"))
    return spark.read.parquet(path)


@register("export_all_tables", table_counts_sql({"ft_pos": "ft_pos", "ft_ds": "ft_ds", "tt_pos": "tt_pos", "tt_ds": "tt_ds",
                                                "dtm_pos": "dtm_pos", "dtm_ds": "dtm_ds"}, ["parquet", "csv"]))
def export_all_tables(spark, sf):
    c = corpus(spark, sf)
    c = replace(c, counted=materialize(tabulated(c.texts), "export-rows"))      # tokenized, tagged and counted once
    tables = {"ft_pos": c.frequency("pos"), "ft_ds": c.frequency("ds"), "tt_pos": c.tags("pos"),
              "tt_ds": c.tags("ds"), "dtm_pos": c.dtm("pos"), "dtm_ds": c.dtm("ds")}
    base = scratch_path(spark, "export-tables")
    pq = X.export_tables(tables, base + "/parquet", "parquet")
    csv = X.export_tables({n: spark.read.parquet(p) for n, p in pq.items()}, base + "/csv", "csv")
    parts = [spark.read.parquet(p).select(F.lit(n).alias("table"), F.lit("parquet").alias("format")) for n, p in pq.items()]
    parts += [spark.read.option("header", True).csv(p).select(F.lit(n).alias("table"), F.lit("csv").alias("format")) for n, p in csv.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table", "format").agg(F.count(F.lit(1)).alias("rows"))


@register("write_tagged_text", "WITH t AS (" + tagged_sql("pos") + ") SELECT file_name || chr(9) || text AS value FROM t")
def write_tagged_text(spark, sf):
    path = X.write_tagged_text(corpus(spark, sf).tagged_text("pos"), scratch_path(spark, "tagged"))
    return spark.read.text(path)

