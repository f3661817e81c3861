"""Registered queries: n-grams, clusters, collocations, KWIC (§2.5, §2.7)."""

from __future__ import annotations

from ..operators import ngrams as NG
from . import oracle as O
from .catalog import ALL, corpus, register, rounded

ND = O.ndocs_sql("tok")


def _units(kind: str) -> list[str]:
    return O.unit_ctes("tok", kind, "u0") + [f"u AS (SELECT *, {O.punct_unit_sql(kind)} AS p FROM u0)"]


def _n_units_sql(kind: str) -> str:
    return "(SELECT count(*) FROM u WHERE NOT p)" if kind == "pos" else "(SELECT count(*) FROM u)"


def ngram_sql(kind: str, span: int, where: str = "", min_rf: float | None = 10.0) -> str:
    toks = [f"Token_{i}" for i in range(1, span + 1)]
    tags = [f"Tag_{i}" for i in range(1, span + 1)]
    cols = ["Token AS Token_1", "Tag AS Tag_1", "p AS p1"]
    ok = ["NOT p1"]
    for k in range(1, span):
        cols += [f"lead(Token, {k}) OVER w AS Token_{k + 1}", f"lead(Tag, {k}) OVER w AS Tag_{k + 1}",
                 f"lead(p, {k}) OVER w AS p{k + 1}"]
        ok.append(f"p{k + 1} = false")
    keys = ", ".join(toks + tags)
    having = f" HAVING sum(n) / {_n_units_sql(kind)} * 1000000.0 > {min_rf}" if min_rf is not None else ""
    extra = f" AND ({where})" if where else ""
    return O.with_(ALL + _units(kind) + [
        f"o AS (SELECT doc_id, {', '.join(cols)} FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY pos))",
        f"base AS (SELECT doc_id, {keys}, count(*) AS n FROM o WHERE {' AND '.join(ok)}{extra} GROUP BY ALL)"],
        f"SELECT {keys}, CAST(sum(n) AS BIGINT) AS AF, {O.r(f'sum(n) / {_n_units_sql(kind)} * 1000000.0')} AS RF, "
        f"{O.r(f'count(*) * 100.0 / {ND}')} AS Range FROM base GROUP BY {keys}{having}")


@register("ngrams_pos", ngram_sql("pos", 3))
def ngrams_pos(spark, sf):
    return rounded(corpus(spark, sf).ngrams("pos", 3))


@register("ngrams_ds", ngram_sql("ds", 2))
def ngrams_ds(spark, sf):
    return rounded(corpus(spark, sf).ngrams("ds", 2))


@register("clusters_by_token", ngram_sql("pos", 3, "Token_2 = 'of'", None))
def clusters_by_token(spark, sf):
    return rounded(corpus(spark, sf).clusters_by_token("of", node_position=2, span=3, mode="fixed"))


@register("clusters_by_token_prefix", ngram_sql("pos", 2, "starts_with(Token_1, 'th')", None))
def clusters_by_token_prefix(spark, sf):
    return rounded(corpus(spark, sf).clusters_by_token("th", node_position=1, span=2, mode="starts_with"))


@register("clusters_by_tag", ngram_sql("pos", 2, "Tag_1 = 'AT'", None))
def clusters_by_tag(spark, sf):
    return rounded(corpus(spark, sf).clusters_by_tag("AT", tag_position=1, span=2))


@register("ngram_tag_filter", ngram_sql("pos", 2, "Tag_1 IN ('AT', 'AT1') AND Tag_2 IN ('NN1', 'NN2')"))
def ngram_tag_filter(spark, sf):
    t = corpus(spark, sf).ngrams("pos", 2)
    return rounded(NG.ngram_tag_filter(t, {1: ["AT", "AT1"], 2: ["NN1", "NN2"]}))


def coll_sql(kind: str, node: str, node_tag: str | None, pre: int, fol: int, stat: str) -> str:
    is_node = f"Token = {O.q(node)}" + (f" AND starts_with(Tag, {O.q(node_tag)})" if node_tag else "")
    wt = []
    if pre > 0:
        wt.append(f"coalesce(sum(nd) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {pre} FOLLOWING), 0)")
    if fol > 0:
        wt.append(f"coalesce(sum(nd) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {fol} PRECEDING AND 1 PRECEDING), 0)")
    o = "CAST(freq_span AS DOUBLE)"
    mi = {
        "pmi": f"log2({o} * n / (fn * freq_total))",
        "pmi2": f"log2({o} * {o} / (fn * freq_total))",
        "pmi3": f"log2({o} * {o} * {o} / (fn * freq_total * n))",
        "npmi": f"CASE WHEN {o} = n THEN NULL ELSE log2({o} * n / (fn * freq_total)) / -log2({o} / n) END",
    }[stat]
    return O.with_(ALL + _units(kind) + [
        f"f AS (SELECT doc_id, pos, Token, Tag, CASE WHEN {is_node} THEN 1 ELSE 0 END AS nd FROM u WHERE NOT p)",
        f"w AS (SELECT Token, Tag, nd, {' + '.join(wt) if wt else '0'} AS wt FROM f)",
        "c AS (SELECT Token, Tag, CAST(sum(wt) AS BIGINT) AS freq_span, count(*) AS freq_total, max(nd) AS is_node FROM w GROUP BY Token, Tag)",
        "t AS (SELECT CAST(sum(freq_total) AS DOUBLE) AS n, CAST(sum(freq_total) FILTER (WHERE is_node = 1) AS DOUBLE) AS fn FROM c)"],
        f"SELECT Token, Tag, freq_span, freq_total, {O.r(mi)} AS mi FROM c, t WHERE freq_span > 0")


def _coll(spark, sf, kind, node, node_tag, pre, fol, stat):
    return rounded(corpus(spark, sf).collocates(node, node_tag, pre, fol, stat, kind))


for _stat in ("pmi", "npmi", "pmi2", "pmi3"):
    register(f"collocates_{_stat}", coll_sql("pos", "of", None, 4, 4, _stat))(
        lambda spark, sf, _s=_stat: _coll(spark, sf, "pos", "of", None, 4, 4, _s))


@register("collocates_anchored", coll_sql("ds", "was", "Narr", 3, 2, "pmi"))
def collocates_anchored(spark, sf):
    return _coll(spark, sf, "ds", "was", "Narr", 3, 2, "pmi")


def kwic_sql(node: str, reach: int = 10, search: str = "fixed") -> str:
    cond = {"fixed": f"lower(s) = {O.q(node.lower())}", "starts_with": f"starts_with(lower(s), {O.q(node.lower())})",
            "ends_with": f"suffix(lower(s), {O.q(node.lower())})", "contains": f"contains(lower(s), {O.q(node.lower())})"}[search]
    strip = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    return O.with_(ALL + [
        "t AS (SELECT doc_id, token_idx, token, regexp_replace(token, '\\s+$', '') AS s FROM tok)",
        f"k AS (SELECT doc_id, token_idx, s, {cond} AS hit, "
        f"coalesce(array_to_string(list(token) OVER (PARTITION BY doc_id ORDER BY token_idx ROWS BETWEEN {reach} PRECEDING AND 1 PRECEDING), ''), '') AS pre0, "
        f"coalesce(array_to_string(list(token) OVER (PARTITION BY doc_id ORDER BY token_idx ROWS BETWEEN 1 FOLLOWING AND {reach} FOLLOWING), ''), '') AS post0 FROM t)"],
        f"SELECT doc_id, token_idx, {strip.format('pre0')} AS pre, s AS node, {strip.format('post0')} AS post FROM k WHERE hit")


@register("kwic", kwic_sql("of"))
def kwic(spark, sf):
    return corpus(spark, sf).kwic("of", "fixed", True, 10)


@register("kwic_ends_with", kwic_sql("ing", 5, "ends_with"))
def kwic_ends_with(spark, sf):
    return corpus(spark, sf).kwic("ing", "ends_with", True, 5)


@register("kwic_starts_with", kwic_sql("th", 3, "starts_with"))
def kwic_starts_with(spark, sf):
    return corpus(spark, sf).kwic("th", "starts_with", True, 3)


@register("kwic_contains", kwic_sql("tion", 4, "contains"))
def kwic_contains(spark, sf):
    return corpus(spark, sf).kwic("tion", "contains", True, 4)
