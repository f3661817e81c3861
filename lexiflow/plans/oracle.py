"""DuckDB twins of the registered queries (the correctness oracle).

Each builder returns plain SQL over the pre-registered parquet views
(``documents``, ``events``, ``conversations``, ``labels``, ...).  The
tokenizer, the stand-in taggers and all pinned definitions are restated in
SQL from the same fixed values the Spark side uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.lexicon import DS_LEXICON, POS_LEXICON
from ..functions.stats import erfc_sql
from ..functions.tags import simplify_tag_sql
from ..functions.text import TOKEN_PATTERN
from ..operators.tagging import SUFFIX_RULES

ROUND = 6


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r(expr: str, nd: int = ROUND) -> str:
    return f"round(CAST({expr} AS DOUBLE), {nd})"


def in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def unit_key_sql(tok: str) -> str:
    return f"lower(regexp_replace(regexp_replace({tok}, '\\s+$', ''), '\\s+', ' ', 'g'))"


def docs_cte(sources: Sequence[str] | None = None, lang: str | None = None, category_from: str = "source",
             name: str = "docs") -> str:
    where = []
    if lang is not None:
        where.append(f"lang = {q(lang)}")
    if sources is not None:
        where.append(f"source IN {in_list(sources)}")
    w = (" WHERE " + " AND ".join(where)) if where else ""
    return (f"{name} AS (SELECT {category_from} || '_' || CAST(doc_id AS VARCHAR) AS doc_id, text "
            f"FROM documents{w})")


def token_ctes(docs: str = "docs", out: str = "tok", pfx: str = "") -> list[str]:
    """CTEs turning ``docs(doc_id, text)`` into the token table ``out``."""
    p = pfx or out + "_"
    max_len = max(len(x.split(" ")) for x in DS_LEXICON)
    pos_values = ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(POS_LEXICON.items()))
    ds_values = ", ".join(f"({q(k)}, {len(k.split(' '))}, {q(v)})" for k, v in sorted(DS_LEXICON.items()))
    suffix = " ".join("WHEN " + " OR ".join(f"suffix(lower(s), {q(x)})" for x in sufs) + f" THEN {q(tag)}"
                      for sufs, tag in SUFFIX_RULES)
    leads = []
    for n in range(2, max_len + 1):
        parts = ["w"] + [f"lead(w, {k}) OVER o" for k in range(1, n)]
        leads.append(f"CASE WHEN lead(w, {n - 1}) OVER o IS NOT NULL THEN concat_ws(' ', {', '.join(parts)}) END AS p{n}")
    cand_union = " UNION ALL ".join(
        f"SELECT doc_id, s, {n} AS n, l.tag FROM {p}pw JOIN {p}dslex l ON l.phrase = {p}pw.p{n} AND l.n = {n}"
        for n in range(1, max_len + 1))
    return [
        f"{p}t0 AS (SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS token_idx, unnest(x) AS token "
        f"FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '\\s+$', ''), {q(TOKEN_PATTERN)}, 0) AS x FROM {docs}))",
        f"{p}poslex AS (SELECT * FROM (VALUES {pos_values}) v(word, tag))",
        f"{p}t1 AS (SELECT t.doc_id, t.token_idx, t.token, CASE "
        f"WHEN regexp_matches(s, '^[^\\p{{L}}\\p{{N}}]$') THEN 'Y' "
        f"WHEN regexp_matches(s, '^\\p{{N}}+$') THEN 'MC' "
        f"WHEN l.tag IS NOT NULL THEN l.tag "
        f"WHEN strlen(s) <> length(s) THEN 'FU' "
        f"{suffix} ELSE 'NN1' END AS pos_tag "
        f"FROM (SELECT *, regexp_replace(token, '\\s+$', '') AS s FROM {p}t0) t LEFT JOIN {p}poslex l ON l.word = lower(t.s))",
        f"{p}dslex AS (SELECT * FROM (VALUES {ds_values}) v(phrase, n, tag))",
        f"{p}w AS (SELECT doc_id, token_idx, lower(regexp_replace(token, '\\s+$', '')) AS w FROM {p}t0)",
        f"{p}pw AS (SELECT doc_id, token_idx AS s, w AS p1, {', '.join(leads)} FROM {p}w "
        f"WINDOW o AS (PARTITION BY doc_id ORDER BY token_idx))",
        f"{p}cand AS (SELECT doc_id, s, max(n) AS n, arg_max(tag, n) AS tag FROM ({cand_union}) GROUP BY doc_id, s)",
        f"{p}isl AS (SELECT doc_id, s, n, tag, sum(CASE WHEN pe IS NULL OR s >= pe THEN 1 ELSE 0 END) OVER "
        f"(PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM "
        f"(SELECT *, max(s + n) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {p}cand))",
        f"{p}fold AS (SELECT doc_id, list_reduce(list({{'s': s, 'n': n, 'tag': tag}} ORDER BY s), "
        f"lambda acc, x: CASE WHEN x.s >= acc.e THEN {{'e': x.s + x.n, 'c': list_append(acc.c, x)}} ELSE acc END, "
        f"{{'e': CAST(-1 AS BIGINT), 'c': CAST([] AS STRUCT(s BIGINT, n INTEGER, tag VARCHAR)[])}}).c AS c "
        f"FROM {p}isl GROUP BY doc_id, island)",
        f"{p}chosen AS (SELECT doc_id, x.s AS s, x.n AS n, x.tag AS tag FROM (SELECT doc_id, unnest(c) AS x FROM {p}fold))",
        f"{p}cov AS (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS token_idx, tag AS dtag, s AS dstart FROM {p}chosen)",
        f"{out} AS (SELECT t.doc_id, t.token_idx, t.token, t.pos_tag, coalesce(c.dtag, 'Untagged') AS ds_tag, "
        f"t.token_idx AS pos_id, coalesce(c.dstart, t.token_idx) AS ds_id "
        f"FROM {p}t1 t LEFT JOIN {p}cov c ON c.doc_id = t.doc_id AND c.token_idx = t.token_idx)",
    ]


def unit_ctes(tok: str = "tok", kind: str = "pos", out: str | None = None, analytic: bool = False) -> list[str]:
    """Units ``(doc_id, unit_id, Tag, pos, utext, Token)``; optionally only the
    analytic ones (POS without Y)."""
    out = out or f"{tok}_{kind}u"
    if kind == "pos":
        body = (f"SELECT doc_id, pos_id AS unit_id, pos_tag AS Tag, min(token_idx) AS pos, "
                f"string_agg(token, '' ORDER BY token_idx) AS utext FROM {tok} GROUP BY doc_id, pos_id, pos_tag")
    else:
        body = (f"SELECT doc_id, ds_id AS unit_id, ds_tag AS Tag, min(token_idx) AS pos, "
                f"string_agg(token, '' ORDER BY token_idx) AS utext FROM {tok} GROUP BY doc_id, ds_id, ds_tag")
    where = " WHERE Tag <> 'Y'" if (analytic and kind == "pos") else ""
    return [f"{out} AS (SELECT *, {unit_key_sql('utext')} AS Token FROM ({body}){where})"]


def punct_unit_sql(kind: str) -> str:
    if kind == "pos":
        return "(Tag = 'Y')"
    return "(Tag = 'Untagged' AND regexp_matches(utext, '^[[:punct:] ]+$'))"


def with_(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


def corpus_ctes(sources: Sequence[str] | None = None, lang: str | None = None, name: str = "tok",
                category_from: str = "source") -> list[str]:
    return [docs_cte(sources, lang, category_from, name=f"{name}_docs")] + token_ctes(f"{name}_docs", name)


def ndocs_sql(tok: str = "tok") -> str:
    return f"(SELECT count(DISTINCT doc_id) FROM {tok})"


__all__ = [n for n in dir() if not n.startswith("__")]
