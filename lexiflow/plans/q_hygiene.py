"""Registered queries: ingest, corpus checks, categories (§2.1, §2.2, §2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as CH
from ..operators import ingest as IN
from ..operators import langid as LI
from ..operators import meta as M
from ..sources.documents import read_table
from ..storage import materialize, scratch_path
from . import oracle as O
from .catalog import ALL, corpus, register, rounded

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _fold_sql(x: str) -> str:
    out = f"translate({x}, {O.q(IN.FOLD_FROM)}, {O.q(IN.FOLD_TO)})"
    for pat, rep in IN.FOLD_MULTI:
        out = f"regexp_replace({out}, {O.q(pat)}, {O.q(rep)}, 'g')"
    return f"regexp_replace({out}, '[^\\x00-\\x7F]', '', 'g')"


def _raw(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select(F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), "text")


@register("ingest_documents", "SELECT regexp_replace(regexp_replace(source || '_' || CAST(doc_id AS VARCHAR) || '.txt', ' ', '', 'g'), "
          "'\\.[^.]*$', '') AS doc_id, " + STRIP.format(_fold_sql("text")) + " AS text FROM documents")
def ingest_documents(spark, sf):
    return IN.clean_documents(_raw(spark, sf), fold=True)


#: Stand-in for undecodable files: the bytes of every seventh id end in one that UTF-8 never has.
BROKEN_EVERY = 7


def _contents(spark, sf):
    d = read_table(spark, sf, "documents")
    raw = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % BROKEN_EVERY == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), content.alias("content"))


@register("undecodable_docs", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN text IS NOT NULL THEN "
          f"doc_id % {BROKEN_EVERY} <> 0 END AS valid FROM documents")
def undecodable_docs(spark, sf):
    return IN.decode_check(_contents(spark, sf)).select("doc_id", "valid")


def _bundle_sql() -> str:
    from .q_docs import table_counts_sql

    return table_counts_sql({"ds_tokens": "tok", "ft_pos": "ft_pos", "ft_ds": "ft_ds", "tt_pos": "tt_pos",
                             "tt_ds": "tt_ds", "dtm_pos": "dtm_pos", "dtm_ds": "dtm_ds"})


@register("load_token_parquet", O.with_(ALL, "SELECT doc_id, token_idx, token, pos_tag, ds_tag, pos_id, ds_id FROM tok"))
def load_token_parquet(spark, sf):
    path = scratch_path(spark, "tokens6")
    (corpus(spark, sf).clustered_tokens()
        .select(*[f.name for f in IN.TOKEN_SCHEMA.fields]).write.parquet(path))
    return IN.load_token_parquet(spark, path)


@register("corpus_bundle", _bundle_sql())
def corpus_bundle(spark, sf):
    path = corpus(spark, sf).save_bundle(scratch_path(spark, "bundle"))
    tables = IN.load_bundle(spark, path)
    parts = [df.select(F.lit(name).alias("table")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table").agg(F.count(F.lit(1)).alias("rows"))


def _upload_ids(spark, sf):
    a = read_table(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_id"))
    b = read_table(spark, sf, "benchmark").select(F.concat(F.lit("doc_"), F.col("item_id").cast("string")).alias("doc_id"))
    return a, b


@register("duplicate_doc_ids", "SELECT doc_id, count(*) AS n FROM (SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS doc_id FROM documents "
          "UNION ALL SELECT 'doc_' || CAST(item_id AS VARCHAR) FROM benchmark) GROUP BY doc_id HAVING count(*) > 1")
def duplicate_doc_ids(spark, sf):
    a, b = _upload_ids(spark, sf)
    return CH.duplicate_doc_ids(a.unionByName(b))


@register("target_reference_overlap", "SELECT DISTINCT 'doc_' || CAST(doc_id AS VARCHAR) AS doc_id FROM documents "
          "WHERE 'doc_' || CAST(doc_id AS VARCHAR) IN (SELECT 'doc_' || CAST(item_id AS VARCHAR) FROM benchmark)")
def target_reference_overlap(spark, sf):
    a, b = _upload_ids(spark, sf)
    return CH.target_reference_overlap(a, b)


@register("corpus_size", "SELECT CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, CAST(NULL AS BIGINT) AS \"limit\", "
          "TRUE AS within_limit FROM documents")
def corpus_size(spark, sf):
    return CH.corpus_size(corpus(spark, sf).docs)


#: Twin of the two-fold trigram model: counts of one fold, scores of the other.
LANG_SQL = [
    "ld AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' THEN 0 ELSE 1 END AS fold, "
    "string_split(' ' || trim(lower(regexp_replace(text, '[^\\p{L}]+', ' ', 'g')), ' ') || ' ', '') AS t FROM documents)",
    "lg AS (SELECT doc_id, lang, fold, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || t[i + 1] || t[i + 2])) AS gram FROM ld)",
    "lc AS (SELECT 1 - fold AS fold, lang, gram, count(*) AS c FROM lg WHERE lang IS NOT NULL GROUP BY ALL)",
    "lt AS (SELECT fold, lang, sum(c) + count(*) + 1 AS n FROM lc GROUP BY ALL)",
    "lk AS (SELECT doc_id, fold, gram, count(*) AS k FROM lg GROUP BY ALL)",
    "lh AS (SELECT lk.doc_id, lc.lang, sum(k * ln(c + 1)) AS gain FROM lk JOIN lc USING (fold, gram) GROUP BY ALL)",
    "ls AS (SELECT d.doc_id, lt.lang, coalesce(gain, 0) - coalesce(m.k, 0) * ln(lt.n) AS ll "
    "FROM (SELECT DISTINCT doc_id, fold FROM ld) d JOIN lt USING (fold) "
    "LEFT JOIN (SELECT doc_id, sum(k) AS k FROM lk GROUP BY ALL) m ON m.doc_id = d.doc_id "
    "LEFT JOIN lh ON lh.doc_id = d.doc_id AND lh.lang = lt.lang)",
    "lp AS (SELECT doc_id, lang, exp(ll - m) / sum(exp(ll - m)) OVER (PARTITION BY doc_id) AS p FROM "
    "(SELECT *, max(ll) OVER (PARTITION BY doc_id) AS m FROM ls))",
    "lf AS (SELECT doc_id, coalesce(max(p) FILTER (WHERE lang = 'en'), 0) AS p_target FROM lp GROUP BY doc_id)",
]


def _labelled(spark, sf):
    return read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")


@register("language_filter", O.with_(LANG_SQL, f"SELECT doc_id, {O.r('p_target')} AS p_target, p_target > {LI.THRESHOLD} AS passed FROM lf"))
def language_filter(spark, sf):
    docs = _labelled(spark, sf)
    return rounded(LI.language_filter(docs, LI.train_profiles(docs), "en"))


@register("language_confusion", O.with_(LANG_SQL, "SELECT lang, predicted, count(*) AS n_docs FROM ld JOIN "
          "(SELECT doc_id, arg_min(lang, (-round(p, 9), lang)) AS predicted FROM lp GROUP BY doc_id) USING (doc_id) GROUP BY ALL"))
def language_confusion(spark, sf):
    docs = _labelled(spark, sf)
    return LI.language_confusion(docs, LI.train_profiles(docs))


@register("language_fail_list", O.with_(LANG_SQL, f"SELECT doc_id, 'language' AS reason FROM lf WHERE NOT p_target > {LI.THRESHOLD} "
          f"UNION ALL SELECT CAST(doc_id AS VARCHAR), 'decode' FROM documents WHERE text IS NOT NULL AND doc_id % {BROKEN_EVERY} = 0"))
def language_fail_list(spark, sf):
    docs = _labelled(spark, sf)
    lang = LI.language_filter(docs, LI.train_profiles(docs), "en").filter(~F.col("passed")).select("doc_id", F.lit("language").alias("reason"))
    dec = IN.decode_check(_contents(spark, sf)).filter(~F.col("valid"))
    return lang.unionByName(dec.select("doc_id", F.lit("decode").alias("reason")))


@register("corpus_readiness", O.with_(ALL, "SELECT "
          "(SELECT count(*) FROM (SELECT doc_id FROM tok_docs WHERE split_part(doc_id, '_', 1) IN " + O.in_list([f"src{i}" for i in range(10)]) +
          " GROUP BY doc_id HAVING count(*) > 1)) = 0 AS no_duplicates, "
          "(SELECT count(*) FROM (SELECT DISTINCT doc_id FROM tok_docs WHERE split_part(doc_id, '_', 1) IN " + O.in_list([f"src{i}" for i in range(10)]) +
          ") a WHERE doc_id IN (SELECT doc_id FROM tok_docs WHERE split_part(doc_id, '_', 1) IN " + O.in_list([f"src{i}" for i in range(10, 20)]) + ")) = 0 AS no_overlap, "
          "TRUE AS size_ok, "
          "(SELECT count(*) FROM tok_docs) > 0 AS not_empty, "
          f"(SELECT count(*) FROM documents WHERE text IS NOT NULL AND doc_id % {BROKEN_EVERY} = 0) = 0 AS decode_ok, "
          f"((SELECT count(*) FROM documents WHERE text IS NOT NULL AND doc_id % {BROKEN_EVERY} = 0) = 0 AND (SELECT count(*) FROM (SELECT doc_id FROM tok_docs WHERE split_part(doc_id, '_', 1) IN " + O.in_list([f"src{i}" for i in range(10)]) +
          " GROUP BY doc_id HAVING count(*) > 1)) = 0 AND (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM tok_docs WHERE split_part(doc_id, '_', 1) IN "
          + O.in_list([f"src{i}" for i in range(10)]) + ") a WHERE doc_id IN (SELECT doc_id FROM tok_docs WHERE split_part(doc_id, '_', 1) IN "
          + O.in_list([f"src{i}" for i in range(10, 20)]) + ")) = 0 "
          "AND (SELECT count(*) FROM tok_docs) > 0) AS ready"))
def corpus_readiness(spark, sf):
    c = corpus(spark, sf)
    cat = F.split("doc_id", "_", 2).getItem(0)
    t = c.docs.filter(cat.isin([f"src{i}" for i in range(10)])).select("doc_id")
    r = c.docs.filter(cat.isin([f"src{i}" for i in range(10, 20)])).select("doc_id")
    broken = IN.decode_check(_contents(spark, sf)).filter(~F.col("valid"))
    return CH.corpus_readiness(t, r, c.docs, decode_rejects=broken)


@register("doc_categories", O.with_(ALL, "SELECT doc_id, regexp_replace(doc_id, '_\\S+$', '') AS category FROM "
                                    "(SELECT DISTINCT doc_id FROM tok_docs WHERE regexp_matches(text, '\\S')) "
                                    "WHERE (SELECT bool_and(contains(doc_id, '_') AND length(regexp_replace(doc_id, '_\\S+$', '')) > 0) FROM tok_docs)"))
def doc_categories(spark, sf):
    c = corpus(spark, sf)
    return M.doc_categories(c.docs.filter(F.col("text").rlike(r"\S")).select("doc_id").distinct())


def _cats(spark, sf):
    c = corpus(spark, sf)
    return M.doc_categories(c.docs.filter(F.col("text").rlike(r"\S")).select("doc_id").distinct())


_CATS_SQL = "cats AS (SELECT doc_id, regexp_replace(doc_id, '_\\S+$', '') AS category FROM (SELECT DISTINCT doc_id FROM tok_docs WHERE regexp_matches(text, '\\S')))"


@register("category_gate", O.with_(ALL + [_CATS_SQL], "SELECT count(DISTINCT category) AS n_categories, "
                                   "count(DISTINCT category) BETWEEN 2 AND 20 AS accepted FROM cats"))
def category_gate(spark, sf):
    return M.category_gate(_cats(spark, sf))


@register("category_counts", O.with_(ALL + [_CATS_SQL], "SELECT category, count(*) AS n_docs FROM cats GROUP BY category"))
def category_counts(spark, sf):
    return M.category_counts(_cats(spark, sf))


LANG_LABELS = {"en": "English", "de": "German", "fr": "French"}


@register("category_labels", "SELECT lang AS category, count(*) AS n_docs, CASE lang " + " ".join(
    f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in LANG_LABELS.items()) + " ELSE lang END AS description FROM documents GROUP BY lang")
def category_labels(spark, sf):
    d = read_table(spark, sf, "documents").select(F.concat(F.col("lang"), F.lit("_"), F.col("doc_id").cast("string")).alias("doc_id"))
    cats = M.doc_categories(d)
    return M.category_labels(M.category_counts(cats), LANG_LABELS)


@register("subset_by_category", O.with_(ALL, "SELECT doc_id, token_idx, token, pos_tag FROM tok WHERE split_part(doc_id, '_', 1) IN ('src1', 'src2')"))
def subset_by_category(spark, sf):
    return M.subset_by_category(corpus(spark, sf).pos_tokens, ["src1", "src2"]).select("doc_id", "token_idx", "token", "pos_tag")


@register("split_corpus_counts", O.with_(ALL, "SELECT count(*) FILTER (WHERE starts_with(doc_id, 'src1')) AS tar_tokens, "
          "count(*) FILTER (WHERE starts_with(doc_id, 'src1') AND NOT starts_with(pos_tag, 'Y')) AS tar_words, "
          "count(DISTINCT doc_id) FILTER (WHERE starts_with(doc_id, 'src1')) AS tar_ndocs, "
          "count(*) FILTER (WHERE starts_with(doc_id, 'src2')) AS ref_tokens, "
          "count(*) FILTER (WHERE starts_with(doc_id, 'src2') AND NOT starts_with(pos_tag, 'Y')) AS ref_words, "
          "count(DISTINCT doc_id) FILTER (WHERE starts_with(doc_id, 'src2')) AS ref_ndocs FROM tok"))
def split_corpus_counts(spark, sf):
    return M.split_corpus_counts(corpus(spark, sf).pos_tokens, ["src1"], ["src2"])

