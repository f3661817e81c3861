"""Frequency, tag and document-term tables.

Everything rolls up from counting rows ``(keys..., n, docs)``: ``n``
occurrences, ``docs`` documents that have the key for the first time in that
row, and rows with null keys that count the documents.  Document rows give
them without a shuffle (``operators.docrows``); for token tables they are a
first aggregation by document and key.  One aggregation on the key then yields
AF, the document counts and, as a scalar subquery over that vocabulary-sized
result, the totals; no ``countDistinct`` (and no Expand) is ever planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import NON_ANALYTIC_TAGS, simplify_tag
from ..functions.text import first_segment


def base_counts(units: DataFrame, keys: Sequence[str] = ("Token", "Tag")) -> DataFrame:
    return units.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("n"))


def unit_counts(units: DataFrame, keys: Sequence[str] = ("Token", "Tag")) -> DataFrame:
    """Counting rows of unit rows of any origin: one per document and key."""
    return base_counts(units, keys).select(*keys, "n", F.lit(1).cast("long").alias("docs"))


def document_marks(doc_ids: DataFrame, keys: Sequence[str] = ("Token", "Tag")) -> DataFrame:
    """Counting rows that count documents (distinct ``doc_id``)."""
    return doc_ids.select("doc_id").distinct().select(
        *[F.lit(None).cast("string").alias(k) for k in keys], F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("docs"))


def n_docs(tokens: DataFrame):
    """Number of documents of a corpus, as a scalar-subquery Column."""
    return tokens.select(F.countDistinct("doc_id")).scalar()


def summed(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AF and documents by key; ``_key`` tells the row that counts documents.
    (A filter on an aggregate stays above it, so that the table and its totals
    share one shuffle.)"""
    return counts.groupBy(*keys).agg(F.sum("n").cast("long").alias("AF"), F.sum("docs").alias("_docs"),
                                     F.max(F.col(keys[0]).isNotNull()).alias("_key"))


def relative(agg: DataFrame, keys: Sequence[str], per: float, ndocs: Column | None = None, total: Column | None = None) -> DataFrame:
    """keys..., AF, RF (per ``per`` units), Range (% of documents) of summed counting rows."""
    key = F.col("_key")
    totals = agg.select(F.struct(F.sum(F.when(key, F.col("AF"))).alias("n"), F.max(F.when(~key, F.col("_docs"))).alias("d"),
                                 F.max(F.when(~key, F.col("AF"))).alias("marked"))).scalar()
    out = agg.filter(key).withColumn("_t", totals)
    n = F.col("_t.n") if total is None else total(F.col("_t")) if callable(total) else total
    # (keys that hang on an aggregate: a filter on them stays above it, else the totals would read the texts again)
    return out.select(*[F.when(key, F.col(k)).alias(k) for k in keys], "AF", (F.col("AF") / n * F.lit(per)).alias("RF"),
                      (F.col("_docs") * F.lit(100.0) / (F.col("_t.d") if ndocs is None else ndocs)).alias("Range"))


def frequency_table(counts: DataFrame, ndocs: Column | None = None, per: float = 1_000_000.0) -> DataFrame:
    """Token, Tag, AF, RF (per million units), Range (% of documents)."""
    keys = ["Token", "Tag"]
    return relative(summed(counts, keys), keys, per, ndocs)


def tags_table(counts: DataFrame, ndocs: Column | None = None) -> DataFrame:
    """Tag, AF, RF (% of units), Range (% of documents)."""
    return relative(summed(counts, ["Tag"]), ["Tag"], 100.0, ndocs)


def tags_from_dtm(dtm: DataFrame, ndocs: Column) -> DataFrame:
    return tags_table(dtm.filter(F.col("n") > 0).select("Tag", "n", F.lit(1).alias("docs")), ndocs)


def dtm_long(units: DataFrame) -> DataFrame:
    """Document-term matrix, long and sparse: (doc_id, Tag, n)."""
    return units.groupBy("doc_id", "Tag").agg(F.count(F.lit(1)).cast("long").alias("n"))


def dtm_dense(dtm: DataFrame, tags: Sequence[str] | None = None, value: str = "n") -> DataFrame:
    """Zero-filled long matrix.  Densified by ``pivot`` per document (one
    shuffle on doc_id) and ``unpivot`` back -- no cross join of docs x tags.
    ``tags``: the column set; by default the distinct tags (a closed tagset,
    bounded by its vocabulary)."""
    if tags is None:
        tags = sorted(r[0] for r in dtm.select("Tag").distinct().collect())
    wide = dtm.groupBy("doc_id").pivot("Tag", list(tags)).agg(F.first(value)).na.fill(0)
    return wide.unpivot("doc_id", [F.col(f"`{t}`") for t in tags], "Tag", value)


def dtm_wide(dtm: DataFrame, tags: Sequence[str] | None = None, index: Sequence[str] = ("doc_id",),
             value: str = "n") -> DataFrame:
    if tags is None:
        tags = sorted(r[0] for r in dtm.select("Tag").distinct().collect())
    return dtm.groupBy(*index).pivot("Tag", list(tags)).agg(F.first(value)).na.fill(0)


def freq_simplify(freq: DataFrame) -> DataFrame:
    """Relabel tags (D7) without re-aggregating, as the reference does.  A table
    without part-of-speech tags is an error, raised when it is read."""
    required = {"Token", "Tag", "AF", "RF", "Range"}
    if not required.issubset(set(freq.columns)):
        raise ValueError("expected a frequency table with Token, Tag, AF, RF, Range")
    is_pos = freq.select(F.max(F.col("Tag").startswith("NN") | F.col("Tag").startswith("VV") | F.col("Tag").startswith("II"))).scalar()
    wrong = F.raise_error(F.lit("expected a frequency table with part-of-speech tags")).cast("boolean")
    return freq.filter(F.when(is_pos, F.lit(True)).otherwise(wrong)).withColumn("Tag", simplify_tag("Tag"))


def dtm_simplify(dtm: DataFrame) -> DataFrame:
    return dtm.withColumn("Tag", simplify_tag("Tag")).groupBy("doc_id", "Tag").agg(F.sum("n").cast("long").alias("n"))


def tags_simplify(dtm: DataFrame, ndocs) -> DataFrame:
    return tags_from_dtm(dtm_simplify(dtm), ndocs)


def with_group(dtm: DataFrame, group=None) -> DataFrame:
    """Attach Group, the second column, derived from doc_id (never by position)."""
    rest = [c for c in dtm.columns if c not in ("doc_id", "Group")]
    return dtm.select("doc_id", (first_segment("doc_id") if group is None else group).alias("Group"), *rest)


def tags_table_grouped(dtm_dense_grouped: DataFrame) -> DataFrame:
    """Per (Group, Tag): AF, RF as a proportion of the group's units, Range =
    % of the group's documents with n > 0; ordered by RF and Group, both
    descending.  Input: dense long (doc_id, Group, Tag, n), in that order.  One
    aggregation; group totals are a small per-group aggregate."""
    if dtm_dense_grouped.columns[:2] != ["doc_id", "Group"]:
        raise ValueError("the first column must be doc_id and the second Group")
    g = dtm_dense_grouped.groupBy("Group", "Tag").agg(
        F.sum("n").cast("long").alias("AF"),
        F.count_if(F.col("n") > 0).alias("_docs"),
        F.count(F.lit(1)).alias("_ndocs"))
    totals = dtm_dense_grouped.groupBy("Group").agg(F.sum("n").alias("_gt"))
    return (g.join(totals, "Group")
             .select("Tag", "Group", "AF", (F.col("AF") / F.col("_gt")).alias("RF"),
                     (F.col("_docs") * F.lit(100.0) / F.col("_ndocs")).alias("Range"))
             .orderBy(F.col("RF").desc(), F.col("Group").desc(), "Tag"))


def dtm_weight_prop(dtm: DataFrame, value: str = "n", out: str = "RF") -> DataFrame:
    """Row-normalise: value / document total.  Document totals are a small
    aggregate joined back (AQE broadcasts it when small)."""
    totals = dtm.groupBy("doc_id").agg(F.sum(value).alias("_dt"))
    return dtm.join(totals, "doc_id").withColumn(out, F.col(value) / F.col("_dt")).drop("_dt")


def dtm_weight_scale(dense: DataFrame, value: str = "RF", out: str = "Z") -> DataFrame:
    """Column z-score (sample sd) of a zero-filled long matrix; zero variance -> 0."""
    stats = dense.groupBy("Tag").agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return (dense.join(stats, "Tag")
                 .withColumn(out, F.when(F.col("_s").isNull() | (F.col("_s") == 0), F.lit(0.0))
                             .otherwise((F.col(value) - F.col("_m")) / F.col("_s")))
                 .drop("_m", "_s"))


def drop_non_analytic(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("Tag").isin(*NON_ANALYTIC_TAGS))


def make_percent(df: DataFrame, exclude: Sequence[str] = ("AF", "Range")) -> DataFrame:
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    cols = []
    for name, typ in df.dtypes:
        if typ in numeric and name not in exclude:
            cols.append((F.col(name) * 100).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def tag_bar_data(tags: DataFrame) -> DataFrame:
    return tags.orderBy(F.col("RF").desc(), F.col("Tag"))
