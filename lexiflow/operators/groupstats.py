"""Group statistics, plot data and correlation.

Quantiles are exact (linear interpolation between order statistics, as
numpy/pandas/DuckDB ``quantile_cont``) and distributed: equal values are first
counted (combined before the shuffle), so a value that most rows share is one
row; the distinct values are dealt by range, and the counts of earlier parts
come from a table with one row per group and part.  A hot group is spread over
many tasks, and neither a group nor its ties are gathered into one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import student_t_p
from ..functions.text import first_segment
from ..storage import materialize


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(keys..., <name> for each quantile) with exact linear interpolation."""
    keys = list(keys)
    counts = (df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
                .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    # written, so that both readers below see the same parts
    d = materialize(counts.repartitionByRange(*keys, "_v").withColumn("_pid", F.spark_partition_id()), "quantile-values")
    inside = Window.partitionBy(*keys, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_r", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    parts = d.groupBy(*keys, "_pid").agg(F.sum("_c").alias("_pc"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"),
                         F.coalesce(F.sum("_pc").over(earlier), F.lit(0)).alias("_off"), F.sum("_pc").over(whole).alias("_n"))
    same = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    low = F.col("_off") + F.col("_r")                     # rank of the value's first occurrence
    ranked = d.join(parts, same).select(*keys, "_v", "_n", low.alias("_lo"), (low + F.col("_c") - 1).alias("_hi"))
    place = {name: (F.col("_n") - 1) * F.lit(q) for name, q in qs.items()}
    holds = lambda rank: (F.col("_lo") <= rank) & (F.col("_hi") >= rank)
    picks = [F.max(F.when(holds(end(p)), F.col("_v"))).alias(f"_{side}_{name}")
             for name, p in place.items() for side, end in (("f", F.floor), ("c", F.ceil))]
    out = ranked.groupBy(*keys).agg(*picks, F.max("_n").alias("_n"))
    value_of = lambda name, p: F.col(f"_f_{name}") + (F.col(f"_c_{name}") - F.col(f"_f_{name}")) * (p - F.floor(p))
    return out.select(*keys, *[value_of(name, p).alias(name) for name, p in place.items()])


def box_values(dense_prop: DataFrame, tags: Sequence[str], grp_a: Sequence[str] | None = None,
               grp_b: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, Tag, RF x100[, Group]) for the chosen tags; with groups only their documents."""
    d = dense_prop.filter(F.col("Tag").isin(list(tags))).select("doc_id", "Tag", (F.col("RF") * 100).alias("RF"))
    if grp_a is None:
        return d
    return d.withColumn("Group", group_label(F.col("doc_id"), grp_a, grp_b)).filter(F.col("Group").isNotNull())


def box_data(dense_prop: DataFrame, tags: Sequence[str]) -> DataFrame:
    """(doc_id, Tag, RF x100, Median over Tag), by Median descending, then Tag."""
    d = box_values(dense_prop, tags)
    med = exact_quantiles(d, ["Tag"], "RF", {"Median": 0.5})
    return d.join(med, "Tag").select("doc_id", "Tag", "RF", "Median").orderBy(F.col("Median").desc(), "Tag", "doc_id")


def group_label(doc_id: Column, grp_a: Sequence[str], grp_b: Sequence[str]) -> Column:
    cat = first_segment(doc_id)
    return (F.when(cat.isin(list(grp_a)), F.lit(", ".join(grp_a)))
             .when(cat.isin(list(grp_b)), F.lit(", ".join(grp_b))))


def box_data_grouped(dense_prop: DataFrame, tags: Sequence[str], grp_a: Sequence[str], grp_b: Sequence[str]) -> DataFrame:
    """(doc_id, Tag, RF x100, Group, Median over Group and Tag), by Median descending, then Tag."""
    d = box_values(dense_prop, tags, grp_a, grp_b)
    med = exact_quantiles(d, ["Group", "Tag"], "RF", {"Median": 0.5})
    return (d.join(med, ["Group", "Tag"]).select("doc_id", "Tag", "RF", "Group", "Median")
             .orderBy(F.col("Median").desc(), "Tag", "Group", "doc_id"))


def box_stats(box: DataFrame, keys: Sequence[str] = ("Tag",)) -> DataFrame:
    keys = list(keys)
    basic = box.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg("RF").alias("mean"), F.stddev_samp("RF").alias("std"),
        F.min("RF").alias("min"), F.max("RF").alias("max"))
    qs = exact_quantiles(box, keys, "RF", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return basic.join(qs, keys).select(*keys, "count", "mean", "median", "std", "min", "q25", "q75", "max")


def box_hover_stats(box: DataFrame, keys: Sequence[str] = ("Tag",)) -> DataFrame:
    keys = list(keys)
    basic = box.groupBy(*keys).agg(F.avg("RF").alias("mean"), F.min("RF").alias("min"), F.max("RF").alias("max"))
    qs = exact_quantiles(box, keys, "RF", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return basic.join(qs, keys).select(*keys, "mean", "median", (F.col("q75") - F.col("q25")).alias("iqr"), "min", "max")


def scatter_data(dense_prop: DataFrame, x: str, y: str) -> DataFrame:
    """(doc_id, <x>, <y>) with prop x100; two known tag columns."""
    d = dense_prop.filter(F.col("Tag").isin(x, y)).withColumn("RF", F.col("RF") * 100)
    return d.groupBy("doc_id").pivot("Tag", [x, y]).agg(F.first("RF")).na.fill(0.0)


def scatter_data_grouped(dense_prop: DataFrame, x: str, y: str) -> DataFrame:
    return scatter_data(dense_prop, x, y).withColumn("Group", first_segment("doc_id"))


def scatter_axis_share(dtm: DataFrame, axis: Sequence[str]) -> DataFrame:
    """Chosen tags vs the rest folded into Other; share of the document x100;
    Other dropped; wide by tag, Group from the id."""
    folded = (dtm.withColumn("Tag", F.when(F.col("Tag").isin(list(axis)), F.col("Tag")).otherwise(F.lit("Other")))
                 .groupBy("doc_id", "Tag").agg(F.sum("n").alias("n")))
    totals = folded.groupBy("doc_id").agg(F.sum("n").alias("_t"))
    share = folded.join(totals, "doc_id").withColumn("RF", F.col("n") / F.col("_t") * 100).filter(F.col("Tag") != "Other")
    return (share.groupBy("doc_id").pivot("Tag", list(axis)).agg(F.first("RF")).na.fill(0.0)
                 .withColumn("Group", first_segment("doc_id")))


def pearson(wide: DataFrame, x: str, y: str) -> DataFrame:
    """One row: r (3 dp), df = n - 2."""
    return wide.agg(F.round(F.corr(x, y), 3).alias("r"), (F.count(F.lit(1)) - 2).alias("df"))


def pearson_p(wide: DataFrame, x: str, y: str) -> DataFrame:
    """r, df and the two-sided p (5 dp) from Student's t."""
    agg = wide.agg(F.corr(x, y).alias("_r"), F.count(F.lit(1)).alias("_n"))
    return agg.select(F.round("_r", 3).alias("r"), (F.col("_n") - 2).alias("df"),
                      F.round(student_t_p(F.col("_r"), F.col("_n")), 5).alias("p"))


def pearson_groups(wide: DataFrame, x: str, y: str, highlight: Sequence[str], group_col: str = "Group") -> DataFrame:
    """(highlight, r, df, p) per side; nulls when a side has <= 2 rows."""
    hl = F.col(group_col).isin(list(highlight))
    g = wide.groupBy(hl.alias("highlight")).agg(F.corr(x, y).alias("_r"), F.count(F.lit(1)).alias("_n"))
    big = F.col("_n") > 2
    return g.select("highlight", F.when(big, F.round("_r", 3)).alias("r"), F.when(big, F.col("_n") - 2).alias("df"),
                    F.when(big, F.round(student_t_p(F.col("_r"), F.col("_n")), 5)).alias("p"))


def correlation_matrix(wide: DataFrame, tags: Sequence[str]) -> DataFrame:
    """(tag_a, tag_b, r): Pearson r for every tag pair (a < b).

    One distributed Gramian over assembled vectors (Spark ML), so the plan does
    not grow with the number of tags; only the tags x tags matrix, bounded by
    the tagset, comes to the driver.  A tag that is constant has null r."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    tags, spark = sorted(tags), wide.sparkSession
    schema = "tag_a string, tag_b string, r double"
    if len(tags) < 2:
        return spark.createDataFrame([], schema)
    vectors = VectorAssembler(inputCols=tags, outputCol="_x").transform(wide.select(*[F.col(f"`{t}`") for t in tags])).select("_x")
    matrix = Correlation.corr(vectors, "_x").first()[0].toArray()
    rows = [(a, b, None if matrix[i, j] != matrix[i, j] else float(matrix[i, j]))
            for i, a in enumerate(tags) for j, b in enumerate(tags) if i < j]
    return spark.createDataFrame(rows, schema)


def linear_trend(wide: DataFrame, x: str, y: str) -> DataFrame:
    return wide.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def highlight_split(df: DataFrame, groups: Sequence[str] | None, group_col: str = "Group") -> DataFrame:
    flag = F.lit(True) if not groups else F.col(group_col).isin(list(groups))
    return df.withColumn("highlight", flag)
