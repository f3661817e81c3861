"""Principal components of the scaled document-term matrix.

Spark ML: ``VectorAssembler`` -> ``PCA``.  The covariance is accumulated
distributedly (tags x tags, bounded by the tagset); only the small loading
matrix is handled on the driver.  Input columns are z-scores, i.e. already
centred, so ``PCAModel.transform`` (which does not centre) gives the scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_pca(wide: DataFrame, tags: Sequence[str], k: int | None = None):
    from pyspark.ml.feature import PCA, VectorAssembler

    tags = list(tags)
    k = k or len(tags)
    assembled = VectorAssembler(inputCols=tags, outputCol="_x").transform(wide)
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(assembled)
    loadings = model.pc.toArray()          # tags x k
    signs = []
    for j in range(loadings.shape[1]):     # D14: largest |loading| positive
        col = loadings[:, j]
        best = max(range(len(tags)), key=lambda i: (abs(col[i]), -i))
        signs.append(-1.0 if col[best] < 0 else 1.0)
    loadings = loadings * signs
    return model, assembled, loadings, [float(v) for v in model.explainedVariance.toArray()]


def pca_scores(wide: DataFrame, tags: Sequence[str], k: int | None = None, group: bool = True) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    model, assembled, loadings, _ = fit_pca(wide, tags, k)
    raw = model.pc.toArray()
    pc = vector_to_array(F.col("_pc"))
    comps = []
    for j in range(loadings.shape[1]):
        flipped = bool((raw[:, j] * loadings[:, j]).sum() < 0)      # the model has its own sign of a component
        comps.append((-pc[j] if flipped else pc[j]).alias(f"PC{j + 1}"))
    cols = ["doc_id"] + (["Group"] if group and "Group" in wide.columns else [])
    return model.transform(assembled).select(*cols, *comps)


def pca_reconstruction(wide: DataFrame, tags: Sequence[str]) -> DataFrame:
    """(Tag_a, Tag_b, cov): the covariance that all components together give
    back, loadings x variances x loadings; equal to that of the input if the
    components are right.  tags x tags rows, bounded by the tagset."""
    tags = list(tags)
    _, _, loadings, share = fit_pca(wide, tags)
    total = wide.agg(*[F.var_samp(f"`{t}`") for t in tags]).first()
    cov = (loadings * share) @ loadings.T * sum(v or 0.0 for v in total)
    return wide.sparkSession.createDataFrame([(a, b, float(cov[i, j])) for i, a in enumerate(tags) for j, b in enumerate(tags)],
                                             "Tag_a string, Tag_b string, cov double")


def pca_score_norms(scores: DataFrame) -> DataFrame:
    """(doc_id, norm2): the squared length of each document's scores; over all
    components that of its z-scores, as rotations keep lengths."""
    comps = [F.pow(c, 2) for c in scores.columns if c.startswith("PC")]
    return scores.select("doc_id", sum(comps[1:], comps[0]).alias("norm2"))


def pca_variance(wide: DataFrame, tags: Sequence[str], k: int | None = None) -> DataFrame:
    _, _, _, ve = fit_pca(wide, tags, k)
    spark = wide.sparkSession
    return spark.createDataFrame([(f"PC{i + 1}", v) for i, v in enumerate(ve)], "PC string, variance_ratio double")


def contributions(loadings, tags: Sequence[str]) -> list[tuple[str, str, float]]:
    rows = []
    for j in range(loadings.shape[1]):
        col = loadings[:, j]
        total = float((col ** 2).sum())
        for i, t in enumerate(tags):
            v = float(col[i])
            c = 0.0 if v == 0 or total == 0 else (1.0 if v > 0 else -1.0) * v * v / total * 100.0
            rows.append((t, f"PC{j + 1}", c))
    return rows


def pca_contrib(wide: DataFrame, tags: Sequence[str], k: int | None = None) -> DataFrame:
    """(Tag, PC, contrib): sign x loading^2 x 100 (sd cancels); 0 if zero."""
    _, _, loadings, _ = fit_pca(wide, tags, k)
    return wide.sparkSession.createDataFrame(contributions(loadings, list(tags)), "Tag string, PC string, contrib double")


def pca_top_contrib(contrib: DataFrame, pcs: Sequence[str]) -> DataFrame:
    """Per component: tags with |contrib| above the component mean, sorted
    desc, formatted "Tag, x.xx%" and joined by "; "."""
    c = contrib.filter(F.col("PC").isin(list(pcs)))
    means = c.groupBy("PC").agg(F.avg(F.abs("contrib")).alias("_m"))
    big = c.join(means, "PC").filter(F.abs("contrib") > F.col("_m"))
    item = F.struct((-F.col("contrib")).alias("k"), F.concat(F.col("Tag"), F.lit(", "), F.format_string("%.2f", F.col("contrib")), F.lit("%")).alias("s"))
    return big.groupBy("PC").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), "; ").alias("top"))


def pca_contrib_bar(contrib: DataFrame, pc_x: str, pc_y: str) -> DataFrame:
    """Outer merge of two components on Tag (null -> 0), /100, with
    ``main`` flags for |x| above the component mean."""
    a = contrib.filter(F.col("PC") == pc_x).select("Tag", (F.col("contrib") / 100).alias(pc_x))
    b = contrib.filter(F.col("PC") == pc_y).select("Tag", (F.col("contrib") / 100).alias(pc_y))
    m = a.join(b, "Tag", "full_outer").na.fill(0.0)
    mx = m.select(F.avg(F.abs(pc_x))).scalar()
    my = m.select(F.avg(F.abs(pc_y))).scalar()
    return m.withColumn(f"main_{pc_x}", F.abs(pc_x) > mx).withColumn(f"main_{pc_y}", F.abs(pc_y) > my)
