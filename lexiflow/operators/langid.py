"""Language identification, re-aimed as a Spark job.

Character-trigram naive Bayes: profiles are trigram counts per language (a
groupBy over labelled documents, add-one smoothing).  A document is never
scored by a model that was trained on it: documents fall in two folds by a hash
of their id, and each fold is scored by the profiles of the other one.

Profiles are one row per (fold, trigram) with a column per language, so scoring
is one join and one sum per document: trigrams of the whole text are combined
before the only shuffle, which carries one row per document and task.  The
profile table is bounded by the trigram alphabet; Spark broadcasts it while it
is small and joins by a shuffle beyond that.  A softmax gives P(language).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

THRESHOLD = 0.9
FOLDS = 2


def fold_of(doc_id: Column) -> Column:
    """0 or 1, by the first hex digit of the id's MD5."""
    return F.when(F.substring(F.md5(doc_id.cast("string")), 1, 1) < "8", F.lit(0)).otherwise(F.lit(1))


def normalised(text: Column) -> Column:
    t = F.lower(F.regexp_replace(text, r"[^\p{L}]+", " "))
    return F.concat(F.lit(" "), F.trim(t), F.lit(" "))


def trigrams(df: DataFrame, text: str = "text") -> DataFrame:
    """Every overlapping character trigram of the whole normalised text (a
    zero-width lookahead match per position; JVM-side, no lambda).  A text
    without letters, or null, is one row with a null ``gram``."""
    grams = F.regexp_extract_all(normalised(F.col(text)), F.lit("(?=(.{3}))"), 1)
    return df.select("*", F.explode_outer(grams).alias("gram"))


@dataclass(frozen=True)
class Profiles:
    """``table``: (fold, gram, p0, p1, ...) log-probabilities, null where a language lacks
    the trigram; ``unseen[fold][i]``: that of any such trigram, None if the fold has no
    document of the language.  Column ``p<i>`` belongs to ``languages[i]``."""

    table: DataFrame
    languages: list[str]
    unseen: list[list[float | None]]


def train_profiles(labelled: DataFrame, doc_id: str = "doc_id", lang: str = "lang") -> Profiles:
    """Profiles for each fold from the labelled documents of the other one.
    Rows without a label teach nothing.  Only totals per fold and language (a
    handful of rows) come to the driver."""
    docs = labelled.filter(F.col(lang).isNotNull()).select(
        (1 - fold_of(F.col(doc_id))).alias("fold"), F.col(lang).alias("lang"), "text")
    counts = materialize(trigrams(docs).filter("gram IS NOT NULL").groupBy("fold", "lang", "gram")
                         .agg(F.count(F.lit(1)).alias("c")), "lang-counts")
    totals = {(r.fold, r.lang): r.n for r in
              counts.groupBy("fold", "lang").agg((F.sum("c") + F.count(F.lit(1)) + 1).alias("n")).collect()}
    languages = sorted({lang for _, lang in totals})
    n = [[totals.get((f, lang)) for lang in languages] for f in range(FOLDS)]
    size = _of_fold(n, languages)
    best = [F.max(F.when(F.col("lang") == lang, F.log((F.col("c") + 1) / size[i]))).alias(f"p{i}")
            for i, lang in enumerate(languages)]
    table = counts.groupBy("fold", "gram").agg(*(best or [F.count(F.lit(1)).alias("none")]))
    return Profiles(materialize(table, "lang-profiles"), languages,
                    [[None if v is None else -math.log(v) for v in row] for row in n])


def _of_fold(values: list[list], languages: list[str]) -> list[Column]:
    """One Column per language: its value for the row's fold."""
    return [F.when(F.col("fold") == 0, F.lit(values[0][i]).cast("double")).otherwise(F.lit(values[1][i]).cast("double"))
            for i in range(len(languages))]


def language_scores(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang, p): posterior per language (uniform prior) under the model
    that has not seen the document.  Rows with one id (segments) count as one
    document.  A text without letters, or null, has the prior.  A language that
    the model has no document of has p = 0; without any labelled document the
    result is empty."""
    names = profiles.languages
    if not names:
        return docs.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("p")).limit(0)
    grams = trigrams(docs.select("doc_id", fold_of(F.col("doc_id")).alias("fold"), "text")).drop("text")
    floor = _of_fold(profiles.unseen, names)
    sums = [F.sum(F.when(F.col("gram").isNotNull(), F.coalesce(f"p{i}", floor[i])).otherwise(floor[i] * 0)).alias(f"s{i}")
            for i in range(len(names))]
    per_doc = grams.join(profiles.table, ["fold", "gram"], "left").groupBy("doc_id").agg(*sums)
    best = F.greatest(*[F.col(f"s{i}") for i in range(len(names))]) if len(names) > 1 else F.col("s0")
    odds = [F.coalesce(F.exp(F.col(f"s{i}") - best), F.lit(0.0)) for i in range(len(names))]
    each = F.array(*[F.struct(F.lit(lang).alias("lang"), odds[i].alias("e")) for i, lang in enumerate(names)])
    total = sum(odds[1:], odds[0])
    return (per_doc.select("doc_id", total.alias("total"), F.explode(each).alias("x"))
                   .select("doc_id", F.col("x.lang").alias("lang"), F.coalesce(F.try_divide("x.e", "total"), F.lit(0.0)).alias("p")))


def language_filter(docs: DataFrame, profiles: Profiles, target: str = "en", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_target, passed): a row per document; p is 0 if the target language was never learned."""
    s = language_scores(docs, profiles).groupBy("doc_id").agg(
        F.coalesce(F.max(F.when(F.col("lang") == target, F.col("p"))), F.lit(0.0)).alias("p_target"))
    return s.withColumn("passed", F.col("p_target") > threshold)


def language_confusion(labelled: DataFrame, profiles: Profiles, doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(lang, predicted, n_docs): labels against the likeliest language, each
    document judged by the model that has not seen it (ties: smaller code)."""
    said = labelled.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("label"), "text")
    best = (language_scores(said, profiles).groupBy("doc_id")
            .agg(F.min(F.struct((-F.round("p", 9)).alias("k"), "lang"))["lang"].alias("predicted")))
    return (said.select("doc_id", "label").join(best, "doc_id")
                .groupBy(F.col("label").alias("lang"), "predicted").agg(F.count(F.lit(1)).alias("n_docs")))
