"""Quality: a document classifier's evidence and its site's posterior.

Evidence: shape features of the whole text (shares of capitals, digits, signs,
bars, exclamation marks, words repeated at once, distinct words, repeated
lines, word length) are binned; the log-odds of each bin come from counts over
a bounded sample of labelled documents.

Site and path (here ``source``, and within it ``lang``): the mean posterior of
their documents, shrunk toward the level above by an empirical-Bayes weight.
The weight follows from how much sites differ beyond chance (method of
moments), so a site with few documents counts as the global prior.  All of it
is two grouped aggregations; the table of sites is broadcast only while it is
small, else joined.

A document's own evidence is left out of its site's and path's figures, so a
site of one document does not confirm itself: the two add up as independent
evidence.

A document is rejected if evidence and path posterior together give 0.5 or
more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .rows import with_columns
from .samples import ROWS_PER_CLASS, labelled_sample
from .words import runs, word_hashes
from .workers import lean

#: Upper edges of the bins of each feature (the last bin is open).
BINS = {
    "capitals": [0.03, 0.06, 0.12, 0.25, 0.5], "digits": [0.01, 0.05, 0.15, 0.4], "signs": [0.05, 0.2, 0.5, 1.5],
    "bars": [0.02, 0.1, 0.3], "shouts": [0.02, 0.1, 0.4], "echoes": [0.02, 0.05, 0.15, 0.4],
    "distinct": [0.1, 0.25, 0.4, 0.5, 0.6], "lines": [0.05, 0.2, 0.5], "length": [2.0, 3.5, 8.0, 15.0],
}
#: A path table of at most so many rows is broadcast.
BROADCAST_ROWS = 100_000
#: Evidence of one document is held within these log-odds.
MOST = 12.0

# Byte classes: capitals (ASCII, and the second byte of Latin-1 capitals after 0xC3), digits, signs, bar, shout.
_CAPITAL, _DIGIT, _SIGN, _BAR, _SHOUT, _LETTER = range(1, 7)
_KIND = np.zeros(256, np.uint8)
_KIND[ord("a"):ord("z") + 1] = _LETTER
_KIND[ord("A"):ord("Z") + 1] = _CAPITAL
_KIND[ord("0"):ord("9") + 1] = _DIGIT
_KIND[[ord(c) for c in "#$%&*@^~=+<>_\\"]] = _SIGN
_KIND[ord("|")] = _BAR
_KIND[ord("!")] = _SHOUT


def shapes(texts: list[str | None]) -> np.ndarray:
    """A row of features (in the order of BINS) for each text; null counts as empty."""
    out = np.zeros((len(texts), len(BINS)))
    for first, run in runs(texts):
        h, at, start, end = word_hashes(run)
        joined = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
        kind = _KIND[joined]
        latin = np.flatnonzero((joined[:-1] == 0xC3) & (joined[1:] >= 0x80))
        kind[latin + 1] = np.where(joined[latin + 1] <= 0x9E, _CAPITAL, _LETTER)
        edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in run])])
        counts = {k: np.diff(np.concatenate([[0], np.cumsum(kind == k)])[edge]) for k in range(1, 7)}
        breaks = joined == 0x0A
        width = end - start
        for i, t in enumerate(run):
            w = h[at[i]:at[i + 1]]
            n = max(len(w), 1)
            letters = max(counts[_LETTER][i] + counts[_CAPITAL][i], 1)
            lines = [x for x in t.split(b"\n") if x] if breaks[edge[i]:edge[i + 1] - 1].any() else [t]
            out[first + i] = (
                counts[_CAPITAL][i] / letters, counts[_DIGIT][i] / max(len(t), 1), counts[_SIGN][i] / n,
                counts[_BAR][i] / n, counts[_SHOUT][i] / n, (w[1:] == w[:-1]).sum() / n,
                _distinct(w), 1 - len(set(lines)) / max(len(lines), 1), width[at[i]:at[i + 1]].mean() if len(w) else 0.0)
    return out


def _distinct(w: np.ndarray) -> float:
    """Share of distinct words within stretches of 200, so that long texts compare with short ones."""
    if len(w) == 0:
        return 1.0
    parts = [w[i:i + 200] for i in range(0, len(w), 200)]
    return float(sum(len(np.unique(p)) for p in parts) / len(w))


def binned(texts: list[str | None]) -> np.ndarray:
    x = shapes(texts)
    return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(BINS.values())], 1)


class Evidence:
    """Log-odds of low quality per feature and bin; a few dozen numbers."""

    def __init__(self, tables: list[np.ndarray], prior: float):
        self.tables, self.prior = tables, prior

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        b = binned(texts)
        return np.clip(sum(t[b[:, k]] for k, t in enumerate(self.tables)), -MOST, MOST)


def _count_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            x = binned(list(b["text"]))
            yield pd.DataFrame({"y": np.repeat(b["y"].to_numpy(), x.shape[1]), "feature": np.tile(np.arange(x.shape[1]), len(x)),
                                "bin": x.ravel()})


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, id_col: str = "doc_id",
        text_col: str = "text", label: str = "quality") -> Evidence:
    """From at most ``rows`` labelled documents of each class outside the
    held-out fold.  Without labels of a class all evidence is 0."""
    sample, sizes = labelled_sample(docs.select(F.col(id_col), F.col(text_col).alias("text")), labels, label, rows, id_col)
    got = (sample.select("text", "y").mapInPandas(lean(_count_bins), "y int, feature int, bin int")
                 .groupBy("y", "feature", "bin").agg(F.count(F.lit(1)).alias("n")).collect())
    tables = []
    for k, edges in enumerate(BINS.values()):
        n = np.full((2, len(edges) + 1), 0.5)
        for r in got:
            if r["feature"] == k:
                n[r["y"], r["bin"]] += r["n"]
        p = n / n.sum(1, keepdims=True)
        tables.append(np.log(p[0] / p[1]) if min(sizes.get(0, 0), sizes.get(1, 0)) else np.zeros(len(edges) + 1))
    return Evidence(tables, math.log((sizes.get(0, 0) + 1) / (sizes.get(1, 0) + 1)))


def with_evidence(docs: DataFrame, evidence: Evidence, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``__llm_evidence``, the log-odds of low quality."""
    return with_columns(docs, [text_col], lambda texts: [evidence(texts).tolist()], [("__llm_evidence", T.DoubleType())])


def _logit(p):
    return F.log(p) - F.log(1 - p)


def _probability(prior: float):
    """A document's probability of low quality by its own evidence."""
    return 1 / (1 + F.exp(-(F.col("__llm_evidence") + F.lit(prior))))


class Sites:
    """Grouped evidence.  ``table``: (site, path, n, bad, sn, sbad), the number of
    documents and the sum of their probabilities in the path and in the site."""

    def __init__(self, scored: DataFrame, prior: float, site: str = "source", path: str = "lang"):
        self.prior = prior
        p = _probability(prior)
        paths = materialize(scored.groupBy(F.col(site).alias("__llm_site"), F.col(path).alias("__llm_path"))
                                  .agg(F.count(F.lit(1)).alias("__llm_n"), F.sum(p).alias("__llm_bad")), "quality-paths")
        sites = paths.groupBy(F.col("__llm_site").alias("_s")).agg(F.sum("__llm_n").alias("__llm_sn"), F.sum("__llm_bad").alias("__llm_sbad"))
        self.n, self.bad, self.site_weight = self._weight(sites, "__llm_sn", "__llm_sbad")
        _, _, self.path_weight = self._weight(paths, "__llm_n", "__llm_bad")
        self.table = paths.join(sites, F.col("__llm_site").eqNullSafe(F.col("_s"))).drop("_s")

    @staticmethod
    def _weight(t: DataFrame, n: str, bad: str) -> tuple[int, float, float]:
        """Documents, their sum of probabilities, and the documents that the level above is worth."""
        r = t.agg(F.sum(n).alias("n"), F.sum(bad).alias("b"), F.count(F.lit(1)).alias("k")).first()
        if not r["n"]:
            return 0, 0.0, 1.0
        m = min(max((r["b"] or 0) / r["n"], 1e-6), 1 - 1e-6)
        v = t.agg(F.sum(F.col(n) * F.pow(F.col(bad) / F.col(n) - m, 2)).alias("v")).first()["v"]
        between = max(v / r["n"] - m * (1 - m) * r["k"] / r["n"], 1e-6)
        return r["n"], r["b"], min(max(m * (1 - m) / between - 1, 1.0), 1e6)

    def posteriors(self):
        """(site, path) posteriors of a row that has its evidence and its line of ``table``:
        those of the other documents, shrunk from path to site to the global mean,
        and that toward the labels' share by one document."""
        p = _probability(self.prior)
        mean = (F.lit(self.bad) - p + F.lit(1 / (1 + math.exp(-self.prior)))) / F.lit(max(self.n, 1))
        site = (F.col("__llm_sbad") - p + self.site_weight * mean) / (F.col("__llm_sn") - 1 + self.site_weight)
        return site, (F.col("__llm_bad") - p + self.path_weight * site) / (F.col("__llm_n") - 1 + self.path_weight)


def judge(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text",
          site: str = "source", path: str = "lang") -> DataFrame:
    """All columns of ``docs`` and ``low_quality`` (0 to 1), ``site_posterior``,
    ``path_posterior``, ``rejected``; columns of these names are replaced.
    Null and empty texts have the evidence of an empty text; null sites and
    paths are groups of their own; the posteriors are those of the site's and path's
    other documents; repeated rows are judged alike; an empty table gives an empty result."""
    made = ["low_quality", "site_posterior", "path_posterior", "rejected"]
    docs = docs.drop(*made)
    evidence = fit(docs, labels, rows, id_col, text_col)
    sites = Sites(with_evidence(docs.select(site, path, text_col), evidence, text_col), evidence.prior, site, path)
    table = materialize(sites.table, "quality-posteriors")
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    out = with_evidence(docs, evidence, text_col).join(
        table, F.col(site).eqNullSafe(F.col("__llm_site")) & F.col(path).eqNullSafe(F.col("__llm_path")), "left")
    of_site, of_path = sites.posteriors()
    x = F.col("__llm_evidence") + _logit(F.least(F.greatest(of_path, F.lit(1e-6)), F.lit(1 - 1e-6)))
    p = 1 / (1 + F.exp(-x))
    return out.select(*docs.columns, p.alias("low_quality"), of_site.alias("site_posterior"), of_path.alias("path_posterior"),
                      (p >= 0.5).alias("rejected"))
