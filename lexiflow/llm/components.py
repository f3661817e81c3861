"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links``
    (columns a, b).  Each round every node takes its smallest neighbour (a
    grouped minimum, combined before the shuffle), links are rewritten to those
    labels, and loops and repeats go; a star ends after one round, and at least
    half the nodes of any other component go in each."""
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                             .filter("a <> b").distinct(), "links")
    labels = None
    while True:
        nearest = (edges.select(F.col("b").alias("id"), F.col("a").alias("to"))
                        .unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("to")))
                        .groupBy("id").agg(F.min("to").alias("to")))
        nearest = materialize(nearest, "nearest")
        if labels is None:
            labels = nearest.select("id", F.col("to").alias("component"))
        else:
            n = nearest.select(F.col("id").alias("_from"), "to")
            labels = materialize(labels.join(n, F.col("component") == F.col("_from"), "left")
                                       .select("id", F.coalesce("to", "component").alias("component")), "labels")
        na = nearest.select(F.col("id").alias("a"), F.col("to").alias("x"))
        nb = nearest.select(F.col("id").alias("b"), F.col("to").alias("y"))
        edges = materialize(edges.join(na, "a").join(nb, "b").filter("x <> y")
                                 .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels
