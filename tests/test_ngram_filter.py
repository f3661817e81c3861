"""Filters on tables of n-grams."""

from __future__ import annotations


def test_filtered_ngrams_read_texts_once(spark):
    """the filter stays above the shuffle that table and totals share (before: two readings, two shuffles)."""
    from lexiflow.plans import catalog

    found = catalog.import_all()["ngram_tag_filter"](spark, "/root/testdata/sf0.001")
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("ReusedExchange" in x for x in final.splitlines()) == 1, final
