"""Registered queries against their DuckDB twins on the smallest tables."""

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E

QUICK = ["token_freq_pos", "token_freq_ds", "tag_freq_ds", "keyness_tags_pos", "ngrams_ds", "collocates_pmi",
         "kwic", "box_stats", "doc_spans_ds", "tagged_text_pos", "rolling_quota", "message_intent", "prune_thread",
         "corpus_summary", "dtm_weight_scale"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["documents", "events", "conversations", "labels", "benchmark"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    a = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    b = sorted((tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert a == b


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["Token", "Tag", "AF", "RF", "Range"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
