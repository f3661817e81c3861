"""Counting straight from texts (``operators.text_counting``) against the document rows."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

ODD = ["In spite of it, the cat ran. The cat — of course — sat on THE mat of 12 cats!", " of the cat\n of  ", "of\tthe 2the 1a a'b a’b ab' 'ab l'a''b", None, "",
       "  ", "?!", "a'", "b", "ΟΔΟΣ Σ İ I K Å ẞ ǅ é é 中文汉 ½ ١٢ Ⅷ1 \U0001d7d8 😀!", "was; WAS! Because of the. \nDon’T it is not, . \t.", "of", "the"]


@pytest.fixture(scope="module")
def corpus(spark):
    from lexiflow.plans.corpus import Corpus

    rows = [(f"d_{i % 9}" if i else None, t) for i, t in enumerate(ODD)]
    rows += [(f"e_{i}", " ".join(w * (i % 3) for w in ("of the cat ", "was it; ", f"x{i} ", "on the other hand "))) for i in range(120)]
    return Corpus.from_documents(spark.createDataFrame(rows, "doc_id string, text string"))


def by_rows(c):
    """The same corpus, counted from its document rows."""
    return replace(c, texts=None)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("kind", ["pos", "ds"])
@pytest.mark.parametrize("span", [2, 3])
def test_frequent_ngrams_are_found_in_two_readings(corpus, kind, span):
    """F1, F8: n-grams below the asked frequency do not reach the shuffle (before: all, as strings), those above have all their counts."""
    from lexiflow.operators import text_counting

    for min_rf in (1.0, 3000.0, 20000.0):
        assert rows(corpus.ngrams(kind, span, min_rf)) == rows(by_rows(corpus).ngrams(kind, span, min_rf))
    texts = corpus.words(kind)
    every = text_counting.counted_grams(texts, span).filter("Token_1 IS NOT NULL").select("Token_1").count()
    likely = text_counting._likely(texts, span, 0.02)
    assert {r.docs > 0 for r in likely.filter("Token_1 IS NULL").collect()} >= {True}
    assert likely.filter("Token_1 IS NOT NULL").count() < every / 4
    assert len(text_counting.likely_grams(texts, span, 20000.0)) <= 100


def test_likely_ngrams_of_uneven_chunks(spark):
    """F1, F8: an n-gram that no chunk has often enough by itself, or only one chunk has, is still found."""
    from lexiflow.plans.corpus import Corpus

    texts = [("a " * 200 if i % 2 else "x y z ") + ("p q " * 7) for i in range(40)]
    c = Corpus.from_documents(spark.createDataFrame([(f"d_{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(7))
    for min_rf in (100.0, 10000.0, 40000.0, 500000.0):
        assert rows(c.ngrams("pos", 2, min_rf)) == rows(by_rows(c).ngrams("pos", 2, min_rf))


@pytest.mark.parametrize("kind", ["pos", "ds"])
def test_units_are_counted_from_texts(corpus, kind):
    """counts by Token and Tag or by Tag need no arrays of words (before: tokenized and tagged into arrays first)."""
    for tags_only in (False, True):
        assert "regexp" not in plan(corpus.counts(kind, tags_only)) and "ArrowEvalPython" not in plan(corpus.counts(kind, tags_only))
    assert rows(corpus.frequency(kind)) == rows(by_rows(corpus).frequency(kind))
    assert rows(corpus.tags(kind)) == rows(by_rows(corpus).tags(kind))
    sides = lambda c: c.subset(F.col("doc_id") < "e_3").keyness(c.subset(F.col("doc_id") > "d_4"), kind, threshold=1.0, direction="both")
    assert rows(sides(corpus)) == rows(sides(by_rows(corpus)))


def test_a_task_hands_on_each_key_once(spark):
    """a task adds up its pieces (before: a row per key and piece)."""
    from lexiflow.operators import text_counting
    from lexiflow.plans.corpus import Corpus

    texts = spark.createDataFrame([(str(i), "of the cat " * 3) for i in range(3)], "doc_id string, text string").coalesce(1)
    c = Corpus.from_documents(texts)
    assert c.counts("ds").count() == 2 + 1
    packed, lower = text_counting.alphabet(spark)
    reader = text_counting.Reader(packed, lower, ("ds",), {}, {"of the": "X"})
    import pyarrow as pa

    for x in (["of the"], ["cat of", "the of  the"]):
        code, sign, edges = reader.units(pa.array(x))
    assert [reader.pairs[i] for i in code] == [("cat", "Untagged"), ("of", "Untagged"), ("the", "Untagged"), ("of the", "X")] and edges.tolist() == [0, 2, 4]
    assert not sign.any()


@pytest.mark.parametrize("kind", ["pos", "ds"])
def test_neighbours_are_counted_from_texts(corpus, kind):
    """collocates need no arrays of words, and a task hands on each key once (before: a row per key and piece)."""
    from lexiflow.operators import docrows

    assert "regexp" not in plan(docrows.near_nodes(corpus.words(kind), "of", None, 3, 2))
    for node, tag, before, after in (("of", None, 3, 2), ("was", "Narr" if kind == "ds" else "VB", 0, 9), ("the", None, 9, 0), ("on the other hand", None, 1, 1)):
        a, b = (rows(docrows.near_nodes(c.words(kind), node, tag, before, after).groupBy("Token", "Tag").agg(
            F.sum("nodes"), F.sum("n"), F.max("is_node"))) for c in (corpus, by_rows(corpus)))
        assert a == b and len(a) > 50


def test_all_tables_are_counted_in_one_reading(corpus):
    """six tables from one table of counts (before: six passes over arrays of words)."""
    from lexiflow.operators.text_counting import tabulated

    c = replace(corpus, counted=tabulated(corpus.texts))
    for kind in ("pos", "ds"):
        for name in ("frequency", "tags", "dtm"):
            a, b = getattr(c, name)(kind), getattr(by_rows(corpus), name)(kind)
            assert rows(a) == rows(b) and a.schema == b.schema, (kind, name)
    assert "part" not in c.subset(F.lit(True)).counts("ds").columns and c.subset(F.lit(True)).counted is None


def test_bundle_rows_are_made_from_texts(spark, corpus, tmp_path):
    """document rows come from texts in small batches (before: batches of 10,000 rows through two functions), all tables as before."""
    from lexiflow.operators import text_counting
    from lexiflow.plans import corpus as plans

    made = text_counting.document_rows(corpus.texts)
    assert rows(made) == rows(corpus.rows) and made.schema == corpus.rows.schema
    kept = []
    own = spark.conf.get(plans.BATCH_SIZE)
    with plans.few_rows(spark):
        kept.append(spark.conf.get(plans.BATCH_SIZE))
    assert kept == ["256"] and spark.conf.get(plans.BATCH_SIZE) == own
    a = plans.Corpus.from_bundle(spark, corpus.save_bundle(str(tmp_path / "a")))
    b = plans.Corpus.from_bundle(spark, by_rows(corpus).save_bundle(str(tmp_path / "b")))
    assert rows(a.rows) == rows(b.rows) and rows(a.tokens) == rows(b.tokens)
    assert all(rows(a.tables[t]) == rows(b.tables[t]) for t in a.tables) and len(a.tables) == 7


def test_vocabulary_is_renewed(spark, monkeypatch):
    """A task whose vocabulary is full hands on its counts and numbers words anew."""
    import pyarrow as pa

    from lexiflow.operators import text_counting as tc

    monkeypatch.setattr(tc, "VOCABULARY", 2)
    monkeypatch.setattr(tc, "CHUNK", 3)
    seen = {}
    monkeypatch.setattr(tc.Texts, "mapped", lambda self, task, schema, size=None: seen.setdefault("task", task))
    docs = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    parts = [(pa.array([str(i)]), pa.array([f"of the w{i} of the cat cat."])) for i in range(4)]

    def run(make):
        seen.clear()
        make(tc.Texts(docs, "ds"))
        out = {}
        for columns in seen["task"](iter(parts)):
            for r in pa.RecordBatch.from_pydict(columns).to_pylist():
                key = tuple(v for k, v in r.items() if k not in ("n", "docs", "nodes", "is_node"))
                out[key] = out.get(key, np.zeros(2, int)) + [r["n"], r.get("docs", r.get("nodes"))]
        return {k: v.tolist() for k, v in out.items()}

    assert run(tc.counted)["of the", "InformationExposition"] == [8, 4] and run(tc.counted)[None, None] == [0, 4]
    assert run(lambda t: tc.counted(t, True))["Untagged",] == [20, 4]
    assert run(lambda t: tc.near_nodes(t, "cat", None, 1, 1))["of the", "InformationExposition"] == [8, 4]
    tables = run(tc.tabulated)
    assert tables["pos", "unit", None, "cat", "NN1"] == [8, 4] and tables["ds", "tag", None, None, "Untagged"] == [20, 4]
    assert tables["pos", "doc", "2", None, "NN1"] == [3, 1] and tables["ds", "unit", None, None, None] == [0, 4]
    grams = run(lambda t: tc.counted_grams(t, 2))
    assert grams["of the", "cat", "InformationExposition", "Untagged"] == [4, 4] and grams[None, None, None, None] == [28, 4]
    monkeypatch.setattr(tc, "likely_grams", lambda *a: [[("of the", "InformationExposition"), ("cat", "Untagged")], [("cat", "Untagged"), ("cat", "Untagged")]])
    grams = run(lambda t: tc.frequent_grams(t, 2, 10.0))
    assert grams == {("of the", "cat", "InformationExposition", "Untagged"): [4, 4], ("cat", "cat", "Untagged", "Untagged"): [4, 4], (None,) * 4: [28, 4]}
    assert run(lambda t: tc._likely(t, 2, 0.0))["cat", "cat", "Untagged", "Untagged"] == [4, 0]


def test_bytes_that_are_no_text(spark):
    """Bytes that are not UTF-8 are replaced, as the JVM does; texts stay apart."""
    import pyarrow as pa

    from lexiflow.operators import text_counting as tc

    values = pa.py_buffer(b"a\xffb\xc3\xa9")
    texts = pa.StringArray.from_buffers(3, pa.py_buffer(np.array([0, 2, 4, 5], np.int32)), values)      # (the é is cut in two)
    data, edges = tc._bytes(texts)
    assert data.tobytes().decode() == "a�b��" and edges.tolist() == [0, 4, 8, 11]
