"""Hand fixture with known answers (FIXTURES.md §2)."""

import math

import pytest
from pyspark.sql import functions as F

from lexiflow.functions.tags import simplify_tag
from lexiflow.operators import colloc, docview, freq, keyness, kwic, meta
from lexiflow.plans.corpus import Corpus


def rows(df, key):
    return {key(r): r for r in df.collect()}


def test_corpus_summary(fixture_corpus):
    r = fixture_corpus.summary().first()
    assert (r.tokens_pos, r.tokens_ds, r.ndocs) == (11, 11, 2)
    assert r.tags_pos == ["AT", "FU", "II", "NN1", "PPH1", "VVD"]
    assert r.tags_ds == ["Character", "Narrative", "Reasoning"]
    assert r.model == "Large Dictionary"


def test_token_freq_pos(fixture_corpus):
    ft = rows(fixture_corpus.frequency("pos"), lambda r: (r.Token, r.Tag))
    assert sum(r.AF for r in ft.values()) == 11
    assert ft[("cat", "NN1")].AF == 3 and ft[("cat", "NN1")].RF == pytest.approx(272727.272727)
    assert ft[("cat", "NN1")].Range == 100 and ft[("the", "AT")].AF == 3
    sp = ft[("in spite of", "II")]
    assert (sp.AF, sp.Range) == (1, 50) and sp.RF == pytest.approx(90909.090909)


def test_token_freq_ds(fixture_corpus):
    ft = rows(fixture_corpus.frequency("ds"), lambda r: (r.Token, r.Tag))
    assert sum(r.AF for r in ft.values()) == 15
    assert ft[("cat", "Character")].AF == 3 and ft[("cat", "Character")].RF == pytest.approx(200000)
    assert ft[("in spite of", "Reasoning")].AF == 1


def test_tag_tables(fixture_corpus):
    tp = rows(fixture_corpus.tags("pos"), lambda r: r.Tag)
    assert tp["AT"].AF == 3 and tp["AT"].RF == pytest.approx(27.272727) and tp["AT"].Range == 100
    assert tp["VVD"].AF == 2 and tp["VVD"].Range == 50
    assert tp["FU"].RF == pytest.approx(9.090909)
    td = rows(fixture_corpus.tags("ds"), lambda r: r.Tag)
    assert td["Untagged"].AF == 10 and td["Untagged"].RF == pytest.approx(66.666667)
    assert td["Character"].RF == pytest.approx(20) and td["Reasoning"].Range == 50


def test_simplify(spark):
    df = spark.createDataFrame([(t,) for t in ["AT", "NN1", "VVD", "II", "PPH1", "FU", "VBZ", "NP1", "JJ", "RR"]], "t string")
    got = {r.t: r.s for r in df.select("t", simplify_tag("t").alias("s")).collect()}
    assert got == {"AT": "Other", "NN1": "NounCommon", "VVD": "VerbLex", "II": "Preposition", "PPH1": "Pronoun",
                   "FU": "Other", "VBZ": "VerbBe", "NP1": "NounOther", "JJ": "Adjective", "RR": "Adverb"}


def test_ngrams_pos(fixture_corpus):
    c = fixture_corpus
    t = rows(c.ngrams("pos", 2, None),
             lambda r: (r.Token_1, r.Token_2))
    assert t[("the", "cat")].AF == 3 and t[("the", "cat")].Range == 100
    assert t[("the", "cat")].RF == pytest.approx(272727.272727)
    for k in [("cat", "sat"), ("cat", "ran"), ("cat", "xyz"), ("in spite of", "it")]:
        assert t[k].AF == 1
    assert all("." not in k and "," not in k for k in t)   # nothing crosses punctuation


def test_keyness_tags(fixture_corpus):
    c = fixture_corpus
    a = c.analytic("pos").filter(F.col("doc_id").startswith("A"))
    b = c.analytic("pos").filter(F.col("doc_id").startswith("B"))
    k = rows(keyness.keyness_table(a, b, tags_only=True, threshold=1.0, direction="both"),
             lambda r: r.Tag)
    assert k["VVD"].LL == pytest.approx(2.424543, abs=1e-6)
    assert k["VVD"].LR == pytest.approx(1.736966, abs=1e-6)
    assert k["VVD"].PV == pytest.approx(0.119448, abs=1e-6)
    assert k["NN1"].LL == pytest.approx(0.182373, abs=1e-6) and k["NN1"].PV == pytest.approx(0.669342, abs=1e-6)
    assert k["II"].LL == pytest.approx(-1.576915, abs=1e-6) and k["II"].LR == pytest.approx(-1.263034, abs=1e-6)
    strict = keyness.keyness_table(a, b, tags_only=True, threshold=0.05, direction="both")
    assert strict.count() == 0


def test_collocates(fixture_corpus):
    u = fixture_corpus.words("pos")
    res = {}
    for stat in ("pmi", "npmi", "pmi2", "pmi3"):
        for r in colloc.coll_table(u, "cat", None, 1, 1, stat).collect():
            res[(r.Token, stat)] = r
    assert (res[("the", "pmi")].freq_span, res[("the", "pmi")].freq_total) == (3, 3)
    assert res[("the", "pmi")].mi == pytest.approx(1.874469, abs=1e-6)
    assert res[("the", "npmi")].mi == pytest.approx(1.0)
    assert res[("the", "pmi2")].mi == pytest.approx(0.0, abs=1e-9)
    assert res[("the", "pmi3")].mi == pytest.approx(-1.874469, abs=1e-6)
    for w in ("sat", "ran", "xyz"):
        assert res[(w, "pmi")].freq_span == 1
        assert res[(w, "npmi")].mi == pytest.approx(0.541843, abs=1e-6)
        assert res[(w, "pmi2")].mi == pytest.approx(-1.584963, abs=1e-6)
        assert res[(w, "pmi3")].mi == pytest.approx(-5.044394, abs=1e-6)


def test_kwic(fixture_tokens):
    got = {(r.doc_id, r.token_idx): (r.pre, r.node, r.post) for r in kwic.kwic(fixture_tokens, "cat", reach=2).collect()}
    assert got == {("A_1", 1): ("The", "cat", "sat."), ("A_1", 5): (". The", "cat", "ran."),
                   ("B_1", 6): (", the", "cat", "xyz.")}


def test_doc_views(fixture_corpus):
    spans = docview.doc_spans(fixture_corpus.units("pos"), "pos").filter("doc_id = 'A_1'").orderBy("pos").collect()
    assert [s.tag_start for s in spans] == [0, 3, 6, 9, 10, 13, 16, 19]
    assert [s.tag_end for s in spans] == [3, 6, 9, 10, 13, 16, 19, 20]
    assert spans[0].Text == '<span class="AT">The</span> '
    counts = rows(docview.doc_tag_counts(fixture_corpus.units("pos")).filter("doc_id = 'A_1'"), lambda r: r.Tag)
    assert {t: r.AF for t, r in counts.items()} == {"AT": 2, "NN1": 2, "VVD": 2}
    assert counts["AT"].RF == pytest.approx(33.333333)
    pos = docview.doc_tag_positions(fixture_corpus.units("pos"), ["NN1"]).filter("doc_id = 'A_1'").orderBy("pos").collect()
    assert [p.X for p in pos] == [0.25, 0.75]


def test_tagged_text(fixture_corpus):
    pos = {r.doc_id: r.text for r in docview.tagged_text(fixture_corpus.units("pos"), "pos").collect()}
    assert pos["A_1"] == "The|AT cat|NN1 sat|VVD . The|AT cat|NN1 ran|VVD ."
    assert pos["B_1"] == "In_spite_of|II it|PPH1 , the|AT cat|NN1 xyz ."
    ds = {r.doc_id: r.text for r in docview.tagged_text(fixture_corpus.units("ds"), "ds").collect()}
    assert ds["A_1"] == "The cat|Character sat . The cat|Character ran|Narrative ."
    assert ds["B_1"] == "In_spite_of|Reasoning it , the cat|Character xyz ."


def test_box_data_drops_before_weighting(fixture_corpus):
    from lexiflow.operators import groupstats

    d = freq.drop_non_analytic(fixture_corpus.dtm("pos").filter(F.col("Tag") != "FU"))
    dense = freq.dtm_dense(freq.dtm_weight_prop(d).select("doc_id", "Tag", "RF"), value="RF")
    box = {r.doc_id: r for r in groupstats.box_data(dense, ["NN1"]).collect()}
    assert box["A_1"].RF == pytest.approx(33.333333) and box["B_1"].RF == pytest.approx(25.0)
    assert box["A_1"].Median == pytest.approx(29.166667)


def test_categories(spark):
    ids = spark.createDataFrame([("A_1",), ("B_1",)], "doc_id string")
    cats = meta.doc_categories(ids)
    assert sorted(r.category for r in cats.collect()) == ["A", "B"]
    assert meta.category_gate(cats).first().accepted
    bad = spark.createDataFrame([("A_1",), ("B",)], "doc_id string")
    assert meta.doc_categories(bad).count() == 0


def test_node_word_rules(fixture_corpus):
    with pytest.raises(ValueError):
        fixture_corpus.collocates("two words")
    with pytest.raises(ValueError):
        fixture_corpus.ngrams("pos", 11)


_ = (math, Corpus)
