"""Shared steps that grew too slowly: the taggers, the import of token tables, tables written once."""

from lexiflow.functions.lexicon import DS_LEXICON, POS_LEXICON
from lexiflow.operators import tagging
from lexiflow.operators.tagging import SUFFIX_RULES

ODD = ["In  spite\nof it, ON the Other hand... we walk12ed", "² ١٢ 5٣ KKing gloriously “no” — ΑΣ.\n!  ?", "", " \n"]


def plain_tag(s: str) -> str:
    import unicodedata

    kinds = {unicodedata.category(c)[0] for c in s}
    if len(s) == 1 and not kinds & {"L", "N"}:
        return "Y"
    if kinds == {"N"}:
        return "MC"
    if s.lower() in POS_LEXICON:
        return POS_LEXICON[s.lower()]
    return "FU" if not s.isascii() else next((t for ends, t in SUFFIX_RULES if s.lower().endswith(ends)), "NN1")


def test_taggers_by_batch_match_plain_python(spark):
    """Tags and units come from batches of words (before: lambdas, word by word) and equal a plain version."""
    docs = spark.createDataFrame([(f"o_{i}", t) for i, t in enumerate([*ODD, None])], "doc_id string, text string")
    rows = tagging.document_units(docs)
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") >= 1
    for r in rows.collect():
        if r.toks is None:
            assert r.tags is None and r.units == []
            continue
        words = [t.rstrip(tagging.arrow_tagging.WS) for t in r.toks]
        assert r.low == [w.lower() for w in words]
        assert r.tags == [plain_tag(w) for w in words]
        i, expected = 0, []
        while i < len(words):
            n = next((n for n in range(4, 0, -1) if i + n <= len(words) and " ".join(r.low[i:i + n]) in DS_LEXICON), 0)
            key = " ".join(r.low[i:i + max(n, 1)])
            expected.append((i, max(n, 1), DS_LEXICON[key] if n else "Untagged", key,
                             not n and words[i] in tagging.arrow_tagging.PUNCT and r.toks[i][1:].strip(" ") == ""))
            i += max(n, 1)
        assert [tuple(u) for u in r.units] == expected


def test_import_numbers_runs_without_ranking(spark, tmp_path):
    """Documents whose rows stand together are numbered without a window; scattered ones as before."""
    from lexiflow.operators import ingest

    names = [f.name for f in ingest.TOKEN_SCHEMA.fields]
    docs = ["a"] * 5 + ["b"] * 3 + [None] * 2 + ["c"]
    rows = [(d, f"{d}{i} ", "NN1", "Untagged", i, i) for i, d in enumerate(docs)]
    path = str(tmp_path / "together")
    spark.createDataFrame(rows, ingest.TOKEN_SCHEMA).coalesce(1).write.parquet(path)
    found = ingest.load_token_parquet(spark, path)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    first = {d: docs.index(d) for d in docs}
    assert sorted((r.token, r.token_idx) for r in found.collect()) == sorted((r[1], r[4] - first[r[0]]) for r in rows)
    spark.createDataFrame([rows[5], *rows[:5], *rows[6:]], ingest.TOKEN_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "cut"))
    cut = {(r.token, r.token_idx) for r in ingest.load_token_parquet(spark, str(tmp_path / "cut")).select("token_idx", *names).collect()}
    assert cut == {(r[1], r[4] - first[r[0]]) for r in rows}


def test_runs_go_on_between_batches():
    import pyarrow as pa

    from lexiflow.operators.ingest import run_starts

    docs, files, at = ["a", "a", "a", "b", None, None, "a"], ["f"] * 6 + ["g"], [3, 4, 5, 6, 7, 8, 0]
    for k in (1, 2, 3, 7):
        parts = [tuple(pa.array(x[i:i + k], t) for x, t in ((docs, pa.string()), (files, pa.string()), (at, pa.int64()))) for i in range(0, 7, k)]
        assert [v for p in run_starts(iter(parts)) for v in p.to_pylist()] == [3, 3, 3, 6, 7, 7, 0]


def test_clustered_tokens_shuffle_only_repeated_ids(spark):
    from lexiflow.plans.corpus import Corpus, clustered

    once = spark.createDataFrame([("a_1", "The cat sat."), ("b_1", "In spite of it.")], "doc_id string, text string")
    assert "Exchange" not in Corpus.from_documents(once).clustered_tokens()._jdf.queryExecution().executedPlan().toString()
    twice = Corpus.from_documents(once.union(once.limit(1)).union(spark.createDataFrame([(None, "x y"), (None, "x")], once.schema)))
    assert sorted(map(str, twice.clustered_tokens().collect())) == sorted(map(str, clustered(twice.tokens).collect()))


def test_tables_are_exported_from_rows_tagged_once(spark, monkeypatch):
    from lexiflow.plans import catalog, q_docs

    kept, write = [], q_docs.materialize
    monkeypatch.setattr(q_docs, "materialize", lambda df, name: kept.append(name) or write(df, name))
    out = {(r.table, r.format): r.rows for r in catalog.import_all()["export_all_tables"](spark, "/root/testdata/sf0.001").collect()}
    assert kept == ["export-rows"] and all(out[t, "csv"] == n for (t, f), n in out.items() if f == "parquet") and len(out) == 12


def test_paths_of_many_texts_equal_paths_one_by_one():
    import numpy as np

    from lexiflow.operators.trained_tagger import TagModel

    r = np.random.default_rng(1)
    model = TagModel(["a", "b", "c"], None, None, None, np.log(r.integers(1, 4, (4, 3)) / 6))
    evidence, sizes = np.log(r.integers(1, 4, (9, 3)) / 6), np.array([4, 0, 1, 17, 4])
    at, ends = r.integers(0, 9, sizes.sum()), np.cumsum(sizes)
    each = [model.best_path(evidence[at[e - n:e]]) for e, n in zip(ends, sizes) if n]
    assert model.best_paths(evidence, at, sizes).tolist() == np.concatenate(each).tolist()


COUNTED = [("a_1", "In spite of it, the cat ran. The cat — of course — sat on THE mat of 12 cats!"), ("b_1", " of the cat\n of  "),
           ("b_1", "cat of the cat"), (None, "of"), ("c_1", None), ("d_1", ""), ("e_1", "?!")]


def plain_words(r, kind):
    """(Token, Tag, whether punctuation) per unit of a collected document row."""
    if kind == "pos":
        return [(low, tag, tag == "Y") for low, tag in zip(r.low or [], r.tags or [])]
    return [(u.key, u.tag, u.punct) for u in r.units]


def test_rows_counted_by_batch_match_plain_python(spark, monkeypatch):
    """Frequencies, n-grams, neighbours and matrices are counted by pieces of batches (before: lambdas and explosions, unit by unit)."""
    from collections import Counter

    from lexiflow.operators import arrow_counting, docrows
    from lexiflow.plans.corpus import Corpus

    c = Corpus.from_documents(spark.createDataFrame(COUNTED, "doc_id string, text string"))
    rows = c.rows.collect()
    for kind in ("pos", "ds"):
        assert "MapInArrow" in docrows.counted_grams(c.words(kind), 2)._jdf.queryExecution().executedPlan().toString()
        units = [plain_words(r, kind) for r in rows]
        words = [[u for u in us if not u[2]] for us in units]
        counting = [[u[:2] for u in (w if kind == "pos" else us)] for us, w in zip(units, words)]
        grams = [[us[i:i + 2] for i in range(len(us) - 1) if not us[i][2] and not us[i + 1][2]] for us in units]
        grams = [[(x[0], y[0], x[1], y[1]) for x, y in g] for g in grams]
        some = sum((r.n or 0) > 0 for r in rows)
        for found, items, total in ((c.counts(kind), counting, 0), (docrows.counted_grams(c.words(kind), 2), grams, sum(map(len, counting))),
                                    (c.counts(kind, tags_only=True), [[x[1:] for x in items] for items in counting], 0)):
            n, docs, got_n, got_docs = Counter(), Counter(), Counter(), Counter()
            for items_of in items:
                n.update(items_of)
                docs.update(set(items_of))
            width = len(found.columns) - 2
            n[(None,) * width], docs[(None,) * width] = total, some
            for r in found.collect():
                got_n[tuple(r[:width])] += r.n
                got_docs[tuple(r[:width])] += r.docs
            assert (+got_n, got_docs) == (+n, docs)
        near = Counter()
        for w in words:
            for i, x in enumerate(w):
                near[x[:2]] += sum(y[0] == "of" for y in w[max(i - 2, 0):i] + w[i + 1:i + 4])
        got = Counter()
        for r in docrows.near_nodes(c.words(kind), "of", None, 3, 2).collect():
            got[r.Token, r.Tag] += r.nodes
        assert +got == +near
        matrix = Counter((r.doc_id, tag) for r, items in zip(rows, counting) for _, tag in items)
        assert {(r.doc_id, r.Tag): r.n for r in c.dtm(kind).collect()} == dict(matrix)
    import pyarrow as pa

    monkeypatch.setattr(arrow_counting, "WORDS", 3)
    batch = pa.RecordBatch.from_pydict({"x": pa.array([[1], [2, 3], None, [4] * 9, [], [5]])})
    assert [len(p["x"]) for p in arrow_counting.pieces([batch], "x")] == [3, 1, 2]
    monkeypatch.setattr(arrow_counting, "MOST", 4)
    import numpy as np

    many = arrow_counting.combined([(np.array([0, 1, 0, 1]), 2), (np.array([0, 2, 0, 1]), 3), (np.array([1, 0, 1, 1]), 2)])[0]
    assert many[0] == many[2] and len(set(many.tolist())) == 3


def test_spans_listed_by_batch_match_plain_python(spark):
    """Spans come from batches (before: running sums by appending, tags simplified by ten patterns each)."""
    from lexiflow.functions.tags import simplify_tag
    from lexiflow.plans.corpus import Corpus

    c = Corpus.from_documents(spark.createDataFrame(COUNTED, "doc_id string, text string"))
    rows = c.rows.collect()
    tags = sorted({t for r in rows for t in r.tags or []})
    simple = {r.t: r.s for r in spark.createDataFrame([(t,) for t in tags], "t string").select("t", simplify_tag("t").alias("s")).collect()}
    for view, plain in (("pos", "Y"), ("simple", "Other"), ("ds", "Untagged")):
        found = c.spans(view)
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
        expected = []
        for r in rows:
            units = [(u.pos, "".join(r.toks[u.pos:u.pos + u.n]), u.tag) for u in r.units] if view == "ds" else [
                (i, t, simple[tag] if view == "simple" else tag) for i, (t, tag) in enumerate(zip(r.toks or [], r.tags or []))]
            end = 0
            for pos, text, tag in units:
                token = text.strip(tagging.arrow_tagging.WS)
                last = text[-1] if text[-1] in tagging.arrow_tagging.WS else ""
                expected.append((r.doc_id, pos, token, tag, end, end + len(token),
                                 (token if tag == plain else f'<span class="{tag}">{token}</span>') + last))
                end += len(token)
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


def test_matrix_is_written_once_for_tables_by_name(spark, monkeypatch):
    """The dense tables read a stored matrix (before: the corpus was tagged again in each pass)."""
    from lexiflow.plans import q_stats, views
    from lexiflow.plans.catalog import import_all

    kept, write = [], views.materialize
    for module in (views, q_stats):
        monkeypatch.setattr(module, "materialize", lambda df, name: kept.append(name) or write(df, name))
    for name in ("table_by_name", "scatter_axis_share"):
        plan = import_all()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan
    assert kept == ["dtm-pos", "dtm-pos"]
