"""Invariants on real data (sf0.001) and brute-force cross-checks."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lexiflow.functions.lexicon import DS_LEXICON
from lexiflow.operators import colloc, freq, groupstats, keyness, sequence
from lexiflow.plans.catalog import corpus as english
from lexiflow.plans.corpus import Corpus


@pytest.fixture(scope="module")
def corpus(spark):
    return english(spark, SF_SMALL)


def test_tokens_rebuild_text(corpus):
    toks = corpus.tokens.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "token"))), lambda x: x["token"]), "").alias("t"))
    docs = corpus.docs.select("doc_id", F.regexp_replace(F.regexp_replace("text", r"\s+$", ""), r"^\s+", "").alias("text"))
    bad = toks.join(docs, "doc_id").filter(F.col("t") != F.col("text")).count()
    assert bad == 0


def test_frequency_sums(corpus):
    ft = corpus.frequency("pos").agg(F.sum("AF"), F.sum("RF")).first()
    assert ft[0] == corpus.analytic("pos").count()
    assert ft[1] == pytest.approx(1_000_000)
    tt = corpus.tags("ds").agg(F.sum("RF")).first()[0]
    assert tt == pytest.approx(100)


def test_prop_rows_sum_to_one(corpus):
    p = freq.dtm_weight_prop(corpus.dtm("pos")).groupBy("doc_id").agg(F.sum("RF").alias("s"))
    assert p.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_keyness_swap_flips_sign(spark):
    from lexiflow.plans.catalog import reference, target

    t, r = target(spark, SF_SMALL), reference(spark, SF_SMALL)
    a = {x.Tag: x.LL for x in t.keyness(r, "pos", tags_only=True, threshold=1.0, direction="both").collect()}
    b = {x.Tag: x.LL for x in t.keyness(r, "pos", tags_only=True, threshold=1.0, direction="both", swap_target=True).collect()}
    # unit rows (imported token tables) give the same as document rows
    c = {x.Tag: x.LL for x in keyness.keyness_table(t.analytic("pos"), r.analytic("pos"), tags_only=True, threshold=1.0,
                                                    direction="both").collect()}
    assert a == pytest.approx(c)
    assert a and set(a) == set(b)
    for k in a:
        assert a[k] == pytest.approx(-b[k], abs=1e-9)


def test_blocked_prefix_sum_matches_plain(spark, corpus, monkeypatch):
    """Force tiny blocks so long documents span many blocks."""
    monkeypatch.setattr(sequence, "BLOCK", 7)
    t = corpus.pos_tokens.select("doc_id", "token_idx", F.length("token").alias("L"))
    got = sequence.prefix_sum(t, ["doc_id"], "token_idx", F.col("L").cast("long"), "cs").select("doc_id", "token_idx", "cs")
    from pyspark.sql import Window
    w = Window.partitionBy("doc_id").orderBy("token_idx").rowsBetween(Window.unboundedPreceding, 0)
    ref = t.withColumn("cs2", F.sum("L").over(w))
    assert got.join(ref, ["doc_id", "token_idx"]).filter(F.col("cs") != F.col("cs2")).count() == 0


def test_blocked_windows_match_unblocked(spark, corpus, monkeypatch):
    """n-grams and collocations from a token table in tiny blocks equal those of document rows, for both kinds of unit."""
    table = Corpus(corpus.tokens, single_token_pos=True)
    monkeypatch.setattr(sequence, "BLOCK", 12)
    near = lambda rows: {tuple(r)[:-2]: pytest.approx(tuple(r)[-2:]) for r in rows}
    for kind in ("pos", "ds"):
        a, b = corpus.ngrams(kind, 3, None).collect(), table.ngrams(kind, 3, None).collect()
        assert len(a) == len(b) > 0 and near(a) == {tuple(r)[:-2]: tuple(r)[-2:] for r in b}
        a, b = (sorted(colloc.span_counts(c.words(kind), "the", None, 3, 2).collect()) for c in (corpus, table))
        assert a == b and len(a) > 0


def test_collocation_equals_exploded_join(corpus):
    """Window weights equal the brute-force offset join."""
    u = sequence.dense_rank_in_doc(corpus.units("pos").filter(F.col("Tag") != "Y"), ["doc_id"], "pos", "ord")
    nodes = u.filter(F.col("Token") == "of").select("doc_id", F.col("ord").alias("q"))
    off = nodes.select("doc_id", F.explode(F.array(*[F.col("q") + k for k in range(-4, 5) if k != 0])).alias("ord"))
    brute = off.join(u, ["doc_id", "ord"]).groupBy("Token", "Tag").agg(F.count(F.lit(1)).alias("b"))
    win = colloc.span_counts(corpus.words("pos"), "of", None, 4, 4).filter("freq_span > 0")
    joined = win.join(brute, ["Token", "Tag"], "full_outer")
    assert joined.filter(F.col("freq_span").isNull() | F.col("b").isNull() | (F.col("freq_span") != F.col("b"))).count() == 0


def test_leftmost_longest_matches_python(corpus):
    """DS phrase tagging equals a sequential greedy scan per document."""
    max_len = max(len(p.split()) for p in DS_LEXICON)
    toks = corpus.tokens.select("doc_id", "token_idx", "token", "ds_tag", "ds_id").collect()
    docs = {}
    for r in toks:
        docs.setdefault(r.doc_id, []).append(r)
    for rs in docs.values():
        rs.sort(key=lambda r: r.token_idx)
        words = [r.token.rstrip().lower() for r in rs]
        words = [" ".join(w.split()) for w in words]
        i = 0
        while i < len(rs):
            hit = None
            for n in range(max_len, 0, -1):
                if i + n <= len(rs) and " ".join(words[i:i + n]) in DS_LEXICON:
                    hit = n
                    break
            if hit:
                tag = DS_LEXICON[" ".join(words[i:i + hit])]
                for j in range(i, i + hit):
                    assert (rs[j].ds_tag, rs[j].ds_id) == (tag, rs[i].token_idx)
                i += hit
            else:
                assert (rs[i].ds_tag, rs[i].ds_id) == ("Untagged", rs[i].token_idx)
                i += 1


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = [("a", float(x)) for x in rng.normal(size=501)] + [("b", float(x)) for x in rng.exponential(size=40)] + [("c", 3.0)]
    df = spark.createDataFrame(vals, "g string, v double").repartition(5)
    got = {r.g: r for r in groupstats.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}).collect()}
    for g in "abc":
        xs = np.array([v for k, v in vals if k == g])
        assert got[g].q1 == pytest.approx(np.quantile(xs, 0.25))
        assert got[g].m == pytest.approx(np.median(xs))
        assert got[g].q3 == pytest.approx(np.quantile(xs, 0.75))


def test_pca_matches_numpy(spark):
    from lexiflow.operators import pca
    from lexiflow.plans.q_stats import pca_input

    wide, tags = pca_input(english(spark, SF_SMALL))
    X = np.array([[r[t] for t in tags] for r in wide.select(*tags).collect()])
    Xc = X - X.mean(axis=0)
    _, s, _ = np.linalg.svd(Xc, full_matrices=False)
    ratio = (s ** 2) / (s ** 2).sum()
    got = [r.variance_ratio for r in pca.pca_variance(wide, tags).orderBy("PC").collect()]
    assert np.allclose(sorted(got, reverse=True)[:3], ratio[:3], atol=1e-6)
    contrib = pca.pca_contrib(wide, tags).groupBy("PC").agg(F.sum(F.abs("contrib")).alias("s")).collect()
    for r in contrib:
        assert r.s == pytest.approx(100.0)


def test_partition_invariance(spark, corpus):
    a = sorted(corpus.frequency("ds").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        b = sorted(corpus.frequency("ds").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b


def test_chunked_phrase_fold_matches(spark, monkeypatch):
    """The two-level greedy fold (long documents) equals the one-level fold."""
    from lexiflow.operators import tagging

    docs = english(spark, SF_SMALL).docs
    a = sorted(tagging.document_units(docs).select("doc_id", "units").collect())
    monkeypatch.setattr(tagging, "FOLD_CHUNK", 3)
    b = sorted(tagging.document_units(docs).select("doc_id", "units").collect())
    assert a == b and sum(len(r.units) for r in a) > 0


def test_invariance_to_input_row_order(spark, fixture_tokens):
    """Imported token tables: results do not depend on row order or on the
    number of shuffle partitions (token_idx carries the order)."""
    from lexiflow.operators import docview
    from lexiflow.plans.corpus import Corpus

    def run(tokens, parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        c = Corpus(tokens, single_token_pos=False)
        return (sorted(c.frequency("ds").collect()), sorted(docview.tagged_text(c.units("ds"), "ds").collect()),
                sorted(c.ngrams("pos", 2, None).collect()))

    try:
        base = run(fixture_tokens, 1)
        shuffled = fixture_tokens.orderBy(F.rand(seed=3)).repartition(5)
        assert run(shuffled, 4) == base
        assert run(shuffled, 13) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_segmented_documents_match_whole_documents(spark, corpus):
    """Documents split into line rows give the same token positions, POS
    tags and n-grams (n-grams run across segment edges)."""
    from lexiflow.plans.corpus import Corpus
    from lexiflow.sources.documents import with_segment_offsets

    lines = corpus.docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("segment", "text"))
    seg = Corpus.from_documents(with_segment_offsets(lines))
    a = corpus.pos_tokens.select("doc_id", "token_idx", F.regexp_replace("token", r"\s+$", "").alias("s"), "pos_tag")
    b = seg.pos_tokens.select("doc_id", "token_idx", F.regexp_replace("token", r"\s+$", "").alias("s"), "pos_tag")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    t = seg.tokens.select("doc_id", "token_idx", F.regexp_replace("token", r"\s+$", "").alias("s"), "pos_tag")
    assert t.exceptAll(b).count() == 0
    ga, gb = ({tuple(r)[:-2] for r in c.ngrams("pos", 3, None).collect()} for c in (corpus, seg))
    assert ga == gb


def test_phrases_and_contexts_cross_segments(spark, corpus, monkeypatch):
    """Documents cut after every few tokens, inside phrases too: same units,
    frequencies and contexts; the maps of the scan are composed over many blocks."""
    from lexiflow.operators import tagging
    from lexiflow.sources.documents import with_segment_offsets

    monkeypatch.setattr(tagging, "SCAN_BLOCK", 3)
    docs = corpus.docs.filter(F.crc32("doc_id") % 4 == 0)
    pieces = F.regexp_extract_all(F.ltrim("text"), F.lit(r"(?s)(?:\S+\s*){1,2}"), 0)
    cut = docs.select("doc_id", F.posexplode(pieces).alias("segment", "text"))
    whole, seg = Corpus.from_documents(docs), Corpus.from_documents(with_segment_offsets(cut))
    assert not seg.whole_rows
    units = lambda c: sorted(map(tuple, c.units("ds").select("doc_id", "pos", "Tag", "utext", "Token").collect()))
    a, b = units(whole), units(seg)
    assert a == b and any(len(r[3].split()) > 1 for r in a)
    assert sorted(whole.tokens.collect()) == sorted(seg.tokens.collect())
    assert sorted(whole.kwic("of", reach=4).collect()) == sorted(seg.kwic("of", reach=4).collect())
    f = lambda c: {(r.Token, r.Tag): (r.AF, pytest.approx(r.RF), pytest.approx(r.Range)) for r in c.frequency("ds").collect()}
    assert f(whole) == {k: (v[0], v[1].expected, v[2].expected) for k, v in f(seg).items()}


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_corpus_reads_no_text(spark, corpus, tmp_path):
    """Analyses from a bundle: no text scan, no regex, no exchange on doc_id; same rows."""
    stored = Corpus.from_bundle(spark, corpus.save_bundle(str(tmp_path / "bundle")))
    ref = Corpus.from_bundle(spark, str(tmp_path / "bundle")).subset(F.col("doc_id").startswith("src1"))
    one = lambda c: c.subset(~F.col("doc_id").startswith("src1"))
    runs = {"freq pos": lambda c: one(c).frequency("pos"), "freq ds": lambda c: one(c).frequency("ds"),
            "stored freq": lambda c: c.frequency("ds"), "ngrams": lambda c: c.ngrams("pos", 3), "ngrams ds": lambda c: c.ngrams("ds", 2),
            "colloc": lambda c: c.collocates("of"), "summary": lambda c: c.summary(), "kwic": lambda c: c.kwic("of"),
            "keyness": lambda c: one(c).keyness(ref if c is stored else c.subset(F.col("doc_id").startswith("src1")), "ds", threshold=1.0, direction="both")}
    num = lambda v: round(v, 9) if isinstance(v, float) else v
    for name, run in runs.items():
        got = run(stored)
        plan = _plan(got)
        for word in ("documents.parquet", "regexp", "RLIKE", "hashpartitioning(doc_id"):
            assert word not in plan, (name, word)
        rows = lambda df: sorted((tuple(map(num, r)) for r in df.collect()), key=repr)
        assert rows(got) == rows(run(corpus)), name


def test_one_shuffle_for_frequencies(corpus):
    """From documents: the only exchange by key is that of the vocabulary, and the texts are read once."""
    for run in (lambda: corpus.frequency("pos"), lambda: corpus.frequency("ds"), lambda: corpus.tags("pos"), lambda: corpus.ngrams("ds", 2)):
        plan = _plan(run())
        final = plan.split("== Initial Plan ==")[0]
        assert "hashpartitioning(doc_id" not in plan
        # the totals are a subquery over the table's own shuffle
        reused = [x for x in final.splitlines() if "ReusedExchange" in x or "FileScan" in x]
        assert sum("ReusedExchange" in x for x in reused) == 1, final


def test_orders_and_guards(spark, corpus):
    """Results that have an order come in it; wrong input is refused."""
    from lexiflow.plans import q_compare, q_stats

    pairs = lambda df, *cols: [tuple(r[c] for c in cols) for r in df.collect()]
    ordered = lambda xs, *signs: xs == sorted(xs, key=lambda r: [s * v if isinstance(v, (int, float)) else v for s, v in zip(signs, r)])
    assert ordered(pairs(q_stats.box_data(spark, SF_SMALL), "Median", "Tag"), -1, 1)
    assert ordered(pairs(q_stats.box_data_grouped(spark, SF_SMALL), "Median", "Tag"), -1, 1)
    grouped = pairs(q_stats.tags_table_grouped(spark, SF_SMALL), "RF", "Group")
    assert grouped == sorted(grouped, key=lambda r: r[1], reverse=True) or [r[0] for r in grouped] == sorted((r[0] for r in grouped), reverse=True)
    assert ordered([r[:1] for r in pairs(q_compare.compare_bar_data(spark, SF_SMALL), "Mean")], -1)
    from lexiflow.operators import docview

    counts = pairs(docview.doc_tag_counts(corpus.units("pos")), "doc_id", "AF", "Tag")
    assert counts == sorted(counts, key=lambda r: (r[0], -r[1], r[2]))
    with pytest.raises(ValueError):
        freq.tags_table_grouped(freq.dtm_dense(corpus.dtm("pos")))
    with pytest.raises(ValueError):
        freq.freq_simplify(corpus.dtm("pos"))
    with pytest.raises(Exception, match="part-of-speech"):
        freq.freq_simplify(corpus.frequency("ds")).collect()


def test_quantiles_of_tied_values(spark, tmp_path):
    """95 % equal values: they are one row for the tasks that rank; null groups keep theirs."""
    vals = [("a" if i % 2 else None, 0.0 if i % 20 else float(i)) for i in range(4000)]
    df = spark.createDataFrame(vals, "g string, v double")
    got = {r.g: (r.q1, r.m, r.q9) for r in groupstats.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "q9": 0.97}).collect()}
    for g in ("a", None):
        xs = [v for k, v in vals if k == g]
        assert got[g] == pytest.approx(tuple(np.quantile(xs, [0.25, 0.5, 0.97])))


def test_student_t_p_values(spark):
    """Against the closed forms for 1, 2 and 4 degrees of freedom, and the normal limit."""
    import math

    from lexiflow.functions.stats import student_t_p

    def exact(r, df):
        t = abs(r) * math.sqrt(df / (1 - r * r))
        if df == 1:
            return 1 - 2 / math.pi * math.atan(t)
        if df == 2:
            return 1 - t / math.sqrt(2 + t * t)
        u = t / math.sqrt(4 + t * t)
        return 1 - u * (1.5 - u * u / 2)

    cases = [(r, df + 2) for r in (0.0, 0.01, -0.3, 0.5, 0.93, -0.9999) for df in (1, 2, 4)]
    rows = spark.createDataFrame(cases + [(0.01, 40_000), (1.0, 9), (0.5, 2), (None, 9)], "r double, n long")
    got = [x[0] for x in rows.select(student_t_p(F.col("r"), F.col("n"))).collect()]
    assert got[:len(cases)] == pytest.approx([exact(r, n - 2) for r, n in cases], abs=1e-10)
    assert got[len(cases)] == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-3)
    assert got[len(cases) + 1:] == [0.0, None, None]


def test_scan_side_unit_count(corpus):
    """N from the texts equals the number of non-punctuation POS units."""
    got = corpus.tokens.sparkSession.range(1).select(corpus.analytic_count("pos")).first()[0]
    assert got == corpus.analytic("pos").count() > 0


def test_kwic_paths_agree(corpus, monkeypatch):
    """Document-row KWIC equals the blocked-window KWIC used for imported
    token tables (forced into many blocks)."""
    from lexiflow.operators import kwic

    a = sorted(kwic.kwic_in_documents(corpus.rows, "the", "fixed", True, 6).collect())
    monkeypatch.setattr(sequence, "BLOCK", 9)
    b = sorted(kwic.kwic(corpus.tokens, "the", "fixed", True, 6).collect())
    assert a == b and len(a) > 0


def _day_file(spark, tmp_path, day):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, f"2024-01-{day:02d} 10:30:00"), (2, f"2024-01-{day:02d} 11:15:00")], "user_id long, t string") \
         .select("user_id", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))


def test_quota_stream_keeps_every_row(spark, tmp_path):
    """Files out of time order: one answer for any batch size, late rows in the side
    table, a second run goes on where the first stopped, a repeated batch counts once."""
    from datetime import datetime

    from pyspark.sql import functions as F

    from lexiflow.streaming.quota import run_quota_stream, write_increment

    for day in (20, 21, 22, 5):
        _day_file(spark, tmp_path, day)
        time.sleep(1.1)     # the file source takes files by their time
    source = str(tmp_path / "e") + "/*.parquet"
    key = lambda df: sorted(tuple(r) for r in df.collect())
    place = {"out_path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "ckpt")}
    one = run_quota_stream(spark, source, F.lit(True), max_files_per_trigger=1, **place)
    many = run_quota_stream(spark, source, F.lit(True))
    assert key(one.windows()) == key(many.windows()) and one.windows().count() == 4 * 2 * 24
    late = one.late_rows().collect()
    assert sorted(r.user_id for r in late) == [1, 2] and {r.ts.day for r in late} == {5}
    assert {r.due for r in late} == {datetime(2024, 1, 22, 10, 15)} and many.late_rows().count() == 0

    _day_file(spark, tmp_path, 21)
    again = run_quota_stream(spark, source, F.lit(True), **place)
    assert again.windows().agg(F.sum("n")).first()[0] == 5 * 2 * 24 and again.late_rows().count() == 4
    batch = spark.createDataFrame([(7, datetime(2024, 1, 23, 1)), (7, None), (None, datetime(2024, 1, 23, 2))], "user_id long, ts timestamp")
    for _ in range(2):      # Spark repeats a batch whose end it has not recorded
        write_increment(again, batch, 5)
    assert again.windows().agg(F.sum("n")).first()[0] == 12 * 24
    write_increment(again, batch.limit(0), 6)
    assert again.newest_before(7) == datetime(2024, 1, 23, 2)


def test_languages_are_judged_by_the_other_fold(spark):
    """Against a plain version; texts without letters have the prior, a language that
    only one fold knows has no share in the other."""
    import hashlib
    import math
    from collections import Counter, defaultdict

    from lexiflow.operators import langid

    rows = [(str(i), ("en", "the cat sat on the mat") if i % 3 else ("de", "die Katze sa\u00df auf der Matte")) for i in range(12)]
    rows = [(d, lang, f"{text} {'x' * (int(d) % 4)}") for d, (lang, text) in rows]
    rows += [("30", "fr", "le chat est l\u00e0"), ("31", None, "the mat"), ("32", "en", ""), ("33", "de", None), ("34", "en", "12 34")]
    docs = spark.createDataFrame(rows, "doc_id string, lang string, text string")
    fold = {d: int(hashlib.md5(d.encode()).hexdigest()[0] >= "8") for d, _, _ in rows}
    grams = lambda t: [f" {t.lower().strip()} "[i:i + 3] for i in range(len(t.strip()))] if t and t[0].isalpha() else []
    counts = {f: defaultdict(Counter) for f in (0, 1)}
    for d, lang, t in rows:
        if lang and grams(t):
            counts[1 - fold[d]][lang].update(grams(t))
    want = {}
    for d, _, t in rows:
        ll = {}
        for lang, c in counts[fold[d]].items():
            n = sum(c.values()) + len(c) + 1
            ll[lang] = sum(math.log((c[g] + 1) / n) for g in grams(t))
        e = {lang: math.exp(v - max(ll.values())) for lang, v in ll.items()}
        want.update({(d, lang): e.get(lang, 0.0) / sum(e.values()) for lang in ("de", "en", "fr")})
    profiles = langid.train_profiles(docs)
    got = {(r.doc_id, r.lang): r.p for r in langid.language_scores(docs, profiles).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {r.doc_id for r in langid.language_filter(docs, profiles).collect()} == {d for d, _, _ in rows}
    assert {r.p_target for r in langid.language_filter(docs, profiles, "xx").collect()} == {0.0}
    none = langid.train_profiles(docs.limit(0))
    assert langid.language_scores(docs, none).count() == 0 and langid.language_scores(docs.limit(0), profiles).count() == 0


def test_default_corpus_reads_all_documents(spark):
    from lexiflow.plans.catalog import corpus as english

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(r"text rlike '\\S'")
    assert english(spark, "/root/testdata/sf0.001").pos_tokens.select("doc_id").distinct().count() == docs.count()


def test_trained_tagger_is_viterbi(spark):
    """Against a plain version; through the hook every table of a corpus is there."""
    import math
    from collections import Counter

    from lexiflow.operators import trained_tagger as tt

    base = english(spark, SF_SMALL)
    docs = base.docs.orderBy("doc_id").limit(20)
    rows = Corpus.from_documents(docs).rows.collect()
    word, ending, move, tags = Counter(), Counter(), Counter(), Counter()
    for r in rows:
        for w, t, before in zip(r.low, r.tags, ["", *r.tags]):
            word[tt.bucket(w, tt.WORD_BUCKETS), t] += 1
            ending[tt.bucket(w[-3:], tt.ENDING_BUCKETS), t] += 1
            move[before, t] += 1
            tags[t] += 1
    every = sorted(tags)
    prior = {t: (tags[t] + 1) / (sum(tags.values()) + len(every)) for t in every}
    sums = [Counter(), Counter(), Counter()]
    for total, table in zip(sums, (word, ending, move)):
        for (key, _), n in table.items():
            total[key] += n
    share = lambda i, table, key, t, p: (table[key, t] + 4 * p) / (sums[i][key] + 4)

    def emit(w, t):
        e = share(1, ending, tt.bucket(w[-3:], tt.ENDING_BUCKETS), t, prior[t])
        return math.log(share(0, word, tt.bucket(w, tt.WORD_BUCKETS), t, e)) - math.log(prior[t])

    step = {(a, t): math.log(share(2, move, a, t, prior[t])) for a in ["", *every] for t in every}
    value = lambda low, path: sum(emit(w, t) + step[a, t] for w, t, a in zip(low, path, ["", *path]))
    model = tt.train_tagger(Corpus.from_documents(docs).rows)
    trained = Corpus.from_documents(docs, tagger=tt.trained_tagger(model))
    got = {r.doc_id: r for r in trained.rows.collect()}
    assert len(got) == len(rows)
    for r in rows[:4]:
        best = {"": (0.0, [])}
        for w in r.low:
            best = {t: max(((s + step[a, t] + emit(w, t), [*p, t]) for a, (s, p) in best.items()), key=lambda x: x[0]) for t in every}
        assert len(got[r.doc_id].tags) == len(r.low)
        assert abs(value(r.low, got[r.doc_id].tags) - max(s for s, _ in best.values())) < 1e-6
    assert trained.tokens.count() == sum(r.n for r in rows) and trained.counts("pos").count() > 0
    agree = tt.tag_agreement(base.rows, F.crc32(F.col("doc_id").cast("binary")) % 2).collect()
    assert sum(r.n for r in agree) == base.pos_tokens.count()
    assert sum(r.n for r in agree if r.pos_tag == r.trained_tag) > 0.9 * sum(r.n for r in agree)      # the commonest tag: 0.49
    none = Corpus.from_documents(spark.createDataFrame([("a", ""), ("b", None)], "doc_id string, text string"), tagger=tt.trained_tagger(model))
    assert none.tokens.count() == 0 and tt.train_tagger(none.rows).tags == ["FU"]
