"""Cases that earlier versions got wrong."""

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from lexiflow.llm import bpe, jaccard, neighbours, packing, substrings, workers, words

DOCS = "doc_id long, text string"


def thue_morse(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return [(a, b)[x] for x in bits]


def test_hashes_do_not_cancel(spark):
    """Words, and sequences of words, in Thue-Morse order and its complement."""
    a, b = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    h = words.word_hashes([a.encode(), b.encode(), b"abcdefgh1", b"abcdefgh2", b"abcdefgh"])[0]
    assert len(set(h.tolist())) == 5
    x, y = (words.word_hashes([" ".join(thue_morse(1024, p, q)).encode()])[0] for p, q in (("u", "v"), ("v", "u")))
    assert words.sequence_hashes(x, 1024)[0] != words.sequence_hashes(y, 1024)[0] and words.placed_sums(x) != words.placed_sums(y)
    docs = spark.createDataFrame([(1, a), (2, b)], DOCS)
    assert {r.component_id for r in jaccard.jaccard_join(docs).collect()} == {1, 2}
    around = [" ".join(f"{s}{i}" for i in range(30)) for s in "pq"]
    docs = spark.createDataFrame([(i, f"{around[0]} {w} {around[1]}") for i, w in enumerate((a, b))], DOCS)
    assert [r.n_removed for r in substrings.digest(docs).collect()] == [0, 0]


def test_sequence_hashes_are_of_the_words(spark):
    rng = np.random.default_rng(3)
    w = [f"w{i}" for i in rng.integers(0, 3, 400)]
    h = words.word_hashes([" ".join(w).encode()])[0]
    for length in (1, 2, 3, 5, 25, 50):
        got, seen = words.sequence_hashes(h, length), {}
        assert len(got) == len(w) - length + 1
        for i, x in enumerate(got.tolist()):
            assert seen.setdefault(tuple(w[i:i + length]), x) == x
        assert len(set(seen.values())) == len(seen)


def test_special_strings_are_tokens():
    """As the library does it without an option."""
    from tokenizers import Tokenizer

    from lexiflow.llm.bpe import ByteBpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, ours = Tokenizer.from_file(path), ByteBpe(path)
    for text in ("hello <|endoftext|> world", "<|endoftext|>", "x<|endoftext|>y  z", "plain words only", "<|endof text|>"):
        assert next(ours.encode([text])).tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_query_gets_its_neighbours(spark):
    """Uneven clusters: a part may hold fewer vectors than a query asks for."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(16, 8)) * 20
    size = [3, 3, 4, 5, 6, 8] + [120] * 10
    x = np.concatenate([centre[i] + rng.normal(size=(n, 8)) for i, n in enumerate(size)])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(table, every=1, k=20).groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    assert len(got) == len(x) and all(r.n == 20 == r["last"] for r in got)


def test_texts_under_one_id_are_two_documents(spark):
    import corpus_pipeline

    long = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(1, long("x")), (1, long("y")), (2, long("z")), (2, long("z")), (3, long("x")), (None, long("x")), (None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("rank", F.lit("r")).withColumn("n", F.lit(1))
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, (r.text or "")[:2]) for r in kept.collect())
    assert got == [(0, ""), (0, "x0"), (1, "x0"), (1, "y0"), (2, "z0")]


def test_kept_documents_of_the_middle_stages(spark):
    """The near-duplicate and the substring stage against plain Python on whole tables."""
    import corpus_pipeline
    from test_llm import SMALL, WORD, shingles, smallest

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = smallest(texts, links)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SMALL)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i in texts if label[i] == i)
    seen, want = {}, {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        for at in range(len(w) - 49):
            seen.setdefault(tuple(w[at:at + 50]), i)
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        gone = {at + k for at in range(len(w) - 49) if seen[tuple(w[at:at + 50])] < i for k in range(50)}
        want[i] = hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    cut = corpus_pipeline.cut_repeats(spark, docs, SMALL)
    assert {r.doc_id: hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() for r in cut.collect()} == want


def test_no_document_confirms_its_own_site(spark):
    """Low quality against a plain version in which each document is left out of its
    site's and path's figures; sites of one document, null sites."""
    import math
    from collections import defaultdict

    from lexiflow.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    site = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("own"), "doc_id")).when(F.col("doc_id") % 7 != 0, F.lit("shared"))
    docs = docs.withColumn("source", site)
    evidence = quality.fit(docs, labels)
    rows = docs.collect()
    p = {r.doc_id: 1 / (1 + math.exp(-(float(e) + evidence.prior))) for r, e in zip(rows, evidence([r.text for r in rows]))}
    sites, paths = defaultdict(list), defaultdict(list)
    for r in rows:
        sites[r.source].append(p[r.doc_id])
        paths[r.source, r.lang].append(p[r.doc_id])

    def weight(groups):
        n = sum(map(len, groups))
        m = sum(map(sum, groups)) / n
        v = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g in groups) / n
        return min(max(m * (1 - m) / max(v - m * (1 - m) * len(groups) / n, 1e-6) - 1, 1.0), 1e6)

    of_site, of_path = weight(sites.values()), weight(paths.values())
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(got) == len(rows)
    for r in rows:
        x, s, q = p[r.doc_id], sites[r.source], paths[r.source, r.lang]
        mean = (sum(p.values()) - x + 1 / (1 + math.exp(-evidence.prior))) / len(rows)
        a = (sum(s) - x + of_site * mean) / (len(s) - 1 + of_site)
        b = (sum(q) - x + of_path * a) / (len(q) - 1 + of_path)
        assert abs(got[r.doc_id].site_posterior - a) < 1e-9 and abs(got[r.doc_id].path_posterior - b) < 1e-9
        want = 1 / (1 + math.exp(-(math.log(x / (1 - x)) - evidence.prior + math.log(b / (1 - b)))))
        assert abs(got[r.doc_id].low_quality - want) < 1e-9 and got[r.doc_id].rejected == (want >= 0.5)


def test_workers_keep_one_step_only(spark):
    """The encoder of the packing step stays for its own tasks and is gone, with
    the memory it took, when a task of another step begins."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.ByteBpe(path) is bpe.ByteBpe(path)
    assert list(workers.lean(lambda b: (x for x in [*b, len(workers._HELD)]), keeps=True)(iter([7]))) == [7, 1]
    assert list(workers.lean(lambda b: (x for x in [*b, len(workers._HELD)]))(iter([7]))) == [7, 0]
    docs = spark.createDataFrame([(1, "a b c")], DOCS).coalesce(1)
    assert packing.pack(docs, path).count() == 1

    def encoders(batches):
        import gc

        for b in batches:
            yield b.assign(n=sum(isinstance(x, bpe.ByteBpe) for x in gc.get_objects()))[["n"]]

    assert {r.n for r in docs.mapInPandas(workers.lean(encoders), "n long").collect()} == {0}


def test_small_batches(spark):
    """Batches within the join are bounded by rows and bytes; the session's settings come back."""
    def sizes(batches):
        for b in batches:
            yield b.iloc[:1].assign(n=len(b))[["n"]]

    def most(df):
        return max(r.n for r in df.coalesce(1).mapInPandas(workers.lean(sizes), "n long").collect())

    rows, name = spark.range(2500), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = most(rows), {}
    with workers.small_batches(spark):
        assert most(rows) == 1000 and most(rows.limit(40).selectExpr("repeat('x', 1000000) AS t")) <= 8
    assert most(rows) == before > 1000
    real = jaccard._search

    def search(*args):
        seen["rows"] = spark.conf.get(name)
        return real(*args)

    jaccard._search = search
    try:
        jaccard.jaccard_join(spark.createDataFrame([(1, "a b c d e")], DOCS)).collect()
        assert seen["rows"] == "1000" and spark.conf.get(name, None) is None
        spark.conf.set(name, "300")
        with workers.small_batches(spark):
            assert most(rows) == 300
        assert spark.conf.get(name) == "300"
    finally:
        jaccard._search = real
        spark.conf.unset(name)


def test_new_words_of_many_texts_are_encoded_in_one_call():
    """Ids as the library gives them, with one call for all distinct new words that
    hold no white space, and kept words not encoded again, whatever leaves the dictionary."""
    import random

    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(7)
    library = Tokenizer.from_file(path)
    odd = ["don't", "'s", "'sa", "it's'll", "x\ny", "\nz", "a\n\nb", "a b", " ", " x", "été", "×", "ǅx", "中文", "é", "12a3",
           "--", "\x1c", "a\x1fb", "\x7f", "\t", "tab\tx", "\U0001f600", "İ", "١٢", "...x", "_", "�"]
    words = ["".join(rng.choice("abcdefghéßAZ09.,'") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    texts = [" ".join(rng.choice(odd if rng.random() < 0.1 else words) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts += ["", None, " ", "  ", "a ", " a", "a  b", "a\n", " \n", "a \n", "a \n\n", "a b\n", "x <|endoftext|> y", "\n", "a \nb", *odd, *(f"a {w}" for w in odd)]

    def check(ours):
        for t, ids in zip(texts, ours.encode(texts), strict=True):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, t

    ours, calls = bpe.ByteBpe(path), []
    ours.kept, ours.older = {}, {}
    real = ours.words
    ours.words = lambda t: calls.append(t.split()) or real(t)
    most, size = bpe.KEPT, bpe.RUN_CHARS
    try:
        check(ours)
        assert len(calls) == 1 and len(calls[0]) == len(set(calls[0])) > 250
        check(ours)
        assert len(calls) == 1
        bpe.KEPT, bpe.RUN_CHARS = 200, 500
        check(ours)
        assert len(calls) > 10
    finally:
        bpe.KEPT, bpe.RUN_CHARS = most, size
        ours.words = real
        ours.kept, ours.older = {}, {}


def test_last_tokens_are_looked_for_among_pieces_that_end_there(monkeypatch):
    """Ids of the library, from a forward pass that tries only lengths of pieces with the
    same last three characters (two for pieces of two)."""
    import random

    import sentencepiece

    from lexiflow.llm import pieces

    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(9)
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ours = pieces.Pieces(path)
    syllables = ["the", "an", "ti", "on", "sch", "en", "ü", "中", "文", "ing", "к", "о", "er", "a", "x", "ß", "12", ".", "\U0001f600", "\n", "\t"]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(0, 9))) for _ in range(40)) for _ in range(200)]
    texts += ["", None, " ", "   ", "a", "aa", "aaa", "a" * 3000, " a  b ", "▁x", "\x00", "क्ष"]
    for t, ids in zip(texts, ours.encode(texts), strict=True):
        assert ids.tolist() == m.encode(t or ""), t
    tried = []

    class Ids(dict):
        def __contains__(self, token):
            tried.append(token)
            return dict.__contains__(self, token)

    monkeypatch.setattr(ours, "ids", Ids(ours.ids))
    monkeypatch.setattr(ours, "words", {})
    list(ours.encode(texts))
    chars = sum(len(w) for w in ours.words)
    assert len(tried) < 1.05 * chars, (len(tried), chars)
