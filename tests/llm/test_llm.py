"""Each operator against a brute-force version, and on awkward rows."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import (jaccard, neighbours, packing, pieces, quality, registry, sharding, substrings, toxicity,
                          urls, vector_dedup)
from lexiflow.llm.registry import URL_RULES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, _id int, score int, a int"


def awkward_rows():
    passage = " ".join(f"p{i}" for i in range(60))
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100 ", "x ")
    texts = [base, base, near, passage + " tail one", "head two " + passage, "", None, "one", "one two three",
             " \t\n ", "Größe  – naïve\r\n日本   x", base, "z" * 5000, " ".join(["the"] * 300)]
    rows = [(i, t, "en" if i % 2 else None, "s" if i else None, None, "x", 1, 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "null id", "en", "s", 7, "x", 1, 2, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(10)] + [(None, None, None)],
                                 "doc_id long, quality int, toxic int")


def shingles(t, width):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def smallest(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


@pytest.mark.parametrize("share,width", [(85, 4), (80, 5)])
def test_jaccard(docs, share, width):
    got = jaccard.jaccard_join(docs, share, width).collect()
    sets = {r.doc_id: shingles(r.text, width) for r in docs.collect() if r.doc_id is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    label = smallest(ids, links)
    assert len(got) == docs.count() and links
    for r in got:
        assert r.component_id == label.get(r.doc_id)
        assert r.doc_id is None or r.n_shingles == len(sets[r.doc_id])


def test_substrings(docs):
    rows = {r.doc_id: WORD.findall(r.text or "") for r in docs.collect()}
    first = {}
    for i in sorted(k for k in rows if k is not None):
        for k in range(len(rows[i]) - 49):
            first.setdefault(tuple(rows[i][k:k + 50]), i)
    want = {}
    for i, w in rows.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[k:k + 50])] < i:
                gone[k:k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = substrings.digest(docs).collect()
    assert len(got) == docs.count() and any(r.n_removed for r in got)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == want[r.doc_id][2]


def test_sharding(docs):
    got = sharding.shard(docs, 5).collect()
    assert len(got) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    place, size = {}, {}
    for r in got:
        assert r.size == len((text[r.doc_id] or "").encode()) + 16
        assert r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
        assert place.setdefault(text[r.doc_id], r.shard) == r.shard
        size.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in size.values())


def test_least_capacity():
    rng = np.random.default_rng(1)
    blocks = [(str(i), int(s), True) for i, s in enumerate(rng.integers(1, 50, 60))]
    total = sum(s for _, s, _ in blocks)
    least = next(c for c in range(1, total) if sharding._walk(blocks, c, True, 7)[0] <= 7)
    assert sharding._least(blocks, 7, True, 1, total) == least
    cuts = [0, *sharding._even_cuts(blocks, least, 7, total), len(blocks)]
    assert max(sum(s for _, s, _ in blocks[a:b]) for a, b in zip(cuts, cuts[1:])) == least


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    got = packing.pack(docs, BPE, length=64, open_windows=2).collect()
    pieces_of, sequences = {}, {}
    for r in got:
        pieces_of.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d in docs.dropDuplicates(["doc_id"]).collect():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        copies = sum(r.start == 0 for r in pieces_of[d.doc_id])
        assert sum(r.length for r in pieces_of[d.doc_id]) == copies * len(ids)
        for r in pieces_of[d.doc_id]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64


def test_pieces(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {r.doc_id: r.text for r in docs.collect()}
    encoded = pieces.encode(docs, path)
    for r in encoded.collect():
        assert list(r.ids) == m.encode(texts[r.doc_id] or "")
    for r in pieces.decode(encoded, path).collect():
        assert r.text == (texts[r.doc_id] or "")
    assert pieces.round_trip(docs, path).filter("NOT lossless").isEmpty()


def test_urls(spark):
    rows = [(1, "http://a.COM/x?q"), (2, "https://b.example.com/en/1"), (3, "http://www.example.com/en/2#t"), (4, None),
            (5, "no scheme"), (6, "http://x.net/es/9"), (7, "http://x.net/es"), (8, "http://x.org"), (9, "http://com"),
            (10, "ftp://xcom/"), (11, "http://x.net/fr/1"), (11, "http://x.net/fr/1")]
    got = {r.page_id: r for r in urls.judge_pages(
        spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, n int"), URL_RULES).collect()}
    assert {k: (r.rule, r.verdict) for k, r in got.items()} == {
        1: ("com/", "allow"), 2: ("example.com/en/", "block"), 3: ("www.example.com/en/", "allow"), 4: (None, "allow"),
        5: (None, "allow"), 6: ("net/es/", "block"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"),
        10: (None, "allow"), 11: ("net/fr/", "block")}
    assert (got[2].host, got[2].path, got[4].host, got[9].path) == ("b.example.com", "/en/1", "", "")


def test_url_templates(spark):
    """Pages that only the tree judges: varied segments share their labels, settled ones do not,
    and a few blocked pages condemn nothing, however many paths stand beside them."""
    paths = [("varied.net", f"{s}/{i}") for s in ("es", "fr") for i in range(7)]
    paths += [("varied.net", f"{'abcdefghij'[k] * 3}/{k}") for k in range(10)]
    paths += [("settled.net", f"{s}/{i}") for s in ("es", "fr", "en", "de") for i in range(20)]
    paths += [("plain.org", f"{'abcdefghij'[k] * 3}/{k}") for k in range(10)]
    for n in (6, 7, 30):
        paths += [(f"few{n}.net", f"es/{i}") for i in range(2)] + [(f"few{n}.net", f"p{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}/{k}") for k in range(n)]
    paths += [("deep.org", f"a/b/c/{x}/{i}") for x in ("d", "e") for i in range(9)]
    got = urls.judge_pages(spark.createDataFrame([(i, f"http://{h}/{p}") for i, (h, p) in enumerate(paths)],
                                                 "page_id long, url string"), URL_RULES).collect()
    assert len(got) == len(paths)
    share = (14 + 40 + 3 * 2) / len(paths)
    base = lambda blocked, pages: (blocked + 2 * share) / (pages + 2)
    judged = {(r.host, r.verdict, r.template, round(r.purity, 9), round(r.covered, 9)) for r in got if r.rule is None}
    want = {("varied.net", "block", "varied.net/*/{n}", (14 + 2 * base(14, 24)) / 16, 14 / 24),
            ("plain.org", "allow", "plain.org/*/{n}", base(0, 10), 0.0),
            ("deep.org", "allow", "deep.org/a/b/c/d/{n}", base(0, 18), 0.0), ("deep.org", "allow", "deep.org/a/b/c/e/{n}", base(0, 18), 0.0)}
    want |= {("settled.net", "allow", f"settled.net/{x}/{{n}}", base(40, 80), 0.0) for x in ("en", "de")}
    want |= {(f"few{n}.net", "allow", f"few{n}.net/*/{{n}}", (2 + 2 * base(2, n + 2)) / 4, 2 / (n + 2)) for n in (6, 7, 30)}
    assert judged == {(h, v, t, round(p, 9), round(c, 9)) for h, v, t, p, c in want}


def vector_table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[100:160] = x[0] + 0.2 * rng.normal(size=(60, 8))
    x[200:210] = x[1]
    rows = [(i, v.astype(np.float32).tolist(), 1, 2) for i, v in enumerate(x)]
    odd = [None, [0.0] * 8, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [float("inf")] * 8, [1.0, 0.0]]
    rows += [(400 + i, v, 1, 2) for i, v in enumerate(odd)] + [(None, [1.0] * 8, 1, 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int"), x.astype(np.float32).astype(float)


def test_vector_dedup(spark):
    table, x = vector_table(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    label = smallest(range(300), [(a, b) for a, b in zip(*np.nonzero(np.triu(s >= 0.9, 1)))])
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(table).collect()}
    assert len(got) == table.count()
    for i in range(300):
        assert got[i].n_links == (s[i] >= 0.9).sum() - 1 and got[i].component_id == label[i] and got[i].kept == (label[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(400, 406))


def test_neighbours(spark):
    table, x = vector_table(spark)
    got = neighbours.search(table, every=20, k=5).collect()
    right = total = 0
    for q in range(0, 300, 20):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        order = sorted((-float((x[q] * x[i]).sum()), i) for i in range(300) if i != q)[:5]
        right, total = right + len({m[1] for m in mine} & {i for _, i in order}), total + 5
        assert [m[0] for m in mine] == list(range(1, 6))
        assert all(abs(m[2] - x[q] @ x[m[1]]) < 1e-12 for m in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
    assert right >= 0.9 * total


def test_restore():
    model = np.zeros((toxicity.N_CLASSES,) * 3, np.float32) - 3
    word = "stupid"
    path = [0, 0, *[toxicity._plain(c) for c in word], 0]
    for a, b, c in zip(path, path[1:], path[2:]):
        model[a, b, c] = -0.1
    for w in ("stup1d", "st*pid", "s.t.u.p.i.d", "stuuupid", "$tupid", "5tup!d"):
        assert toxicity.Reader(model).read(w)[0] == word
    assert "stupid" in toxicity.words_of("so s t u p i d x1")


def test_disguises():
    """Signs at the edges, words almost without letters, long words, spaced words of few different letters."""
    def model(*texts):
        m = np.zeros((toxicity.N_CLASSES,) * 3, np.float32) - 3
        for t in texts:
            path = [0, 0, *[toxicity._plain(c) for c in t], 0]
            for a, b, c in zip(path, path[1:], path[2:]):
                m[a, b, c] = -0.1
        return m

    for raw, word in (("!diot", "idiot"), ("idio+", "idiot"), ("jacka$$", "jackass"), ("5h17", "shit"), ("@$$", "ass"),
                      ("stupid!", "stupid"), ("*stupid*", "stupid"), ("$tupid!", "stupid"), ("455", "455"),
                      ("st0pid" * 10, "stopid" * 10)):
        assert toxicity.Reader(model(word)).read(raw)[0] == word
    assert "ass" in toxicity.words_of("so a s s")
    runs = [w for w in toxicity.words_of("you are a s t u p i d! person") if " " in w]
    assert [toxicity.Reader(model("a stupid")).read(w)[0] for w in runs] == ["a stupid"]
    scorer = toxicity.Scorer(model("a stupid", "idiot"), {"stupid": 9.0, "idiot": 9.0}, -3.0).start()
    for text in ("you are a s t u p i d person", "what an !diot", "an idio+", "stupid!"):
        assert scorer.score(text) >= 0.5
    assert scorer.score("a b c d and 455") < 0.5


def test_classifiers(docs, labels, spark):
    t = toxicity.toxicity(docs, labels).collect()
    assert len(t) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in t)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in t if r.doc_id is not None)
    j = quality.judge(docs, labels)
    assert j.count() == docs.count() and set(docs.columns) < set(j.columns)
    big = spark.read.parquet(f"{SMALL}/documents.parquet")
    judged = quality.judge(big, spark.read.parquet(f"{SMALL}/labels.parquet")).join(
        spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    assert judged.filter((F.col("quality") == 1) & F.col("rejected")).count() <= 0.02 * judged.count()


def test_empty(docs, labels):
    none = docs.limit(0)
    assert jaccard.jaccard_join(none).count() == 0 and substrings.digest(none).count() == 0
    assert sharding.shard(none).count() == 0 and packing.pack(none, BPE).count() == 0
    assert quality.judge(none, labels.limit(0)).count() == 0 and toxicity.toxicity(none, labels.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, stays = docs.count(), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, SMALL).cache()
        assert after.columns == docs.columns and after.count() <= before
        docs, before, stays = after, after.count(), k
    assert stays == 3 and corpus_pipeline.pack(spark, docs, SMALL).select("doc_id").distinct().count() == before


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = registry.queries()[name](spark, SMALL)
    want = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())
