"""Sources, sinks and usage-log operators on small fixtures."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import ingest, usage
from lexiflow.sources.documents import documents_from_text_files


def _tmpdir():
    return tempfile.mkdtemp(prefix="lexiflow-test-")


def test_text_files_ingest_with_fold(spark):
    d = _tmpdir()
    with open(os.path.join(d, "A_one doc.txt"), "w", encoding="utf-8") as f:
        f.write("  Café “naïve” — Straße  \n")
    with open(os.path.join(d, "B_two.txt"), "w", encoding="utf-8") as f:
        f.write("plain text\n")
    got = {r.doc_id: r.text for r in documents_from_text_files(spark, d, fold_ascii=True).collect()}
    assert got == {"A_onedoc": 'Cafe "naive" - Strasse', "B_two": "plain text"}


def test_binary_decode_check(spark):
    d = _tmpdir()
    with open(os.path.join(d, "good.txt"), "wb") as f:
        f.write("fine ü".encode("utf-8"))
    with open(os.path.join(d, "bad.txt"), "wb") as f:
        f.write(b"broken \xff\xfe bytes")
    got = {r.doc_id: r.valid for r in ingest.decode_check(ingest.read_binary_documents(spark, d)).collect()}
    assert got == {"good": True, "bad": False}


def test_token_parquet_round_trip(spark, fixture_tokens):
    d = os.path.join(_tmpdir(), "tok")
    (fixture_tokens.repartition(1).sortWithinPartitions("doc_id", "token_idx")
        .select(*[f.name for f in ingest.TOKEN_SCHEMA.fields]).write.parquet(d))
    back = ingest.load_token_parquet(spark, d)
    a = sorted((r.doc_id, r.token_idx, r.token) for r in fixture_tokens.collect())
    b = sorted((r.doc_id, r.token_idx, r.token) for r in back.collect())
    assert a == b
    wrong = os.path.join(_tmpdir(), "wrong")
    fixture_tokens.select("doc_id", "token").write.parquet(wrong)
    with pytest.raises(ValueError):
        ingest.load_token_parquet(spark, wrong)


def test_bundle_needs_all_tables(spark, fixture_tokens):
    with pytest.raises(ValueError):
        ingest.save_bundle({"ds_tokens": fixture_tokens}, _tmpdir())


def test_message_intent(spark):
    df = spark.createDataFrame([(1, "Plot the data"), (2, "   "), (3, "hello there"), (4, "éplot this"),
                                (5, "make a BAR chart"), (6, None)], "id int, text string")
    got = {r.id: r.i for r in df.select("id", usage.message_intent(F.col("text")).alias("i")).collect()}
    assert got == {1: "plot", 2: "none", 3: "chat", 4: "chat", 5: "plot", 6: "none"}


def test_prune_thread(spark):
    rows = [(1, t, "assistant" if t in (0, 2) or t % 2 else "user") for t in range(25)]
    rows += [(2, t, "user") for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string")
    kept = {(r.conv_id, r.turn) for r in usage.prune_thread(df).collect()}
    first_user = min(t for c, t, role in rows if c == 1 and role == "user")
    expect = {(1, t) for t in range(6, 25)} | {(1, first_user)} | {(2, t) for t in range(5)}
    assert kept == expect


def test_rolling_quota_counts_previous_day(spark):
    from datetime import datetime, timedelta

    base = datetime(2024, 1, 1, 23, 0, 0)
    rows = [(i, base + timedelta(hours=h), 7) for i, h in enumerate([0, 0.5, 1.5, 23.9, 24.5, 48])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")
    got = {r.event_id: r.n_24h for r in usage.rolling_quota(df).collect()}
    # frames are inclusive: +24.5h still sees +0.5h (exactly 24 h earlier)
    assert got == {0: 1, 1: 2, 2: 3, 3: 4, 4: 4, 5: 2}


def test_token_parquet_round_trip_small_blocks(spark, fixture_tokens):
    """Blocked ordinal across several files and many blocks per document."""
    d = os.path.join(_tmpdir(), "tok3")
    (fixture_tokens.repartitionByRange(3, "doc_id", "token_idx").sortWithinPartitions("doc_id", "token_idx")
        .select(*[f.name for f in ingest.TOKEN_SCHEMA.fields]).write.parquet(d))
    back = ingest.load_token_parquet(spark, d, block=2)
    a = sorted((r.doc_id, r.token_idx, r.token) for r in fixture_tokens.collect())
    b = sorted((r.doc_id, r.token_idx, r.token) for r in back.collect())
    assert a == b
