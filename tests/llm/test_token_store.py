import zlib

import numpy as np
import pytest

from affinade.llm import queries, token_store
from affinade.llm.word_codec import WordCodec

SF = "/root/testdata/sf0.001"


def test_crc_shares_give_the_whole_crc():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 50_000, n).astype("<u4") for n in (1, 5, 1024, 300, 2_000_000, 7)]
    after = np.cumsum([0, *(len(p) for p in parts[::-1])])[-2::-1]
    crc = np.array([zlib.crc32(p.tobytes()) for p in parts])
    assert np.bitwise_xor.reduce(token_store.shifted(crc, after)) == zlib.crc32(np.concatenate(parts).tobytes())


def test_cuts_follow_the_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49_000, 20_000).astype("<u2")
    ends = token_store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.LONGEST and sizes[:-1].min() >= token_store.SHORTEST
    moved = {e - 37 for e in token_store.cuts(np.concatenate([ids[:37], ids]))}
    assert len(moved & set(ends)) > 0.8 * len(ends)
    assert token_store.cuts(np.zeros(5000, "<u2"))[-1] == 5000


def brute(texts, end):
    codec = WordCodec(queries.vocabulary("word_bpe_49k.json"))
    at = 0
    for doc_id, text in texts:
        ids = [*codec.tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        yield doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids
        at += len(ids)


def test_op2_over_the_table(spark):
    texts = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want = {(d, s, n, c) for d, s, n, c, _ in brute(texts, 2)}
    assert {tuple(r) for r in queries.op2_token_store(spark, SF).collect()} == want


def test_round_trip_of_edge_rows(spark, tmp_path):
    rows = [(2, "b " * 3000), (2, "b " * 3000), (None, "x"), (1, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "store")
    token_store.write_store(df, path, queries.vocabulary("word_bpe_49k.json"), 2)
    assert token_store.verify(spark, path)
    want = sorted(brute([(None, "x"), (1, None), *rows[:2], (3, "")], 2), key=lambda r: r[1])
    got = token_store.read_ids(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, list(r.ids)) for r in got] == [(d, s, ids) for d, s, _, _, ids in want]
    checks = token_store.read_checks(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in checks] == [w[:4] for w in want]
    assert token_store.packs(spark, path).count() < 12  # the repeated text is stored once


def test_damage_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    path = str(tmp_path / "store")
    token_store.write_store(df, path, queries.vocabulary("word_bpe_49k.json"), 2)
    broken = token_store.packs(spark, path).withColumn("payload", F.concat("payload", F.lit(b"\x01\x00").cast("binary")))
    with pytest.raises(Exception, match="don't give its key"):
        token_store.chunk_checks(broken, 2).collect()


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, start long")
    path = str(tmp_path / "store")
    token_store.write_store(df, path, queries.vocabulary("word_bpe_49k.json"), 2)
    assert token_store.read_checks(spark, path).count() == 0 and token_store.verify(spark, path)
