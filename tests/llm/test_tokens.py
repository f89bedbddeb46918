import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinade.llm import packing, queries
from affinade.llm.token_counts import PieceCounter, token_counts
from affinade.llm.word_codec import WordCodec

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, " ", "  a b", "a\nb\n\n c", "\n", "\nabc", "x \n", "İstanbul ΣΑΣ", "<|endoftext|>hi <|endoftext|", "é́ don't 'String a'lls ½x² __a_b", "日本語 text ▁ x", "tab\tx\r\ny", "a\x00b", "Ünï çöde ſtra ŉ", "word " * 9000, "x" * 5000, "a­b   c"]


def library_ids(text, codec):
    return codec.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_codec_equals_the_library():
    codec = WordCodec(queries.vocabulary("word_bpe_49k.json"))
    for text, raw in zip(TEXTS, codec.encode(TEXTS)):
        assert list(np.frombuffer(raw, codec.dtype)) == library_ids(text, codec)


def test_word_codec_on_random_texts(monkeypatch):
    """Signs, digits, apostrophes and endings in any order; the table is emptied many times on the way."""
    import random

    from affinade.llm import word_codec

    rng = random.Random(1)
    bits = ["'s", "'", "'re", "'r", "''s", "!'t", "'ll", "l", "s", "7", "½", "'7s", " ", "\n", "é", "ſt", "×", "don't", "O'D", "'ve'd", "$$", "_", "µ", "ÿ'm"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["'", "'s", "a'", " 's", "'l", "'r", "x'l", "x've"]
    monkeypatch.setattr(word_codec, "SLOTS", 1 << 9)
    codec = WordCodec(queries.vocabulary("word_bpe_49k.json"))
    for at in range(0, len(texts), 20):
        for text, raw in zip(texts[at : at + 20], codec.encode(texts[at : at + 20])):
            assert list(np.frombuffer(raw, codec.dtype)) == library_ids(text, codec), repr(text)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_word_codec_on_words_that_share_a_hash(monkeypatch):
    """Words that collide under any polynomial modulo 2**64, and a hash so short that most words collide."""
    from affinade.llm import word_codec

    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [one, other, f"so {one} x", f"so {other} x", "", "plain words here", "other words, there", "words"]
    codec = WordCodec(queries.vocabulary("word_bpe_49k.json"))
    for text, raw in zip(texts, codec.encode(texts)):
        assert list(np.frombuffer(raw, codec.dtype)) == library_ids(text, codec)
    whole = word_codec.of_runs
    monkeypatch.setattr(word_codec, "of_runs", lambda *a: whole(*a) % np.uint64(3))
    codec = WordCodec(queries.vocabulary("word_bpe_49k.json"))
    for text, raw in zip(texts, codec.encode(texts)):
        assert list(np.frombuffer(raw, codec.dtype)) == library_ids(text, codec)


def test_word_codec_on_long_texts(monkeypatch):
    """Texts cut at white space, one without any, and more letters than the table keeps."""
    from affinade.llm import word_codec

    monkeypatch.setattr(word_codec, "PART", 50)
    monkeypatch.setattr(word_codec, "LETTERS", 300)
    codec = WordCodec(queries.vocabulary("word_bpe_49k.json"))
    texts = ["some words, and more of them's " * 40, "unbroken-" * 100, " " * 300 + "x" + "\n" * 300, "it's 12 a'll " * 30 + "zebra" * 30]
    for text, raw in zip(texts, codec.encode(texts)):
        assert list(np.frombuffer(raw, codec.dtype)) == library_ids(text, codec)


def test_piece_counter_equals_the_library():
    counter = PieceCounter(queries.vocabulary("piece_bpe_32k.model"))
    assert counter.splits and len(counter.whole) > 10_000
    assert counter.count(TEXTS) == [len(counter.sp.encode(t or "")) for t in TEXTS]


def test_token_counts_edge_rows(spark):
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (None, None, 9), (2, "", 9)], "doc_id long, text string, n_tokens int")
    rows = token_counts(df, queries.vocabulary("piece_bpe_32k.model"), limit=1).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == [(0, 0, 0, False), (1, 3, 2, True), (1, 3, 2, True), (2, 0, 0, False)]
    assert token_counts(df.limit(0), queries.vocabulary("piece_bpe_32k.model"), limit=1).count() == 0


def test_op9_over_the_table(spark):
    counter = PieceCounter(queries.vocabulary("piece_bpe_32k.model"))
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op9_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(counter.sp.encode(text)))
        assert r.over_limit == (r.n_tokens > 4096)


def check_packing(rows, capacity):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_op7_over_the_table(spark):
    codec = WordCodec(queries.vocabulary("word_bpe_49k.json"))
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op7_best_fit_packing(spark, SF).collect()
    found = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for doc_id, text in texts.items():
        ids = [*library_ids(text, codec), 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[doc_id, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    assert found == want
    used = check_packing(rows, 2048)
    assert used <= 1.02 * -(-sum(v[1] for v in want.values()) // 2048) + 1


def greedy(lengths, capacity):
    """Sequential best-fit decreasing, the plain way."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def lengths_of(case):
    rng = np.random.default_rng(7)
    return {
        "even": rng.integers(1, 65, 3000).tolist() + [33] * 40,
        "long": rng.integers(14, 40, 3000).tolist(),
        "thirds": rng.integers(18, 22, 2000).tolist(),
        "ones": [1] * 2000 + rng.integers(30, 65, 500).tolist(),
        "only ones": [1] * 1000,
        "small": rng.integers(5, 9, 3000).tolist(),
    }[case]


@pytest.mark.parametrize("low,high", [(210, 290), (129, 256), (1, 2048)])
def test_packing_at_the_real_capacity(spark, low, high):
    """Narrow ranges of lengths, for which nothing smaller fills what is left over, and all lengths."""
    lengths = np.random.default_rng(3).integers(low, high + 1, 3000).tolist()
    df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = packing.pack(df, 2048).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    assert check_packing(rows, 2048) <= greedy(lengths, 2048) * 1.01 + 1


@pytest.mark.parametrize("case", ["even", "long", "thirds", "ones", "only ones", "small"])
def test_packing_needs_hardly_more_than_sequential_best_fit(spark, case):
    """Ranges of few rows, so that pieces and gaps of different ranges meet, equal lengths among them."""
    lengths = lengths_of(case)
    df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = packing.pack(df, 64, range_rows=400).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    assert check_packing(rows, 64) <= greedy(lengths, 64) * 1.01 + 1


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_tight_sweep_is_best_fit(spark, rows):
    """Pieces, longest first, take the smallest gap left that holds them, whatever the number of ranges."""
    rng = np.random.default_rng(rows)
    pieces, gaps = rng.integers(1, 30, 150).tolist(), rng.integers(1, 40, 120).tolist()
    left, want = sorted(gaps), []
    for n in sorted(pieces, reverse=True):
        at = next((i for i, g in enumerate(left) if g >= n), None)
        if at is not None:
            want.append((n, left.pop(at)))
    a = spark.createDataFrame(list(enumerate(pieces)), "_row long, length long")
    b = spark.createDataFrame(list(enumerate(gaps)), "seq long, gap long")
    got = packing.tight(a, b, 1 + 270 // rows if rows > 1 else 40).collect()
    assert sorted((r.length, r.gap) for r in got) == sorted(want)
    assert len({r.seq for r in got}) == len({r["_row"] for r in got}) == len(got)


def test_packing_runs_few_jobs(spark):
    """Spark's driver keeps something of every job, stage and task, so that their number is part of its memory."""
    df = spark.createDataFrame([(i, 0, 1 + i % 8) for i in range(400)], "doc_id long, piece int, length long")
    spark.sparkContext.setJobGroup("few-jobs", "packing")
    try:
        assert check_packing(packing.pack(df, 8).collect(), 8) == 225  # 1,800 in sequences of 8
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) <= 55
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_packing_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (None, "", 7), (1, "a", 7), (1, "a", 7)], "doc_id long, text string, length int")
    tok = queries.vocabulary("word_bpe_49k.json")
    rows = packing.pack_documents(df, tok, end_id=0, capacity=2).collect()
    assert sorted(r.length for r in rows) == [1, 1, 2, 2] and check_packing(rows, 2) == 3
    assert packing.pack_documents(df.limit(0), tok, end_id=0, capacity=2).count() == 0
    with pytest.raises(Exception, match="out of bounds"):
        packing.pack(df.select("doc_id", F.lit(0).alias("piece"), F.lit(5).alias("length")), 2).count()
