"""Stratified interleaving against a sequential version."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from affinade.llm import sharding
from affinade.llm.sharding import assign, digest, shard_mixture, write_shards

SCHEMA = "doc_id long, text string, source string, shard int, slot long, stratum string, order string, _pid int, n long"


def brute(docs, shards, seed=42):
    rows = []
    for doc_id, text, source in docs:
        raw = (text or "").encode()
        key = hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        rows.append(("" if source is None else "=" + source, key, (doc_id is not None, doc_id or 0), len(raw) + 8, zlib.crc32(raw), doc_id))
    rows.sort(key=lambda r: r[:5])
    size, seen, out = Counter(r[0] for r in rows), Counter(), []
    for r in rows:
        out.append((Fraction(2 * seen[r[0]] + 1, 2 * size[r[0]]), r[0], r))
        seen[r[0]] += 1
    slots, found = Counter(), []
    for at, (_, _, r) in enumerate(sorted(out, key=lambda x: x[:2])):
        s = at * shards // len(docs)
        found.append((r[5], r[3], r[4], s, slots[s]))
        slots[s] += 1
    return found


def random_docs(n, seed=0):
    rng = np.random.default_rng(seed)
    sources = ["a", "b", "c", None, "", "=a"]
    return [(int(rng.integers(0, 2 * n)) if k % 17 else None, ["", None, "é" * 9, f"text {rng.integers(9)}"][int(rng.integers(4))], sources[min(5, int(rng.exponential(1.2)))]) for k in range(n)]


def frame(spark, docs):
    return spark.createDataFrame([(*d, 7, 8, "s", "o", 1, 2) for d in docs], SCHEMA)


def listed(df):
    return sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("n,shards", [(1, 24), (23, 24), (24, 24), (500, 24), (333, 7)])
def test_assignment_equals_sequential(spark, n, shards):
    docs = random_docs(n, n)
    assert listed(assign(frame(spark, docs), shards)) == sorted(brute(docs, shards), key=str)


def test_assignment_over_many_ranges_and_partitions(spark, monkeypatch):
    docs = random_docs(400, 5) + [(9, "same", "a")] * 200
    want = sorted(brute(docs, 24), key=str)
    real = sharding.globally_ordered
    monkeypatch.setattr(sharding, "globally_ordered", lambda df, keys, label: real(df, keys, label, rows=23))
    monkeypatch.setattr(sharding, "BROADCAST", 3)
    for n in (1, 9):
        assert listed(assign(frame(spark, docs).repartition(n), 24)) == want


def test_shards_match_the_mixture(spark):
    docs = [(k, f"t{k}", "big" if k % 3 else ["x", "y", "z"][k // 3 % 3]) for k in range(3000)]
    rows = assign(frame(spark, docs), 24)
    counts = Counter(r["shard"] for r in rows.collect())
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 24
    share = Counter("=" + d[2] for d in docs)
    for r in shard_mixture(rows).collect():
        assert abs(r["n"] - share[r["stratum"]] / 24) <= 2
        assert abs(r["share"] - r["n"] / counts[r["shard"]]) < 1e-9


def test_digest_has_the_contracts_columns(spark):
    df = digest(assign(frame(spark, random_docs(50)), 24))
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert {(r["law"], r["grown_shard"]) for r in df.collect()} == {("rows", None)}
    assert digest(assign(frame(spark, []), 24)).count() == 0


def test_written_shards_hold_every_row_in_its_slot(spark, tmp_path):
    docs = random_docs(300, 8) + [(9, "same", "a")] * 40
    df = frame(spark, docs)
    back = write_shards(df, str(tmp_path / "shards"), 24, file_rows=50)
    rows = back.collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in rows) == Counter(docs)
    want = brute(docs, 24)
    got = [(r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert write_shards(frame(spark, []), str(tmp_path / "none"), 24).count() == 0
