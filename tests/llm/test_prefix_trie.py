"""The conversation trie against dictionaries of beginnings."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from affinade.llm.prefix_trie import TRIE, RangeMinimum, block_values, conversation_trie, smaller_before, trie

SCHEMA = "conv_id long, turn long, role string, text string, g long, lcp int, s string, turns int, base string"


def order(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return (turn is not None, turn or 0, role.encode(), text[:32].encode(), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16])


def rebuild(rows):
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    words = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w])
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[b] for b in below) if below else 1
        saved[k] = (len(nodes[k]) - 1) * (words(k[-1][1]) if k else 0) + sum(saved[b] for b in below)
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(seqs[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def listed(df):
    assert [f"{c} {t.replace('bigint', 'long')}" for c, t in df.dtypes] == TRIE.split(", ")
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(seed, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(np.arange(-30, 4 * n), n, replace=False).tolist():
        for t in range(int(rng.integers(0, 7))):
            rows.append((c, t if rng.random() < 0.9 else None, ["user", "bot", None][t % 3], ["", None, "a b", " x ", "yes\tno  so"][int(rng.integers(5 if t else 2))]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, 6, "s", 7, "b") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed,block", [(0, 5), (1, 4096), (2, 11)])
def test_trie_equals_brute_force(spark, seed, block):
    rows = random_rows(seed)
    assert listed(conversation_trie(frame(spark, rows).repartition(5), block)) == brute(rebuild(rows))


def test_alike_conversations_and_beginnings_over_many_blocks(spark):
    same = [[("u", "one two"), ("b", "three")]] * 25
    seqs = same + [same[0][:1]] * 9 + [[]] * 7 + [same[0] + [("u", f"x {k}")] for k in range(12)] + [[("z", "w " * k)] for k in range(9)]
    rng = np.random.default_rng(4)
    ids = rng.choice(10_000, len(seqs), replace=False).tolist()
    given = dict(zip(ids, seqs, strict=True))
    rows = [(c, [(hashlib.sha256(repr(t).encode()).digest()[:16], len(t[1].split())) for t in s]) for c, s in given.items()]
    df = spark.createDataFrame([(c, [(bytearray(d), w) for d, w in s]) for c, s in rows], "conv_id long, turns array<struct<digest: binary, words: long>>")
    want = brute(given)
    for block in (3, 8, 1000):
        assert listed(trie(df, block)) == want


def test_odd_tables(spark):
    assert listed(conversation_trie(frame(spark, []))) == []
    assert listed(conversation_trie(frame(spark, [(None, 1, "u", "x")]))) == []
    one = [(7, None, None, None)]
    assert listed(conversation_trie(frame(spark, one))) == brute(rebuild(one))
    odd = [(20, 1, "u", "a" * 200_000), (21, 1, "u", "a" * 200_000), (21, 1, "u", "a" * 200_000), (21, 1, "b", "a" * 40 + "2"), (21, 1, "b", "a" * 40 + "1"), (None, 0, "u", "x"), (22, -3, "", "u"), (22, None, "u", "")]
    odd += [(40 + k // 300, k % 300, "u", f"turn {k % 299}") for k in range(600)]
    assert listed(conversation_trie(frame(spark, odd), 2)) == brute(rebuild(odd))


def test_roles_and_texts_are_told_apart(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "a:", "b")]
    assert listed(conversation_trie(frame(spark, rows))) == brute(rebuild(rows))


@pytest.mark.parametrize("seed", range(4))
def test_nearest_smaller_values_and_minima_of_a_block(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 4, 50)
    want = [max([j for j in range(i) if v[j] < v[i]], default=-1) for i in range(50)]
    assert smaller_before(v).tolist() == want
    lo, hi = rng.integers(0, 50, 80), rng.integers(0, 51, 80)
    got = RangeMinimum(v).of(lo, hi)
    assert got.tolist() == [int(v[a:b].min()) if b > a else np.iinfo(np.int64).max for a, b in zip(lo, hi, strict=True)]
    block = pd.DataFrame({"_pid": 3, "g": np.arange(100, 150), "conv_id": rng.permutation(50), "len": 9, "lcp": v, "nxt": 0, "words": [[1, 2]] * 50})
    out = block_values(block)
    for i in range(50):
        ps, ns = out["ps"][i], out["ns"][i]
        after = min([j for j in range(i, 50) if v[j] < v[i]], default=None)
        assert (pd.isna(ps) and want[i] == -1) or ps == want[i] + 100
        assert (pd.isna(ns) and after is None) or ns == after + 100
        if not pd.isna(ps) and not pd.isna(ns):
            assert out["least"][i] == block["conv_id"][ps - 100 : ns - 100].min()


def test_long_lists_of_ids_are_hashed_in_pieces(spark):
    n = 9000
    df = spark.range(n).select(F.col("id").alias("conv_id"), F.expr("array(named_struct('digest', unhex('00'), 'words', 1L))").alias("turns"))
    rows = listed(trie(df, 500))
    assert rows[1][:7] == (0, 1, 0, n, 0, 1, n - 1) and rows[1][7] == hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
