import random

import numpy as np
import pytest

from affinade.llm import near_duplicates as nd
from affinade.llm import common, queries
from affinade.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_sets(text):
    words = (text or "").lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, threshold=0.8):
    """rows: (doc_id, text); gives per row doc_id, class_id, n_links, in a sorted list."""
    sets = [plain_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both and both / (len(sets[i]) + len(sets[j]) - both) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[max(root(i), root(j))] = min(root(i), root(j))
    key = lambda v: (v is None, v or 0)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, doc_id), doc_id, key=key)
    return sorted(((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed=0):
    rng = random.Random(seed)
    some = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(40):
        text = [rng.choice(some) for _ in range(rng.randint(20, 200))]
        out.append(" ".join(text))
        for _ in range(rng.randint(0, 6)):
            other = list(text)
            for _ in range(rng.randint(0, 5)):
                other[rng.randrange(len(other))] = rng.choice(some)
            out.append(" \n".join(other) if rng.random() < 0.5 else " ".join(other).upper())
    out += ["a b", "A  b", "a b c", "", None, " ", "x " * 500, "x " * 700, "one " * 4, "y " * 60_000]
    rng.shuffle(out)
    rows = [(i, t) for i, t in enumerate(out)]
    return [*rows, rows[3], rows[3], (None, rows[5][1]), (None, "alone here we are again today")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as root", "3 as n").repartition(3)
    got = nd.join_classes(df).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == brute(rows)
    stay = [r.class_id for r in got if r.stays]
    blank = sum(1 for _, t in rows if not (t or "").split())
    assert len(stay) == len(set(stay)) or len(stay) - len(set(stay)) <= blank + 2
    kept = nd.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == len(stay)


def test_blocks_give_the_same(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, found = nd.classes(df, block=400)
    got = found.join(nd.firsts(found), "class_row").collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == brute(rows)


def test_tiles_give_the_same(monkeypatch):
    monkeypatch.setattr(nd, "TILE", 7)
    monkeypatch.setattr(nd, "COLUMNS", 16)
    rows = [r for r in corpus(2) if r[1] and r[1].split() and len(r[1]) < 20_000]
    links, root = nd.compare(nd.shingle_sets([t for _, t in rows]), [0] * len(rows), [1] * len(rows), 0.8, False)
    by = {}
    for (d, _), r in zip(rows, root):
        by.setdefault(r, []).append(d)
    least = {r: min(ds, key=lambda v: (v is None, v or 0)) for r, ds in by.items()}
    assert sorted(((d, least[r], int(k)) for (d, _), r, k in zip(rows, root, links)), key=repr) == brute(rows)


def test_forest_meets_pairs_at_the_threshold():
    """Pairs of sets with a similarity of just 0.8: at the shortest prefix, and by the estimate, practically none is missed."""
    rng = np.random.default_rng(4)
    depth, least, missed = nd.shortest(0.8), nd.least_estimate(0.8, nd.TREES * nd.DEEPEST), 0
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, 90, dtype=np.uint64) * np.uint64(2))
        a, b = np.sort(x[:81]), np.sort(np.concatenate([x[:72], x[81:90]]))
        p, q = nd.signatures_of([a, b], nd.TREES)
        met = (p.reshape(nd.TREES, -1)[:, :depth] == q.reshape(nd.TREES, -1)[:, :depth]).all(1).any()
        missed += not (met and (p == q).sum() >= least)
    assert depth == 6 and missed <= 1


def test_large_trie_nodes_are_cut(spark, monkeypatch):
    """Trie nodes of more members than a block has: the pairs of blocks find the same."""
    monkeypatch.setattr(nd, "MEMBERS", 3)
    rows = corpus(3)
    got = nd.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == brute(rows)


def test_words_that_share_a_polynomial_hash():
    """Thue-Morse words collide under any polynomial modulo 2**64; here they differ."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    a, b = nd.shingle_sets([f"{one} of the same five", f"{other} of the same five"])
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {n: n for e in edges for n in e}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {n: root(n) for n in up if root(n) != n}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nd.join_classes(df).count() == 0 and nd.deduplicate(df).count() == 0


@pytest.mark.parametrize("text, n", [("", 0), (None, 0), ("a", 1), ("a b c d", 1), ("a b c d e", 1), ("a b c d e f", 2), ("a " * 50, 1)])
def test_set_sizes(text, n):
    assert len(nd.shingle_sets(["pad it", text, "q r s"])[1]) == n


def test_op3_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op3_ngram_jaccard_join(spark, SF).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == brute(rows)


def test_rows_among_ids(spark):
    """Rows are found by bitmaps, whatever their partition, place and number."""
    held = [0, 1, 7, 8, 63, 32767, 32768, 70_001, (5 << 33) + 3, (5 << 33) + 32768, (900 << 33) + 65535]
    near = [i + d for i in held for d in (-1, 0, 1, 8, -8) if i + d >= 0]
    rows = spark.createDataFrame([(i, f"t{i}") for i in sorted({*held, *near})], "_row long, `a.b` string")
    ids = spark.createDataFrame([(i,) for i in [*held, *held, 12_345]], "_row long")
    got = common.among(rows, "_row", ids)
    assert got.columns == rows.columns
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"t{i}") for i in held]
    assert common.among(rows, "_row", ids.limit(0)).count() == 0 and common.among(rows.limit(0), "_row", ids).count() == 0


@pytest.fixture
def never_small(spark):
    """No table is small enough for Spark to broadcast it of its own accord."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    limit = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, limit)


def shuffles(df):
    return "Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()


def test_what_stays_is_not_shuffled(spark, never_small):
    """However many documents stay, their texts and other columns are picked without a shuffle."""
    kept = nd.deduplicate(spark.createDataFrame(corpus(4), "doc_id long, text string"))
    assert not shuffles(kept)
    assert kept.count() == sum(r.stays for r in nd.join_classes(spark.createDataFrame(corpus(4), "doc_id long, text string")).collect())


def test_whole_texts_and_signatures_are_not_shuffled(spark, never_small, monkeypatch):
    """What is picked for the levels and the exact comparison is picked from all texts and signatures without a shuffle."""
    picked, among = [], nd.among
    monkeypatch.setattr(nd, "among", lambda *args: picked.append(among(*args)) or picked[-1])
    rows = corpus(5)
    got = nd.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == brute(rows)
    assert len(picked) == 5 and not any(map(shuffles, picked))
