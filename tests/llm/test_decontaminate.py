import hashlib
import random
import re

from affinade.llm import queries
from affinade.llm.decontaminate import Matcher, decontaminate, digest, windows

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    sets = []
    for item_id, text in items:
        w = words(text)
        if w:
            sets.append((item_id, {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}))
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, wins in sets:
            for k in {len(x) for x in wins}:
                for i in range(len(w) - k + 1):
                    if tuple(w[i : i + k]) in wins:
                        hit.update(range(i, i + k))
                        found.add(item_id)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def rows(spark):
    rng = random.Random(3)
    some = [f"w{i}" for i in range(9)] + ["Éa", "B", "7x"]
    text = lambda n: " -\n".join(rng.choice(some) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 10, 14]))) for i in range(30)] + [(30, None), (31, "..."), (32, ""), (5, "w1 w2"), (None, "7x 7x")]
    docs = [(i, text(rng.choice([0, 2, 60, 400]))) for i in range(60)] + [(60, None), (60, None), (None, text(50)), (61, "x" * 100_000 + " " + items[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as items", "2 as n_words")
    return docs, items, d, spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    docs, items, d, b = rows(spark)
    want = sorted(map(repr, brute(docs, items)))
    assert sorted(repr(tuple(r)) for r in digest(decontaminate(d, b)).collect()) == want
    assert sorted(repr(tuple(r)) for r in digest(decontaminate(d, b, block_bytes=300)).collect()) == want
    assert sorted(repr(tuple(r)) for r in digest(decontaminate(d, b, block_windows=40)).collect()) == want


def test_spans_point_at_the_original(spark):
    text = "Zażółć! The QUICK -- brown\nfox, end é"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "quick brown FOX")], "item_id long, text string")
    (row,) = decontaminate(d, b).collect()
    assert [text[s.start : s.end] for s in row.spans] == ["QUICK -- brown\nfox"]
    assert [(h.start, h.end) for h in row.hit_words] == [(2, 5)]


def test_empty_tables(spark):
    docs, items, d, b = rows(spark)
    assert digest(decontaminate(d.limit(0), b)).count() == 0
    assert {r.n_hit for r in digest(decontaminate(d, b.limit(0))).collect()} == {0}


def test_a_window_is_at_most_twenty_nodes():
    rng = random.Random(4)
    text = " ".join(f"word{rng.randrange(30_000)}" for _ in range(50_000)).encode()
    own = windows(text, 10)
    found = Matcher([(w, [1]) for w in sorted(own)])
    assert len(own) == 49_991 and found.automaton.get_stats()["nodes_count"] <= 20 * len(own) + 1
    words = text.split()
    assert sum(1 for _ in found.hits(words)) == 49_991 and not list(found.hits(words[::-1]))


def test_op10_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    got = sorted(map(tuple, queries.op10_benchmark_decontamination(spark, SF).collect()))
    assert got == sorted(brute(docs, items))
