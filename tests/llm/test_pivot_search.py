import numpy as np
import pytest
from pyspark.sql import functions as F

from affinade.llm import pivot_search, queries

SF = "/root/testdata/sf0.001"


def brute(rows, is_query, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, dim - len(v)))) for i, v in ok]
    out = []
    for i, v in ok:
        if is_query(i):
            near = sorted((-int(v @ w), j) for j, w in ok if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def test_edge_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(200)]
    rows += [(i, [1.0] * 6) for i in range(200, 300)]  # ties
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")]), (None, [1.0]), (450, [2.5]), (500, []), (7, [1.0] * 6), (50, [1.0] * 6), (550, [200000.0, -200000.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "'x' as vector").repartition(3)
    got = sorted(map(tuple, pivot_search.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute(rows, lambda i: i % 50 == 0)


def test_query_blocks_and_integer_arithmetic(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(4) * 50_000).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(pivot_search, "INDEX_BLOCK", 40)
    got = sorted(map(tuple, pivot_search.top_k(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0)


def test_bounds_spare_evaluations():
    """Clustered rows: the stopping rule leaves most rows unevaluated, and the result is the exact one."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (20, 8))
    x = (centres[rng.integers(0, 20, 5000)] + rng.integers(-9, 9, (5000, 8))).astype(float)
    ids = np.arange(5000)
    pivots = pivot_search.choose_pivots(x[:500], 16)
    table, norms = pivot_search.distances(x, pivots), (x * x).sum(1)
    seen = []
    plain = pivot_search.products
    pivot_search.products = lambda a, *more: (seen.append(len(a)), plain(a, *more))[1]
    try:
        scores, found, n = pivot_search.search_batch(x, ids, table, norms, x[3], 3, table[3], norms[3], -np.inf, 5)
    finally:
        pivot_search.products = plain
    want = sorted((-int(x[3] @ v), i) for i, v in enumerate(x) if i != 3)[:5]
    assert list(zip(-scores.astype(int), found)) == want and sum(seen) < 2500 and sum(seen) == n


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivot_search.top_k(df, F.col("vec_id") % 50 == 0).count() == 0


def test_op1_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries.op1_pivot_search(spark, SF).collect())) == brute(rows, lambda i: i % 50 == 0)


def test_large_components(spark):
    """Rows over 2**26 after scaling take part, with scores that doubles would round."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(4) * 10.0 ** rng.integers(0, 6)).tolist()) for i in range(100)]
    rows += [(100, [3e6, 1.0, 2.0, 0.5]), (101, [3e6, 1.00390625, 2.0, 0.5]), (102, [-3e6, 4.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, pivot_search.top_k(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0) and any(abs(s) > 2**53 for *_, s in got)
    with pytest.raises(Exception, match="fit a long"):
        pivot_search.top_k(spark.createDataFrame([(0, [1e9] * 4), (1, [1e9] * 4)], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_scores_beyond_doubles(spark):
    """Neighbouring whole numbers over 2**53 stay apart, also beside one very large component."""
    odd = 2.0**18 - 1 + 2**-8
    rows = [(0, [odd] * 64), (1, [odd] * 63 + [2.0**18 - 1]), (2, [odd] * 64), (3, [1e8] + [0.0] * 63), (4, [7.0, 1.0] + [2.0**-8] * 62), (50, [1e3] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, pivot_search.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    ints = {i: [int(256 * x // 1) for x in v] for i, v in rows}
    want = []
    for q in (0, 50):
        near = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    assert got == sorted(want) and any(s > 2**53 and s % 2 for *_, s in got)


def test_evaluated_share(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(-5, 5, (10, 8))
    rows = [(i, (centres[i % 10] + rng.random(8) / 50).tolist()) for i in range(2000)]
    share = pivot_search.evaluated_share(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert 0 < share < 0.7
