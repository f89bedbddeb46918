"""Lists of models at production settings against numpy, on the smallest tables."""

import numpy as np
import pytest

from affinade.catalog import QUERIES
from affinade.catalog.base import context
from affinade.operators import similarity, slim

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    ctx = context(spark, SF)
    train = [tuple(r) for r in ctx.train.select("u", "i", "r").collect()]
    users, items = (sorted({r[0] for r in q.collect()}) for q in (ctx.users, ctx.items))
    return ctx, train, users, items


def agrees(rows, users, items, train, score, reached):
    """The rows are full lists: best scores of reached, unseen items, up to roundings among near ties."""
    seen = {(u, i) for u, i, _ in train}
    lists = {}
    for r in sorted(rows, key=lambda r: (r.u, r.rank)):
        lists.setdefault(r.u, []).append((r.i, r.score))
    for a, u in enumerate(users):
        open_items = [b for b, i in enumerate(items) if reached[a, b] and (u, i) not in seen]
        want = sorted((score[a, b] for b in open_items), reverse=True)[:10]
        got = lists.get(u, [])
        assert len(got) == len(want) and np.allclose([s for _, s in got], want, atol=2e-3)
        for i, s in got:
            assert (u, i) not in seen and abs(score[a, items.index(i)] - s) < 2e-3
    return sum(map(len, lists.values()))


def test_slim_topk(spark, data):
    _, train, users, items = data
    x = np.zeros((len(users), len(items)))
    for u, i, r in train:
        x[users.index(u), items.index(i)] = r >= 4
    g, w = x.T @ x, np.zeros((len(items), len(items)))
    for j in range(len(items)):
        others = np.delete(np.arange(len(items)), j)
        w[others, j] = slim.solve_column(g[np.ix_(others, others)], g[others, j], 0.5, 10.0, tol=1e-4)[0]
    rows = [r for r in QUERIES["slim_topk"](spark, SF).collect() if r.score > 5e-3]
    score = x @ w
    assert agrees(rows, users, items, train, score, score > 5e-3) > 0


def test_regression_full_topk(spark, data):
    ctx, train, users, items = data
    n, m = len(users), len(items)
    has, r = np.zeros((n, m)), np.zeros((n, m))
    for u, i, v in train:
        has[users.index(u), items.index(i)], r[users.index(u), items.index(i)] = 1, v
    e = has * (r - r.sum() / has.sum())
    b_u, b_i = np.zeros(n), np.zeros(m)
    for _ in range(20):
        b_i = (has * (e - b_u[:, None])).sum(0) / (10 + has.sum(0))
        b_u = (has * (e - b_i)).sum(1) / (10 + has.sum(1))
    dev = has * (e - b_i - b_u[:, None])
    sim = np.zeros((m, m))
    for a, b, s in similarity.similarity(similarity.by_item(ctx.train), "adjusted_cosine").select("a", "b", "sim").collect():
        sim[items.index(a), items.index(b)] = s
    score, reached = np.zeros((n, m)), np.zeros((n, m), bool)
    for i in range(m):
        near = sorted((j for j in range(m) if j != i), key=lambda j: (-round(sim[i, j], 9), items[j]))[:40]
        z = dev[has[:, i] > 0][:, near]
        w = np.linalg.solve(z.T @ z + 25.0 * np.eye(len(near)), z.T @ dev[has[:, i] > 0, i])
        score[:, i] = dev[:, near] @ w
        reached[:, i] = has[:, near].any(1)
    assert agrees(QUERIES["regression_full_topk"](spark, SF).collect(), users, items, train, score, reached) > 0
