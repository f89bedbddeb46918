"""Hand-computed values, properties and agreement between strategies."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinade.config import digits, target_user
from affinade.functions.columns import hashed_uniform
from affinade.operators import baselines, graph, groups, metrics, neighbourhood, regression, similarity, slim
from affinade.operators.split import assign_folds, hide_profile, profile_without
from affinade.operators.topk import every_pair_top_k, filled_top_k, item_scores_top_k, top_k
from affinade.sources.ratings import to_matrix

RATINGS = "u long, i long, r double"


def frame(spark, rows, schema=RATINGS):
    return spark.createDataFrame(rows, schema)


def some_ratings(seed=0, users=12, items=9, share=0.6):
    rng = random.Random(seed)
    return [(u, i, float(rng.randint(1, 5))) for u in range(users) for i in range(items) if rng.random() < share]


def test_target_user_from_digits():
    assert digits("A12b3") == 123 and target_user("A12b3", 100) == 24
    with pytest.raises(ValueError):
        digits("none")


def test_split_sizes_and_partition(spark):
    rows = [(1, i, 3.0) for i in range(10)] + [(2, 0, 1.0)]
    out = assign_folds(frame(spark, rows)).collect()
    assert sorted(r.fold for r in out if r.u == 1) == ["test"] * 2 + ["train"] * 7 + ["val"]
    assert [r.fold for r in out if r.u == 2] == ["train"] and len(out) == 11
    again = assign_folds(frame(spark, rows).repartition(7)).collect()
    assert set(again) == set(out)


def test_hide_is_half_even_and_keeps_five(spark):
    out = hide_profile(frame(spark, [(1, i, 3.0) for i in range(145)]), 1)
    assert out.where("hidden").count() == 44
    few = frame(spark, [(1, i, 3.0) for i in range(6)])
    hidden = hide_profile(few, 1).where("hidden")
    assert hidden.count() == 1 and profile_without(few, hidden).count() == 5


def test_metrics_by_hand(spark):
    lists = frame(spark, [(1, k, k, 1.0) for k in (1, 2, 3, 4)] + [(2, 1, 9, 1.0)], "u long, rank int, i long, score double")
    truth = frame(spark, [(1, 2), (1, 4), (2, 5)], "u long, i long")
    one, two = metrics.user_metrics(lists, truth, 4).orderBy("u").collect()
    assert (one.precision, one.recall, one.hit_rate) == (0.5, 1.0, 1.0)
    assert math.isclose(one.ndcg, 0.650921, abs_tol=1e-6) and math.isclose(one.ap, 0.5)
    assert (two.precision, two.ndcg, two.ap, two.hit_rate) == (0, 0, 0, 0)
    info = metrics.novelty(frame(spark, [(1, 1), (1, 2)], "u long, i long"), frame(spark, [(1, 0), (2, 3)], "i long, cnt long"), 7).first()
    assert info.novelty == 2.0
    features = frame(spark, [(1, "x", 1.0), (2, "x", 1.0), (3, "y", 1.0)], "i long, feature string, w double")
    ild = metrics.diversity(frame(spark, [(1, 1), (1, 2), (1, 3), (2, 1)], "u long, i long"), features).orderBy("u").collect()
    assert math.isclose(ild[0].ild, 2 / 3) and ild[1].ild is None
    assert groups.gini(frame(spark, [(1, 0), (2, 0), (3, 0), (4, 4)], "i long, cnt long")).first().gini == 0.75


def test_popularity_groups_by_hand(spark):
    counts = frame(spark, [(1, 50), (2, 30), (3, 10), (4, 5), (5, 5)], "i long, cnt long")
    got = {r.i: r.grp for r in groups.popularity_groups(counts).collect()}
    assert got == {1: "head", 2: "medium", 3: "long_tail", 4: "long_tail", 5: "long_tail"}


def test_similarity_by_hand(spark):
    cos = similarity.similarity(frame(spark, [(1, 1, 3.0), (1, 2, 4.0), (2, 1, 4.0), (2, 2, 3.0)], "a long, k long, x double"), "cosine", None, None)
    assert all(math.isclose(r.sim, 0.96) for r in cos.collect())
    rows = [(1, k, x) for k, x in enumerate((1.0, 2.0, 3.0))] + [(2, k, x) for k, x in enumerate((2.0, 4.0, 5.0))]
    m = frame(spark, rows, "a long, k long, x double")
    assert math.isclose(similarity.similarity(m, "pearson", None, None).first().sim, 0.981981, abs_tol=1e-6)
    assert math.isclose(similarity.similarity(m, "pearson", 3, 25).first().sim, 0.117838, abs_tol=1e-6)
    assert similarity.similarity(m, "pearson", 4, 25).first().sim == 0
    with pytest.raises(ValueError):
        similarity.similarity(m, "jaccard")


def test_negative_neighbours_wait_for_zeros(spark):
    """Three raters with similarities .5, 0, -.4 and k = 2: the negative one is left out; with k = 3 it counts."""
    train = frame(spark, [(1, 9, 3.0), (2, 5, 4.0), (3, 5, 2.0), (4, 5, 1.0)])
    sim = frame(spark, [(1, 2, 0.5), (1, 4, -0.4)], "a long, b long, sim double")
    target = frame(spark, [(1, 5)], "u long, i long")
    got = lambda k: sorted(r.nbr for r in neighbourhood.nearest(neighbourhood.evidence(train, sim, True, target), train, k, True).collect())
    assert got(2) == [2] and got(3) == [2, 4]


def brute_neighbours(rows, sim, k, user_based, liked=4.0):
    """Dense version: every candidate, zeros included."""
    r = {(u, i): x for u, i, x in rows}
    users, items = sorted({u for u, _ in r}), sorted({i for _, i in r})
    mean = lambda xs: sum(xs) / len(xs)
    mu_u = {u: mean([x for (v, _), x in r.items() if v == u]) for u in users}
    mu_i = {i: mean([x for (_, j), x in r.items() if j == i]) for i in items}
    out = {}
    for u in users:
        for i in items:
            own = [(v, r[v, i], mu_u[v]) for v in users if v != u and (v, i) in r] if user_based else [(j, r[u, j], mu_i[j]) for j in items if j != i and (u, j) in r]
            of = lambda n: sim.get((u, n) if user_based else (i, n), 0.0)  # noqa: E731,B023
            near = sorted(own, key=lambda c: (-round(of(c[0]), 9), c[0]))[:k]
            if any(of(n) for n, *_ in near):
                num, den = sum(of(n) * (x - m) for n, x, m in near), sum(abs(of(n)) for n, *_ in near)
                base = mu_u[u] if user_based else mu_i[i]
                out[u, i] = (base + num / den if den > 1e-10 else base, num, den, sum(max(of(n), 0) * (x >= liked) for n, x, _ in near))
    return out


@pytest.mark.parametrize("user_based", [True, False])
def test_neighbourhood_equals_the_dense_version(spark, user_based):
    rows = some_ratings(3)
    train = frame(spark, rows)
    sim = similarity.similarity(similarity.by_user(train) if user_based else similarity.by_item(train), "pearson" if user_based else "adjusted_cosine")
    table = {(s.a, s.b): s.sim for s in sim.collect()}
    near = neighbourhood.slots(train, sim, 7, user_based)
    scan = neighbourhood.heads_by_k(near, train, [1, 3, 7], user_based).collect()
    for k in (1, 3, 7):
        alone = {(p.u, p.i): (p.pred, p.num, p.den, p.aff) for p in neighbourhood.predict(train, sim, k, user_based).collect()}
        shared = {(p.u, p.i): (p.pred, p.num, p.den, p.aff) for p in scan if p.k == k}
        want = brute_neighbours(rows, table, k, user_based)
        assert alone.keys() == want.keys() == shared.keys()
        assert all(np.allclose(alone[c], want[c]) and np.allclose(shared[c], want[c]) for c in want)


def test_filled_lists_equal_lists_over_all_pairs(spark):
    """Pairs without a score of their own score the user's offset and the item's fill; ties and negative scores among them."""
    rng = np.random.default_rng(5)
    users, items = range(8), range(12)
    own = [(u, i, float(rng.integers(-2, 3))) for u in users for i in items if rng.random() < 0.3]
    seen = [(u, i) for u in users for i in items if rng.random() < 0.3]
    fill, offset = {i: float(rng.integers(-1, 2)) for i in items}, {u: float(u % 3) for u in users if u != 4}
    u_df, seen_df, own_df = frame(spark, [(u,) for u in users], "u long"), frame(spark, seen, "u long, i long"), frame(spark, own, "u long, i long, score double")
    off_df = frame(spark, list(offset.items()), "u long, c double")
    scored = {(u, i): s for u, i, s in own}
    for line, f in ((frame(spark, list(fill.items()), "i long, score double"), fill), (frame(spark, [(i,) for i in items], "i long"), dict.fromkeys(items, 0.0))):
        for given in (off_df, None):
            of = {u: (offset.get(u, 0.0) if given is not None else 0.0) for u in users}
            want = set()
            for u in users:
                best = sorted((-scored.get((u, i), of[u] + f[i]), i) for i in items if (u, i) not in seen)[:4]
                want |= {(u, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
            got = {(r.u, r["rank"], r.i, r.score) for r in filled_top_k(own_df, u_df, line, 4, seen_df, given).collect()}
            assert got == want
    by = frame(spark, [("a",), ("b",)], "kind string")
    both = own_df.withColumn("kind", F.lit("a")).union(own_df.where("u < 3").select("u", "i", (F.col("score") + 1).alias("score"), F.lit("b")))
    got = {(r.kind, r.u, r["rank"], r.i, r.score) for r in filled_top_k(both.select("kind", "u", "i", "score"), u_df, frame(spark, [(i,) for i in items], "i long"), 4, seen_df, None, by).collect()}
    for kind, cells in (("a", scored), ("b", {c: s + 1 for c, s in scored.items() if c[0] < 3})):
        want = {(kind, u, rank, i, -s) for u in users for rank, (s, i) in enumerate(sorted((-cells.get((u, i), 0.0), i) for i in items if (u, i) not in seen)[:4], 1)}
        assert {g for g in got if g[0] == kind} == want


def test_reasons_add_up_to_each_head(spark):
    train = frame(spark, some_ratings(3))
    sim = similarity.similarity(similarity.by_item(train), "adjusted_cosine").cache()
    target = train.select("u").distinct().crossJoin(train.select("i").distinct()).cache()
    heads = {(r.u, r.i): r for r in neighbourhood.predict(train, sim, 3, False).collect()}
    for mode, column in (("score", "num"), ("affinity", "aff")):
        why = neighbourhood.reasons(train, sim, 3, False, target, mode, top_n=None).groupBy("u", "i").agg(F.sum("contribution").alias("s")).collect()
        assert {(r.u, r.i) for r in why} == set(heads)
        assert all(abs(r.s - heads[r.u, r.i][column]) < 1e-9 for r in why)


@pytest.mark.parametrize("alpha", [0.3, 0.8])
def test_walk_series_equals_a_dense_solve(spark, alpha):
    """Two components and a user without edges; seeds leave the iteration at different steps."""
    edges = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), (4, 4), (4, 5), (5, 6), (6, 6), (6, 7)]
    df, users = frame(spark, edges, "u long, i long"), frame(spark, [(u,) for u in range(1, 8)], "u long")
    p = np.zeros((15, 15))
    for u, i in edges:
        p[u, 7 + i] = 1 / sum(x == u for x, _ in edges)
        p[7 + i, u] = 1 / sum(y == i for _, y in edges)
    got = {(r.u, r.i): r.score for r in graph.walk_scores(df, users, alpha, 200, 1e-4).collect()}
    for u in range(1, 7):
        m = alpha * np.linalg.solve(np.eye(15) - (1 - alpha) * p.T, np.eye(15)[u])
        assert sum(abs(got.get((u, i), 0.0) - m[7 + i]) for i in range(1, 8)) < 1e-4
    assert all(u != 7 for u, _ in got)
    few = {(r.seed, r.node): r.m for r in graph.random_walk(df, users, alpha, 7, None).where("side = 'i'").collect()}
    same = {(r.u, r.i): r.score for r in graph.walk_scores(df, users, alpha, 7, 0.0).collect()}
    assert all(abs(same.get(c, 0.0) - few.get(c, 0.0)) < 1e-12 for c in {*same, *few})
    seen = frame(spark, [(1, 1)], "u long, i long")
    rows = lambda d: sorted((r.u, r["rank"], r.i, r.score) for r in d.collect())
    if alpha > 0.5:  # a few hops
        assert rows(graph.walk_lists(df, users, seen, 3, alpha, tol=1e-3, block=4)) == rows(graph.walk_lists(df, users, seen, 3, alpha, tol=1e-3))


def test_depths_from_one_pass(spark):
    edges = frame(spark, [(u, i) for u, i, r in some_ratings(4) if r >= 3], "u long, i long")
    parts = graph.path_parts(edges, 9).cache()
    each = graph.scores_by_depth(parts, (1, 3, 9), 0.5).collect()
    for depth in (1, 3, 9):
        want = {(r.u, r.i): r.score for r in graph.path_scores(edges, depth, 0.5).collect()}
        got = {(r.u, r.i): r.score for r in each if r.depth == depth}
        assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_peeling_ends_where_all_have_enough(spark):
    rows = some_ratings(6, 30, 20, 0.3)
    core = {(r.u, r.i) for r in groups.peeled(frame(spark, rows), 6, 8).collect()}
    left = {(u, i) for u, i, _ in rows}
    while True:
        kept = {(u, i) for u, i in left if sum(x == u for x, _ in left) >= 6 and sum(y == i for _, y in left) >= 8}
        if kept == left:
            break
        left = kept
    assert core == left


@pytest.mark.parametrize("kind", ["pearson", "cosine", "adjusted_cosine"])
def test_similarities_with_a_cut_key(spark, kind, monkeypatch):
    """A user with more ratings than a block takes: the same pairs and sums as in numpy."""
    rows = some_ratings(11, 20, 12, 0.5) + [(99, i, float(1 + i % 5)) for i in range(12)]
    from affinade.operators import pairs

    sim = lambda: {(r.a, r.b): (round(r.sim, 9), r.n_co) for r in similarity.similarity(similarity.by_item(frame(spark, rows)), kind).collect()}
    whole = sim()
    monkeypatch.setattr(pairs.pairs, "__defaults__", (3,))
    assert sim() == whole
    r = {(u, i): x for u, i, x in rows}
    users, items = sorted({u for u, _ in r}), sorted({i for _, i in r})
    x = np.array([[r.get((u, i), 0.0) for i in items] for u in users])
    known = np.array([[(u, i) in r for i in items] for u in users], float)
    n = known.T @ known
    if kind == "pearson":
        s, q, xy = x.T @ known, (x * x).T @ known, x.T @ x
        den = np.sqrt(np.maximum(n * q - s * s, 0) * np.maximum(n * q.T - s.T * s.T, 0))
        want = np.clip((n * xy - s * s.T) / np.where(den > 1e-12, den, np.inf), -1, 1)
    else:
        if kind == "adjusted_cosine":
            x = (x - (x.sum(1) / known.sum(1))[:, None]) * known
        norm = np.sqrt((x * x).sum(0))
        want = x.T @ x / np.where(norm[:, None] * norm > 1e-12, norm[:, None] * norm, np.inf)
    want = np.where(n < similarity.CONFIG.min_support, 0, want) * np.minimum(n, similarity.CONFIG.beta) / similarity.CONFIG.beta
    assert all(np.isclose(v, want[items.index(a), items.index(b)]) for (a, b), (v, _) in whole.items())


def test_a_user_of_very_many_likes(spark):
    """Pairs of one heavy key are cut into blocks, so no task makes them all; counts stay exact."""
    from affinade.operators.pairs import pairs

    n = 3000
    rows = spark.range(n).selectExpr("0 as u", "id as i").union(spark.range(2).selectExpr("1 as u", "id as i"))
    own, other = rows.selectExpr("u", "i as a"), rows.selectExpr("u", "i as b")
    found = pairs(own, other, "u", 500)
    assert found.count() == n * n + 4 and found.where("a < b").distinct().count() == n * (n - 1) // 2 + 1


def test_running_sums_over_ranges(spark):
    from affinade.operators.ordered import running

    df = spark.createDataFrame([(i * 7 % 100, i) for i in range(100)], "k long, w long").repartition(5)
    got = {r["k"]: r["before"] for r in running(df, "k", F.col("w"), "before").collect()}
    rows, total = sorted((r["k"], r["w"]) for r in df.collect()), 0
    for k, w in rows:
        assert got[k] == total
        total += w
    assert running(df.limit(0), "k", F.lit(1), "n").count() == 0


def test_top_k_order_and_exclusion(spark):
    scores = frame(spark, [(1, i, s) for i, s in ((1, 0.5), (2, 0.5), (3, 0.9), (4, float("nan")), (5, 0.1))], "u long, i long, score double")
    assert [r.i for r in top_k(scores, 3).orderBy("rank").collect()] == [3, 1, 2]
    assert [r.i for r in top_k(scores, 9, frame(spark, [(1, 3)], "u long, i long")).orderBy("rank").collect()] == [1, 2, 5]


def test_shared_scores_equal_the_full_product(spark):
    rows = some_ratings(5)
    train = frame(spark, rows)
    users, items = train.select("u").distinct().union(frame(spark, [(99,)], "u long")), train.select("i").distinct()
    scores = items.withColumn("score", (F.col("i") % 4).cast("double"))
    fast = item_scores_top_k(users, scores, 4, train)
    slow = top_k(users.crossJoin(scores), 4, train)
    assert set(fast.collect()) == set(slow.collect())


def test_every_pair_equals_the_plain_way(spark):
    train = frame(spark, some_ratings(6))
    users, items = train.select("u").distinct(), train.select("i").distinct()
    score = hashed_uniform(1, F.col("u"), F.col("i"))
    slow = top_k(users.crossJoin(items).withColumn("score", score), 3, train)
    assert set(every_pair_top_k(users, items, score, 3, train).collect()) == set(slow.collect())


def test_hashed_lists_rank_no_product(spark, monkeypatch):
    """Only pairs over a bound are ranked; users who have seen nearly everything are ranked whole. The same lists as from all pairs."""
    from affinade.operators import topk

    monkeypatch.setattr(topk, "BLOCK", (50, 70))
    users, items = spark.range(120).withColumnRenamed("id", "u"), spark.range(95, 295).withColumnRenamed("id", "i")
    every = users.crossJoin(items).withColumn("score", hashed_uniform(1, F.col("u"), F.col("i")))
    few = every.where("u >= 3 and i % 9 = u % 9").select("u", "i").withColumn("r", F.lit(1.0)).cache()
    most = few.union(every.where("u < 3 and score > 0.02").select("u", "i", "score"))  # fewer than five of 200 are left
    for seen in (few, most):
        fast = topk.hashed_top_k(users, items, 1, 3, seen)
        assert set(fast.collect()) == set(top_k(every, 3, seen).collect())
    plan = topk.hashed_top_k(users, items, 1, 3, few)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hashed_lists_run_in_the_jvm(spark, monkeypatch):
    """Pairs are hashed by a compiled loop, once each, for numbers of all lengths; numpy does it where none can be compiled."""
    from affinade.operators import topk

    users = spark.createDataFrame([(-7,), (0,), (123,), (98765,), (10**18,)], "u long")
    items = spark.range(-40, 1300).union(spark.createDataFrame([(10**k + 1,) for k in range(5, 19)], "i long")).withColumnRenamed("id", "i")
    seen = users.crossJoin(items).where("(u + i) % 5 = 0")
    want = set(top_k(users.crossJoin(items).withColumn("score", hashed_uniform(42, F.col("u"), F.col("i"))), 3, seen).collect())
    lists = topk.hashed_top_k(users, items, 42, 3, seen)
    assert set(lists.collect()) == want
    monkeypatch.setattr(topk, "settle", lambda df: df)
    plan = topk.hashed_top_k(users, items, 42, 3, seen)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("FirstWords") == 1
    monkeypatch.setattr(topk, "java_function", lambda *_: None)
    assert set(topk.hashed_top_k(users, items, 42, 3, seen).collect()) == want


def test_bias_recovers_additive_effects(spark):
    rows = [(u, i, 3.0 + 0.5 * (u % 2) + 0.25 * (i % 3)) for u in range(10) for i in range(9)]
    _, _, trace = baselines.bias_model(frame(spark, rows), 0.0, 0.0, 5)
    assert trace[-1] < 1e-9


def test_ridge_by_hand(spark):
    rows = frame(spark, [(1, 0.5, [(1, 1.0)]), (1, -0.5, [(1, -1.0)]), (1, 1.0, [(1, 2.0)]), (2, 1.0, None)], "i long, y double, z array<struct<pos:int,dev:double>>")
    got = {r.i: r.w for r in regression.solve_ridge(rows, 1, 6.0).collect()}
    assert math.isclose(got[1], 0.25) and got[2] == 0


def test_neighbours_fill_with_zeros(spark):
    sim = frame(spark, [(1, 2, 0.5), (2, 1, 0.5), (1, 3, -0.2), (3, 1, -0.2)], "a long, b long, sim double")
    items = frame(spark, [(i,) for i in (1, 2, 3, 4, 5)], "i long")
    got = {}
    for r in regression.neighbours(sim, items, 3).collect():
        got.setdefault(r.i, []).append((r.pos, r.nbr, r.sim))
    assert sorted(got[1]) == [(1, 2, 0.5), (2, 4, 0.0), (3, 5, 0.0)]
    assert sorted(got[4]) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]
    assert sorted(got[3]) == [(1, 2, 0.0), (2, 4, 0.0), (3, 5, 0.0)]


def test_slim_by_hand_and_certificate(spark):
    w, _, res = slim.solve_column(np.array([[20.0]]), np.array([10.0]), 1.0, 10.0, tol=1e-12)
    assert math.isclose(w[0], 0.3, rel_tol=1e-6) and res < 1e-8
    rng = np.random.default_rng(0)
    x = (rng.random((40, 6)) < 0.4).astype(float)
    g = x.T @ x
    w, _, res = slim.solve_column(g[1:, 1:], g[1:, 0], 0.5, 2.0)
    assert res < 1e-4 and (w >= 0).all()
    assert math.isclose(slim.lambda_max(g), np.linalg.eigvalsh(g).max(), rel_tol=1e-6)
    likes = frame(spark, [(u, i) for u in range(40) for i in range(6) if x[u, i]], "u long, i long")
    fitted = slim.fit(likes, 0.5, 2.0, top_m=5)
    assert fitted.agg(F.max("kkt")).first()[0] < 1e-4


def test_paths_by_hand(spark):
    edges = frame(spark, [(1, 1), (2, 1), (2, 2)], "u long, i long")
    got = {(r.u, r.i): r.score for r in graph.path_scores(edges, 3, 1.0).collect()}
    assert got[1, 2] == 0.25
    why = graph.explain_paths(edges, frame(spark, [(1, 2)], "u long, i long")).collect()
    assert [(r.via, r.weight, r.paths) for r in why] == [(1, 0.25, 1)]


def test_beta_does_not_rank_at_length_three(spark):
    edges = frame(spark, [(u, i) for u, i, _ in some_ratings(7, share=0.3)], "u long, i long")
    lists = [top_k(graph.path_scores(edges, 3, b), 5, edges).select("u", "rank", "i").collect() for b in (0.2, 0.9)]
    assert set(lists[0]) == set(lists[1])


def test_random_walk_fixpoint_and_mass(spark):
    one = graph.random_walk(frame(spark, [(1, 1)], "u long, i long"), frame(spark, [(1,), (2,)], "u long"), iterations=200)
    m = {(r.seed, r.side, r.node): r.m for r in one.collect()}
    assert math.isclose(m[1, "u", 1], 0.540541, abs_tol=1e-5) and math.isclose(m[1, "i", 1], 0.459459, abs_tol=1e-5)
    assert m[2, "u", 2] == 1.0


def test_calibration_without_variance(spark):
    assert tuple(metrics.calibration(frame(spark, [(1.0, 2.0), (1.0, 4.0)], "x double, r double")).first()) == (3.0, 0.0)


def test_slim_over_all_candidates(spark, monkeypatch):
    """More co-liked items than a first solve takes: weights are those of the problem over all items, solved in numpy."""
    rng = np.random.default_rng(3)
    x = (rng.random((70, 75)) < 0.35).astype(float)
    x[:, 0] = 1.0
    likes = spark.createDataFrame([(int(u), int(i)) for u, i in zip(*np.nonzero(x))], "u long, i long")
    g = x.T @ x
    want = np.zeros_like(g)
    for j in range(75):
        others = np.delete(np.arange(75), j)
        want[others, j] = slim.solve_column(g[np.ix_(others, others)], g[others, j], 0.5, 2.0, tol=1e-9, iterations=20000)[0]
    for start in (slim.START, 4):
        monkeypatch.setattr(slim, "START", start)
        got = np.zeros_like(g)
        for r in slim.weights(slim.fit(likes, 0.5, 2.0, tol=1e-7)).collect():
            got[r["src"], r["dst"]] = r["w"]
        assert np.abs(got - want).max() < 1e-4
    masked = {(r["src"], r["dst"]) for r in slim.weights(slim.fit(likes, 0.5, 2.0, top_m=50)).collect()}
    assert set(zip(*np.nonzero(want > 1e-3))) - masked  # the cut problem loses weights


def test_penalty_path_from_warm_starts_equals_cold_fits(spark):
    """Each penalty begun from the next larger one's weights: the same weights in fewer steps, from one Gram table."""
    likes = frame(spark, [(u, i, 1.0) for u, i, r in some_ratings(9, 40, 12, 0.5) if r >= 3], "u long, i long, x double")
    path = slim.penalty_path(likes, [0.5, 1.0, 2.0], 5.0, tol=1e-7)
    steps = {}
    for l1, fitted in path.items():
        cold = slim.fit(likes, l1, 5.0, tol=1e-7)
        a, b = ({(r.src, r.dst): r.w for r in slim.weights(f).collect()} for f in (fitted, cold))
        assert all(abs(a.get(c, 0.0) - b.get(c, 0.0)) < 1e-5 for c in {*a, *b})
        steps[l1] = [f.groupBy("dst").agg(F.max("iterations").alias("n")).agg(F.sum("n")).first()[0] for f in (fitted, cold)]
    assert steps[2.0][0] == steps[2.0][1] and sum(w for w, _ in steps.values()) < sum(c for _, c in steps.values())


def test_flat_objective_stops_a_column():
    rng = np.random.default_rng(2)
    x = rng.random((50, 8)) < 0.4
    a, g = (x.T @ x).astype(float), rng.random(8) * 10
    exact, n, _ = slim.solve_column(a, g, 0.5, 2.0, tol=0.0, flat=0.0)
    w, steps, res = slim.solve_column(a, g, 0.5, 2.0, tol=0.0)  # no certificate asked for: only the objective can stop it
    assert n == 3000 and 50 < steps < 3000 and np.allclose(w, exact, atol=1e-4) and res < 1e-3
    assert slim.solve_column(a, g, 0.5, 2.0, start=exact)[1] == 0


def exchanges(df) -> list[str]:
    """The hash shuffles of a plan, by their columns."""
    import re

    return [re.sub(r"#\d+L?", "", m) for m in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())]


def test_ratings_and_folds_take_one_shuffle(spark):
    rows = to_matrix(frame(spark, [*some_ratings(3), (1, 1, 9.0)]).selectExpr("u as user_id", "i as item_id", "r as rating"))
    assert exchanges(assign_folds(rows)) == ["u"]
    assert {(r.u, r.i): r.r for r in rows.collect()} == {(u, i): x for u, i, x in some_ratings(3)} | {(1, 1): 9.0}


def test_traced_biases_are_kept_each_sweep(spark, monkeypatch):
    """An error taken from biases that aren't kept makes the sweeps before it again."""
    kept = []
    monkeypatch.setattr(baselines, "settle", lambda df: kept.append(1) or df.localCheckpoint())
    baselines.bias_model(frame(spark, some_ratings(3)), iterations=4)
    assert len(kept) == 8


def test_path_explanations_from_pair_sums(spark):
    """Walks over other users, also for items that the user has; users aren't met by the walks."""
    rows = sorted({(u, i) for u, i, _ in some_ratings(5, share=0.4)})
    edges, deg = frame(spark, rows, "u long, i long"), lambda n, at: sum(r[at] == n for r in rows)
    targets = [(u, i) for u in (1, 2, 3) for i in sorted({i for _, i in rows})]
    want: dict = {}
    for u, i in targets:
        for j in {j for x, j in rows if x == u and j != i}:
            for v in {v for v, x in rows if x == j and v != u and (v, i) in rows}:
                w, n = want.get((u, i, j), (0.0, 0))
                want[u, i, j] = w + 1 / (deg(u, 0) * deg(j, 1) * deg(v, 0)), n + 1
    why = graph.explain_paths(edges, frame(spark, targets, "u long, i long"))
    got = {(r.u, r.i, r.via): (r.weight, r.paths) for r in why.collect()}
    assert got.keys() == want.keys() and all(got[c][1] == want[c][1] and math.isclose(got[c][0], want[c][0]) for c in want)
    assert "LeftSemi" not in why._jdf.queryExecution().toString()


def test_item_candidates_stay_with_their_user(spark):
    train = frame(spark, some_ratings(8))
    sim = similarity.similarity(similarity.by_item(train), "adjusted_cosine").localCheckpoint()
    near = neighbourhood.slots(train, sim, 5, False)
    assert "u, i" not in exchanges(near)
    assert set(near.collect()) == set(neighbourhood.slotted(*(neighbourhood.evidence(train, sim.where(c), False) for c in ("sim > 0", "sim < 0")), train, 5, False).collect())
    some = train.where("u % 3 = 0").select("u", (F.col("i") + 1).alias("i"))
    assert set(neighbourhood.slots(train, sim, 5, False, some).collect()) == set(near.join(some, ["u", "i"], "left_semi").select(*near.columns).collect())


def test_walk_states_stay_with_their_user(spark):
    edges = frame(spark, [(u, i) for u, i, _ in some_ratings(7, share=0.3)], "u long, i long")
    assert all(c in ("u", "u, i") for c in exchanges(graph.path_scores(edges, 5)))
    rows = graph.random_walk(edges, edges.select("u").distinct(), iterations=5)
    mass = rows.groupBy("seed").agg(F.sum("m").alias("m")).collect()
    assert all(math.isclose(r.m, 1.0) for r in mass) and len(mass) == edges.select("u").distinct().count()


@pytest.mark.parametrize("kind", ["pearson", "cosine"])
def test_similarities_of_blocks_equal_those_of_pairs(spark, kind, monkeypatch):
    """Sums of two blocks of rows as products, chunk by chunk; no pair of rows is shuffled."""
    matrix = similarity.by_user(frame(spark, some_ratings(4, 40, 9, 0.5)))
    table = lambda: {(r.a, r.b): (round(r.sim, 9), r.n_co) for r in similarity.similarity(matrix, kind, 1, None).collect()}
    whole = table()
    for name, value in (("SIDE", 9), ("CHUNK", 4), ("DENSE", 0)):
        monkeypatch.setattr(similarity, name, value)
    assert table() == whole
    assert exchanges(similarity.paired(matrix, similarity.pair_sums())) == ["low, high"]


@pytest.mark.parametrize("kind", ["pearson", "adjusted_cosine"])
def test_similarities_of_lists_equal_those_of_pairs(spark, kind, monkeypatch):
    """Lists of a column's rows are shuffled, once by the row that they belong to, and pairs aren't."""
    matrix = similarity.by_item(frame(spark, some_ratings(4, 9, 40, 0.5)))
    table = lambda: {(r.a, r.b): (round(r.sim, 9), r.n_co) for r in similarity.similarity(matrix, kind, 1, None).collect()}
    whole = table()
    for name, value in (("SIDE", 9), ("DENSE", 1e9)):
        monkeypatch.setattr(similarity, name, value)
    assert table() == whole
    assert "a, b" not in exchanges(similarity.paired(matrix, similarity.pair_sums()))


@pytest.mark.parametrize("kind", ["cosine", "pearson"])
def test_neighbours_in_blocks_are_those_of_the_ranked_scan(spark, monkeypatch, kind):
    """Blocks and tiles of any size give the slots and sums of the relational scan: ties, items of few raters, users alike, and negative ones whose slots are left."""
    from affinade.operators import wide

    rng = np.random.default_rng(5)
    known = rng.random((60, 14)) < np.linspace(0.05, 0.8, 14)
    known[:, 13] |= True
    values = rng.integers(1, 6, known.shape).astype(float)
    values[7:10], known[7:10] = values[6], known[6]
    rows = [(1000 - 7 * int(u), 3 * int(i) + 1, float(values[u, i])) for u, i in zip(*np.nonzero(known))]
    train = spark.createDataFrame(rows, "u long, i long, r double").repartition(3).cache()
    assert wide.shape(train) is None
    monkeypatch.setattr(wide, "CANDIDATES", 1)
    shape = wide.shape(train)
    assert shape == (60, 14)
    sim = similarity.similarity(similarity.by_user(train), kind, 2, 5.0).cache()
    for k, tile, state in ((12, 100, 20 * 14 * 12), (3, 10**6, 10**6)):
        monkeypatch.setattr(wide, "TILE", tile)
        monkeypatch.setattr(wide, "STATE", state)
        key = lambda r: (r.u, r.i, r.nbr, r.r, r.slot, round(r.sim, 9))
        want = sorted(key(r) for r in neighbourhood.slots(train, sim, k, True).collect())
        assert sorted(key(r) for r in wide.near(train, wide.Kind(kind, 2, 5.0), k, *shape).collect()) == want
        assert kind == "cosine" or k < 12 or any(r[5] < 0 for r in want)
        for centre in (True, False):
            got = {(r.u, r.i): r for r in neighbourhood.predict_users(train, wide.Kind(kind, 2, 5.0), k, centre, 4.0, shape).collect()}
            plain = neighbourhood.predict(train, sim, k, True, centre).collect()
            assert len(got) == len(plain)
            for r in plain:
                assert [got[r.u, r.i][c] for c in ("pred", "num", "den", "aff")] == pytest.approx([r.pred, r.num, r.den, r.aff], abs=1e-9)


def test_lists_are_shuffled_in_small_types(spark, monkeypatch):
    """Lists of items go in the types that hold them as they are; a table both ways round reads its pairs once."""
    monkeypatch.setattr(similarity, "SIDE", 4)
    monkeypatch.setattr(similarity, "DENSE", 1e9)
    small = frame(spark, some_ratings(3, 30, 12))
    cases = [(small, ("int", "byte")), (small.withColumn("i", F.col("i") + 2**40), ("long", "byte")), (small.withColumn("r", F.col("r") / 7), ("int", "double")), (small.withColumn("r", F.col("r") - 300), ("int", "double"))]
    for ratings, types in cases:
        matrix = similarity.by_item(ratings)
        assert similarity.packed(matrix) == types
        rows = {(r.a, r.b): r for r in similarity.paired(matrix, similarity.pair_sums()).collect()}
        left, right = matrix, matrix.select(F.col("a").alias("b"), "k", F.col("x").alias("y"))
        plain = left.join(right, "k").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_co"), *similarity.pair_sums()).collect()
        assert len(plain) == len(rows) > 0
        for r in plain:
            assert list(rows[r.a, r.b]) == pytest.approx(list(r), abs=1e-9)
    plan = similarity.similarity(similarity.by_item(small), "pearson")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


@pytest.mark.parametrize("kind", ["cosine", "pearson"])
def test_few_keys_are_made_once_lists_are_full(monkeypatch, kind):
    """Of users met in small tiles only similarities over a bar get a key, most of them none; lists, ties, negative ones and items of few raters are as in one tile."""
    import pyarrow as pa

    from affinade.operators import wide

    rng = np.random.default_rng(8)
    known = rng.random((600, 12)) < 0.6
    known[:, 0], known[:, 11] = True, np.arange(600) % 300 == 0  # one item with two raters: its lists are never full
    for scale in (1.0, 0.37):  # whole numbers and others
        values = rng.integers(1, 6, known.shape) * scale
        values[300:330], known[300:330] = values[:30], known[:30]
        made = []
        keys = wide.Block.keys
        monkeypatch.setattr(wide.Block, "keys", lambda self, sim, met: made.append(sim.size) or keys(self, sim, met))

        def lists(tile):
            monkeypatch.setattr(wide, "TILE", tile)
            block = wide.Block(wide.Kind(kind, 2, 5.0), 4, 12)
            rows = [np.flatnonzero(k) for k in known]
            at = lambda lo, hi: (np.arange(lo, hi), pa.array(rows[lo:hi], pa.list_(pa.int64())), pa.array([values[u][rows[u]] for u in range(lo, hi)], pa.list_(pa.float64())))
            block.own(*at(0, 50))
            for lo in range(0, 600, 100):
                block.meet(*at(lo, lo + 100))
            found = {}
            for item, own, nbr, means, sim, r, slot in block.near():
                found |= {(item, int(u), int(s)): (int(n), float(x), float(y), float(m)) for u, *row in zip(own, slot, nbr, sim, r, means) for s, n, x, y, m in zip(*row) if s}
            return found

        want = lists(10**9)
        made.clear()
        known[:, 11] = False
        whole = lists(10**9)
        made.clear()
        assert lists(50 * 20) == whole and sum(made) < 600 * 50 / 3
        known[:, 11] = np.arange(600) % 300 == 0
        assert lists(50 * 20) == want
        monkeypatch.setattr(wide.Block, "keys", keys)


def test_explained_pairs_come_from_blocks(spark, monkeypatch):
    """Neighbours of a few pairs (also of a user and an item without training rows) are those of the ranked scan; no similarity is joined with ratings."""
    from affinade.operators import wide

    train = frame(spark, some_ratings(4, 40, 12)).cache()
    targets = spark.createDataFrame([(u, i) for u in range(0, 40, 3) for i in (1, 5, 99)] + [(777, 1)], "u long, i long")
    kind = wide.Kind("pearson", 2, 5.0)
    want = sorted(map(tuple, neighbourhood.user_slots(train, kind, 4, targets).collect()))
    monkeypatch.setattr(wide, "CANDIDATES", 1)
    rows = neighbourhood.user_slots(train, kind, 4, targets)
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = sorted(map(tuple, rows.collect()))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_slopes_without_a_shuffle_of_cells(spark, monkeypatch):
    """Weights sent to the ratings give the sums of the joins, and the plan joins no ratings with ratings."""
    rng = np.random.default_rng(2)
    dev = spark.createDataFrame([(u, i, float(rng.normal())) for u in range(30) for i in range(8) if rng.random() < 0.6], "u long, i long, dev double").cache()
    near = spark.createDataFrame([(i, j, float(rng.normal())) for i in range(8) for j in range(8) if i != j and rng.random() < 0.5], "i long, nbr long, w double")
    rows = regression.slopes(dev, near)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 1
    got = {(r.i, r.nbr): r.s for r in rows.collect()}
    monkeypatch.setattr(regression, "few", lambda rows: False)
    assert got == pytest.approx({(r.i, r.nbr): r.s for r in regression.slopes(dev, near).collect()})
