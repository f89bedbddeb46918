"""Similarities, neighbourhoods, regression, sparse linear and graph models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinade.catalog.base import CTES, VIEWS, context, query
from affinade.config import CONFIG
from affinade.operators import graph, metrics, neighbourhood, regression, similarity, slim, wide
from affinade.operators.baselines import means, random_scores, settle
from affinade.operators.topk import top_k
from affinade.plans.registry import calibrated, fit
from affinade.plans.service import Recommender, Service
from affinade.plans.store import ModelStore
from affinade.sources.tables import shared_folder


def pair_ctes(name: str, table: str, row: str, column: str, value: str = "r") -> None:
    """Sums, norms and the three similarity kinds of a table's rows, as table expressions."""
    CTES[f"{name}_pair"] = f"SELECT x.{row} AS a, y.{row} AS b, count(*) AS n_co, sum(x.{value} * y.{value}) AS dot, sum(x.{value}) AS sx, sum(y.{value}) AS sy, sum(x.{value} * x.{value}) AS sxx, sum(y.{value} * y.{value}) AS syy FROM {table} x JOIN {table} y ON x.{column} = y.{column} AND x.{row} <> y.{row} GROUP BY 1, 2"
    CTES[f"{name}_norm"] = f"SELECT {row} AS a, sqrt(sum({value} * {value})) AS norm FROM {table} GROUP BY 1"
    CTES[f"{name}_cos"] = f"SELECT p.a, p.b, CASE WHEN x.norm * y.norm > 1e-12 THEN dot / (x.norm * y.norm) ELSE 0 END AS sim, n_co FROM {name}_pair p JOIN {name}_norm x ON p.a = x.a JOIN {name}_norm y ON p.b = y.a"
    CTES[f"{name}_den"] = f"SELECT a, b, n_co, n_co * dot - sx * sy AS num, sqrt(greatest(n_co * sxx - sx * sx, 0) * greatest(n_co * syy - sy * sy, 0)) AS den FROM {name}_pair"
    CTES[f"{name}_pea"] = f"SELECT a, b, CASE WHEN den > 1e-12 THEN least(greatest(num / den, -1), 1) ELSE 0 END AS sim, n_co FROM {name}_den"
    for kind in ("cos", "pea"):
        CTES[f"{name}_{kind}_rel"] = f"SELECT a, b, CASE WHEN n_co < 3 THEN 0 ELSE sim END * least(n_co, 25) / 25.0 AS sim, n_co FROM {name}_{kind}"


CTES["evt_centred"] = "SELECT t.u, i, t.r - m.mean AS x FROM evt_train t JOIN evt_um m USING (u)"
CTES["supp_centred"] = "SELECT t.u, i, t.r - m.mean AS x FROM supp_train t JOIN supp_um m USING (u)"
pair_ctes("eitem", "evt_train", "i", "u")
pair_ctes("sitem", "supp_train", "i", "u")
pair_ctes("euser", "evt_train", "u", "i")
pair_ctes("eadj", "evt_centred", "i", "u", "x")
pair_ctes("sadj", "supp_centred", "i", "u", "x")
PAIRS = "a:i b:i sim:d n_co:i"
BOTH = "a, b, sim, n_co"


@query("a:i b:i n_co:i", "SELECT a, b, n_co FROM sitem_pair WHERE a < b")
def co_counts(spark, sf_dir):
    return similarity.paired(similarity.by_item(context(spark, sf_dir, "supp").train), [])


@query(PAIRS, f"SELECT {BOTH} FROM sitem_cos_rel")
def item_cosine(spark, sf_dir):
    return similarity.similarity(similarity.by_item(context(spark, sf_dir, "supp").train), "cosine")


@query(PAIRS, f"SELECT {BOTH} FROM sitem_pea_rel")
def item_pearson(spark, sf_dir):
    return similarity.similarity(similarity.by_item(context(spark, sf_dir, "supp").train), "pearson")


@query(PAIRS, f"SELECT {BOTH} FROM sadj_cos_rel")
def item_adjusted_cosine(spark, sf_dir):
    return similarity.similarity(similarity.by_item(context(spark, sf_dir, "supp").train), "adjusted_cosine")


@query(PAIRS, f"SELECT {BOTH} FROM euser_cos_rel")
def user_cosine(spark, sf_dir):
    return similarity.similarity(similarity.by_user(context(spark, sf_dir).train), "cosine")


@query(PAIRS, f"SELECT {BOTH} FROM euser_pea_rel")
def user_pearson(spark, sf_dir):
    return similarity.similarity(similarity.by_user(context(spark, sf_dir).train), "pearson")


@query(PAIRS, "SELECT a, b, CASE WHEN n_co < 5 THEN 0 ELSE sim END * least(n_co, 10) / 10.0 AS sim, n_co FROM sitem_cos")
def reliability_shrink(spark, sf_dir):
    return similarity.similarity(similarity.by_item(context(spark, sf_dir, "supp").train), "cosine", min_support=5, beta=10)


def neighbour_sql(sim: str, user_based: bool, k: int) -> str:
    """Rows of the neighbourhood: all candidates with their similarity (0 where none), ranked as they are."""
    if user_based:
        cand = f"SELECT c.u, c.i, t.u AS nbr, coalesce(s.sim, 0) AS sim, t.r FROM evt_cells c JOIN evt_train t ON t.i = c.i AND t.u <> c.u LEFT JOIN {sim} s ON s.a = c.u AND s.b = t.u"
    else:
        cand = f"SELECT c.u, c.i, t.i AS nbr, coalesce(s.sim, 0) AS sim, t.r FROM evt_cells c JOIN evt_train t ON t.u = c.u AND t.i <> c.i LEFT JOIN {sim} s ON s.a = c.i AND s.b = t.i"
    return f"SELECT u, i, nbr, sim, r FROM ({cand}) QUALIFY row_number() OVER (PARTITION BY u, i ORDER BY round(sim, 9) DESC, nbr) <= {k}"


CTES["ubnb"] = neighbour_sql("euser_pea_rel", True, 20)
CTES["ibnb"] = neighbour_sql("eadj_cos_rel", False, 10)
CTES["ub_sum"] = "SELECT n.u AS u, n.i AS i, sum(sim * (n.r - m.mean)) AS num, sum(abs(sim)) AS den, sum(greatest(sim, 0) * (n.r >= 4)::INT) AS aff FROM ubnb n JOIN evt_um m ON m.u = n.nbr GROUP BY 1, 2"
CTES["ib_sum"] = "SELECT n.u AS u, n.i AS i, sum(sim * (n.r - m.mean)) AS num, sum(abs(sim)) AS den, sum(greatest(sim, 0) * (n.r >= 4)::INT) AS aff FROM ibnb n JOIN evt_im m ON m.i = n.nbr GROUP BY 1, 2"
HEADS = "u:i i:i pred:d num:d den:d aff:d"
USER_KIND = wide.Kind("pearson", CONFIG.min_support, CONFIG.beta)


CTES["ub_all"] = "SELECT c.u, c.i, CASE WHEN den > 1e-10 THEN num / den + m.mean ELSE m.mean END AS pred, coalesce(num, 0) AS num, coalesce(den, 0) AS den, coalesce(aff, 0) AS aff FROM evt_cells c JOIN evt_um m USING (u) LEFT JOIN ub_sum s ON s.u = c.u AND s.i = c.i"
CTES["ib_all"] = "SELECT c.u, c.i, CASE WHEN den > 1e-10 THEN num / den + m.mean ELSE m.mean END AS pred, coalesce(num, 0) AS num, coalesce(den, 0) AS den, coalesce(aff, 0) AS aff FROM evt_cells c JOIN evt_im m USING (i) LEFT JOIN ib_sum s ON s.u = c.u AND s.i = c.i"
CTES["evt_held"] = "SELECT u, i FROM evt_val UNION ALL SELECT u, i FROM evt_test"


def known_or_held(name: str) -> str:
    """Rows of a table of all cells that have evidence or are held out."""
    return f"SELECT u, i, pred, num, den, aff FROM {name} c WHERE den > 0 OR EXISTS (SELECT 1 FROM evt_held h WHERE h.u = c.u AND h.i = c.i)"


def user_heads(spark, sf_dir):
    """Pairs with evidence, stored as several queries read them more than once."""
    ctx = context(spark, sf_dir)
    return ctx, fit({"family": "ubcf", "k": 20, "similarity": "pearson"}, ctx.data(ctx.test)).tables["heads"]


def item_heads(spark, sf_dir, centre: bool = True):
    ctx = context(spark, sf_dir)
    sim = settle(similarity.similarity(similarity.by_item(ctx.train), "adjusted_cosine"))
    return ctx, settle(neighbourhood.predict(ctx.train, sim, 10, False, centre))


def with_held(ctx, heads, by_user: bool):
    """Every pair with evidence and every held-out one."""
    cells = heads.select("u", "i").union(ctx.val.select("u", "i")).union(ctx.test.select("u", "i"))
    return neighbourhood.completed(heads, cells, ctx.train, by_user)


@query(HEADS, known_or_held("ub_all"))
def ubcf_predict(spark, sf_dir):
    return with_held(*user_heads(spark, sf_dir), True)


@query(HEADS, known_or_held("ib_all"))
def ibcf_predict(spark, sf_dir):
    return with_held(*item_heads(spark, sf_dir), False)


LIST = "u:i rank:i i:i score:d"


def list_sql(scores: str) -> str:
    return f"SELECT u, row_number() OVER (PARTITION BY u ORDER BY round(score, 9) DESC, i) AS rank, i, score FROM ({scores}) s ANTI JOIN evt_train t USING (u, i) QUALIFY rank <= 10"


@query(LIST, list_sql("SELECT u, i, num AS score FROM ub_all"))
def ubcf_score_topk(spark, sf_dir):
    ctx, heads = user_heads(spark, sf_dir)
    return neighbourhood.filled_lists(neighbourhood.head(heads, "score"), "score", ctx.train, ctx.users, ctx.items, "u", 10)


@query(LIST, list_sql("SELECT u, i, aff AS score FROM ib_all"))
def ibcf_affinity_topk(spark, sf_dir):
    ctx, heads = item_heads(spark, sf_dir)
    return neighbourhood.filled_lists(neighbourhood.head(heads, "affinity"), "affinity", ctx.train, ctx.users, ctx.items, "i", 10)


WHY = "u:i i:i rank:i nbr:i sim:d contribution:d weight_share:d"


def why_sql(neighbours: str) -> str:
    return f"SELECT n.u, n.i, row_number() OVER (PARTITION BY n.u, n.i ORDER BY round(abs(sim * n.r), 9) DESC, nbr) AS rank, nbr, sim, sim * n.r AS contribution, sim * n.r / sum(abs(sim)) OVER (PARTITION BY n.u, n.i) AS weight_share FROM {neighbours} n JOIN evt_test t ON n.u = t.u AND n.i = t.i WHERE sim <> 0 QUALIFY rank <= 5"


@query(WHY, why_sql("ubnb"))
def ubcf_explain(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return neighbourhood.explained(neighbourhood.user_slots(ctx.train, USER_KIND, 20, ctx.test.select("u", "i")))


@query(WHY, why_sql("ibnb"))
def ibcf_explain(spark, sf_dir):
    ctx = context(spark, sf_dir)
    sim = similarity.similarity(similarity.by_item(ctx.train), "adjusted_cosine")
    return neighbourhood.explain(ctx.train, sim, 10, False, ctx.test.select("u", "i"))


def sums_sql(name: str, base: str) -> str:
    """A held-out pair's score beside the sum of what its neighbours contribute to it, for each head; their difference is 0."""
    heads = {"score": "num", "affinity": "aff"}
    rows = [f"SELECT u, i, '{h}' AS head, {c} AS score FROM {name} WHERE den > 0" for h, c in heads.items()]
    return f"SELECT t.u, t.i, head, score, true AS adds_up FROM ({' UNION ALL '.join(rows)} UNION ALL SELECT u, i, 'rating', pred FROM {name} WHERE den > 0) s JOIN evt_test t USING (u, i)"


def added_up(ctx, heads, why, by_user: bool):
    """Contributions of all neighbours, summed and put beside the head's score."""
    rows = heads.select("u", "i", F.explode(F.array(*(F.struct(F.lit(m).alias("head"), F.col(c).alias("score")) for m, c in (("score", "num"), ("affinity", "aff"), ("rating", "pred"))))).alias("h"), "den").select("u", "i", "h.head", "h.score", "den")
    sums = why.groupBy("u", "i", "head").agg(F.sum("contribution").alias("sum"))
    base = metrics_base(ctx, by_user)
    rows = rows.where("den > 0").join(ctx.test.select("u", "i"), ["u", "i"], "left_semi").join(sums, ["u", "i", "head"], "left").join(base, "u" if by_user else "i")
    total = F.when(F.col("head") == "rating", F.when(F.col("den") > 1e-10, F.col("sum") / F.col("den") + F.col("mean")).otherwise(F.col("mean"))).otherwise(F.col("sum"))
    return rows.select("u", "i", "head", "score", (F.abs(F.coalesce(total, F.lit(0.0)) - F.col("score")) < 1e-9).alias("adds_up"))


def metrics_base(ctx, by_user: bool):
    return means(ctx.train, "u" if by_user else "i", ctx.users if by_user else ctx.items).drop("n")


ADDS = "u:i i:i head:s score:d adds_up:b"


@query(ADDS, sums_sql("ub_all", "evt_um"))
def ubcf_reasons(spark, sf_dir):
    """Reasons of the active head: all neighbours' contributions add up to the score of each head."""
    ctx, heads = user_heads(spark, sf_dir)
    near = settle(neighbourhood.user_slots(ctx.train, USER_KIND, 20, ctx.test.select("u", "i")))  # read for each head
    means_of = neighbourhood.centres(ctx.train, True, "user")
    why = [neighbourhood.reasoned(near, means_of, True, True, "user", CONFIG.liked_from, m, None) for m in ("score", "affinity", "rating")]
    return added_up(ctx, heads, reduce(DataFrame.unionByName, why), True)


@query(ADDS, sums_sql("ib_all", "evt_im"))
def ibcf_reasons(spark, sf_dir):
    ctx, heads = item_heads(spark, sf_dir)
    sim = settle(similarity.similarity(similarity.by_item(ctx.train), "adjusted_cosine"))
    why = [neighbourhood.reasons(ctx.train, sim, 10, False, ctx.test.select("u", "i"), m, top_n=None) for m in ("score", "affinity", "rating")]
    return added_up(ctx, heads, reduce(DataFrame.unionByName, why), False)


# two bias iterations, as ridge targets
CTES |= {
    "edev_e": "SELECT u, i, r - (SELECT mu FROM evt_mu) AS e FROM evt_train",
    "edev_i1": "SELECT i, sum(e) / (10 + count(*)) AS b FROM edev_e GROUP BY 1",
    "edev_u1": "SELECT u, sum(e - b) / (10 + count(*)) AS b FROM edev_e JOIN edev_i1 USING (i) GROUP BY 1",
    "edev_i2": "SELECT i, sum(e - b) / (10 + count(*)) AS b FROM edev_e JOIN edev_u1 USING (u) GROUP BY 1",
    "edev_u2": "SELECT u, sum(e - b) / (10 + count(*)) AS b FROM edev_e JOIN edev_i2 USING (i) GROUP BY 1",
    "edev": "SELECT u, i, e - edev_i2.b - edev_u2.b AS dev FROM edev_e JOIN edev_i2 USING (i) JOIN edev_u2 USING (u)",
    "enear": "SELECT x.i AS i, y.i AS nbr, coalesce(s.sim, 0) AS sim, row_number() OVER (PARTITION BY x.i ORDER BY round(coalesce(s.sim, 0), 9) DESC, y.i) AS pos FROM evt_items x JOIN evt_items y ON x.i <> y.i LEFT JOIN eadj_cos_rel s ON s.a = x.i AND s.b = y.i",
    "ecell": "SELECT t.i, t.u, t.dev AS y, n.pos, coalesce(d.dev, 0) AS z FROM edev t JOIN enear n ON n.i = t.i AND n.pos <= 2 LEFT JOIN edev d ON d.u = t.u AND d.i = n.nbr",
    "ewide": "SELECT i, u, any_value(y) AS y, sum(z) FILTER (pos = 1) AS z1, sum(z) FILTER (pos = 2) AS z2 FROM ecell GROUP BY 1, 2",
    "egram": "SELECT i, sum(z1 * z1) + 25 AS a, sum(z1 * z2) AS b, sum(z2 * z2) + 25 AS d, sum(z1 * y) AS p, sum(z2 * y) AS q FROM ewide GROUP BY 1",
}


def ridge(spark, sf_dir, k: int):
    ctx = context(spark, sf_dir)
    sim = similarity.similarity(similarity.by_item(ctx.train), "adjusted_cosine")
    return ctx, *regression.regression_weights(ctx.train, sim, ctx.items, k, 25.0, iterations=2)


@query("src:i dst:i w:d", "SELECT nbr AS src, n.i AS dst, p / a AS w FROM egram g JOIN enear n ON n.i = g.i AND n.pos = 1")
def ridge_k1(spark, sf_dir):
    return ridge(spark, sf_dir, 1)[1]


@query("src:i dst:i w:d", "SELECT nbr AS src, n.i AS dst, CASE WHEN pos = 1 THEN p * d - b * q ELSE a * q - b * p END / (a * d - b * b) AS w FROM egram g JOIN enear n ON n.i = g.i AND n.pos <= 2")
def ridge_k2(spark, sf_dir):
    return ridge(spark, sf_dir, 2)[1]


@query("n_items:i all_small:b", "SELECT count(*) AS n_items, true AS all_small FROM (SELECT DISTINCT i FROM evt_train)")
def regression_cf_residual(spark, sf_dir):
    """Certificate: with its weights every item satisfies the ridge's normal equations."""
    ctx, w, (dev, *_) = ridge(spark, sf_dir, 20)
    near = w.select(F.col("dst").alias("i"), F.col("src").alias("nbr"), "w")
    rest = regression.slopes(dev, near)
    slope = near.join(rest, ["i", "nbr"], "left").select("i", F.abs(F.coalesce("s", F.lit(0.0)) + 25.0 * F.col("w")).alias("e"))
    return slope.groupBy("i").agg(F.max("e").alias("e")).agg(F.count(F.lit(1)).alias("n_items"), F.bool_and(F.col("e") < 1e-6).alias("all_small"))


@query(LIST, list_sql("SELECT d.u, n.i, sum(d.dev * CASE WHEN pos = 1 THEN p * g.d - b * q ELSE a * q - b * p END / (a * g.d - b * b)) AS score FROM egram g JOIN enear n ON n.i = g.i AND n.pos <= 2 JOIN edev d ON d.i = n.nbr GROUP BY 1, 2"))
def regression_topk(spark, sf_dir):
    ctx, w, (dev, *_) = ridge(spark, sf_dir, 2)
    return top_k(regression.apply_weights(dev, w, "dev"), 10, ctx.train)


@query("u:i i:i rank:i nbr:i w:d contribution:d", "SELECT t.u, t.i, row_number() OVER (PARTITION BY t.u, t.i ORDER BY round(abs(d.dev * p / a), 9) DESC, nbr) AS rank, nbr, p / a AS w, d.dev * p / a AS contribution FROM evt_test t JOIN egram g ON g.i = t.i JOIN enear n ON n.i = t.i AND n.pos = 1 JOIN edev d ON d.u = t.u AND d.i = n.nbr")
def regression_explain(spark, sf_dir):
    ctx, w, (dev, *_) = ridge(spark, sf_dir, 1)
    return regression.explain(dev, w, ctx.test.select("u", "i"))


CTES["elike"] = "SELECT u, i FROM evt_train WHERE r >= 4"
CTES["egr"] = "SELECT x.i AS a, y.i AS b, CAST(count(*) AS DOUBLE) AS g FROM elike x JOIN elike y USING (u) GROUP BY 1, 2"
CTES["ecand"] = "SELECT b AS dst, a AS src, g, row_number() OVER (PARTITION BY b ORDER BY g DESC, a) AS pos FROM egr WHERE a <> b"
CTES["eslim1"] = "SELECT src, dst, (c.g - 1) / (d.g + 10) AS w FROM ecand c JOIN egr d ON d.a = c.src AND d.b = c.src WHERE pos = 1 AND c.g > 1"


def likes_of(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return ctx, regression.liked(ctx.train)


@query("a:i b:i g:d", "SELECT * FROM egr")
def gram(spark, sf_dir):
    return slim.gram(likes_of(spark, sf_dir)[1])


@query("src:i dst:i w:d", "SELECT * FROM eslim1")
def slim_top1(spark, sf_dir):
    return slim.weights(slim.fit(likes_of(spark, sf_dir)[1], 1.0, 10.0, top_m=1, tol=1e-12))


@query("n_columns:i all_met:b", "SELECT count(DISTINCT dst) AS n_columns, true AS all_met FROM ecand")
def slim_kkt(spark, sf_dir):
    """Certificate: the optimality conditions of every column over all items it occurs with, from its weights and the Gram table alone."""
    _, likes = likes_of(spark, sf_dir)
    g = slim.gram(likes)
    cand = g.where("a <> b").select(F.col("b").alias("dst"), F.col("a").alias("src"), "g")
    w = slim.weights(slim.fit(likes, 1.0, 10.0))
    moved = cand.select("dst", F.col("src").alias("a")).join(w.select(F.col("src").alias("b"), "dst", "w"), "dst").join(g, ["a", "b"]).groupBy("dst", "a").agg(F.sum(F.col("g") * F.col("w")).alias("gw"))
    rows = cand.join(moved.withColumnRenamed("a", "src"), ["dst", "src"], "left").join(w, ["dst", "src"], "left")
    slope = F.coalesce("gw", F.lit(0.0)) - F.col("g") + 1.0 + 10.0 * F.coalesce("w", F.lit(0.0))
    off = F.when(F.col("w") > 0, F.abs(slope)).otherwise(F.greatest(-slope, F.lit(0.0)))
    return rows.groupBy("dst").agg((F.max(off) / F.max("g")).alias("e")).agg(F.count(F.lit(1)).alias("n_columns"), F.bool_and(F.col("e") < 1e-3).alias("all_met"))


@query("n_items:i nnz:i density:d mean_nnz:d median_nnz:d max_nnz:i empty_columns:i", "SELECT count(*) AS n_items, sum(n) AS nnz, CAST(sum(n) AS DOUBLE) / (count(*) * count(*)) AS density, avg(n) AS mean_nnz, quantile_cont(n, 0.5) AS median_nnz, max(n) AS max_nnz, count(*) FILTER (n = 0) AS empty_columns FROM (SELECT i, count(w) AS n FROM evt_items LEFT JOIN eslim1 ON dst = i GROUP BY 1)")
def slim_sparsity(spark, sf_dir):
    ctx, likes = likes_of(spark, sf_dir)
    return slim.sparsity(slim.weights(slim.fit(likes, 1.0, 10.0, top_m=1, tol=1e-12)), ctx.items)


@query("src:i dst:i w:d", "SELECT * FROM eslim1 ORDER BY round(w, 9) DESC, src, dst LIMIT 20")
def slim_strongest_pairs(spark, sf_dir):
    return slim.strongest_pairs(slim.weights(slim.fit(likes_of(spark, sf_dir)[1], 1.0, 10.0, top_m=1, tol=1e-12)), 20)


@query("u:i i:i nbr:i w:d", "SELECT t.u, t.i, src AS nbr, w FROM evt_test t JOIN eslim1 ON dst = t.i JOIN elike l ON l.u = t.u AND l.i = src")
def slim_explain(spark, sf_dir):
    ctx, likes = likes_of(spark, sf_dir)
    return slim.explain(likes, slim.weights(slim.fit(likes, 1.0, 10.0, top_m=1, tol=1e-12)), ctx.test.select("u", "i"))


@query(LIST)
def slim_topk(spark, sf_dir):
    """Lists of the full model (no SQL: an iterated solve); see slim_kkt for its certificate."""
    ctx, likes = likes_of(spark, sf_dir)
    return top_k(regression.apply_weights(likes, slim.weights(slim.fit(likes, 0.5, 10.0))), 10, ctx.train)


@query(LIST)
def regression_full_topk(spark, sf_dir):
    """Lists of the production model, 40 neighbours and 20 bias iterations, by moved deviations (no SQL: a solve of 40 x 40)."""
    ctx = context(spark, sf_dir)
    sim = similarity.similarity(similarity.by_item(ctx.train), "adjusted_cosine")
    w, (dev, *_) = regression.regression_weights(ctx.train, sim, ctx.items)
    return top_k(regression.apply_weights(dev, w, "dev"), 10, ctx.train)


def hop_sql(name: str, degree: bool) -> None:
    CTES[f"{name}_ui"] = f"SELECT u, i, {'1.0 / count(*) OVER (PARTITION BY u)' if degree else '1.0'} AS w FROM elike"
    CTES[f"{name}_iu"] = f"SELECT i, u, {'1.0 / count(*) OVER (PARTITION BY i)' if degree else '1.0'} AS w FROM elike"
    CTES[f"{name}_m1"] = f"SELECT u, i, w AS m FROM {name}_ui"
    for n in (3, 5):
        CTES[f"{name}_m{n}"] = f"SELECT s.u, f.i, sum(s.m * b.w * f.w) AS m FROM {name}_m{n - 2} s JOIN {name}_iu b ON b.i = s.i JOIN {name}_ui f ON f.u = b.u GROUP BY 1, 2"


hop_sql("wd", True)
hop_sql("wr", False)


def edges_of(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return ctx, ctx.train.where("r >= 4").select("u", "i")


@query(LIST, list_sql("SELECT u, i, sum(s) AS score FROM (SELECT u, i, m * 0.5::DOUBLE AS s FROM wd_m1 UNION ALL SELECT u, i, m * 0.125::DOUBLE FROM wd_m3) GROUP BY 1, 2"))
def path3_degree_topk(spark, sf_dir):
    ctx, edges = edges_of(spark, sf_dir)
    return top_k(graph.path_scores(edges, 3, 0.5), 10, ctx.train)


@query(LIST, list_sql("SELECT u, i, sum(s) AS score FROM (SELECT u, i, m * 0.5::DOUBLE AS s FROM wr_m1 UNION ALL SELECT u, i, m * 0.125::DOUBLE FROM wr_m3) GROUP BY 1, 2"))
def path3_raw_topk(spark, sf_dir):
    ctx, edges = edges_of(spark, sf_dir)
    return top_k(graph.path_scores(edges, 3, 0.5, "none"), 10, ctx.train)


@query("u:i i:i score:d", "SELECT u, i, sum(s) AS score FROM (SELECT u, i, m * 0.5::DOUBLE AS s FROM wd_m1 UNION ALL SELECT u, i, m * 0.125::DOUBLE FROM wd_m3 UNION ALL SELECT u, i, m * 0.03125::DOUBLE FROM wd_m5) GROUP BY 1, 2")
def path5_degree(spark, sf_dir):
    return graph.path_scores(edges_of(spark, sf_dir)[1], 5, 0.5)


@query("length:i mass:d", "SELECT 1 AS length, sum(m) AS mass FROM wd_m1 UNION ALL SELECT 3, sum(m) FROM wd_m3 UNION ALL SELECT 5, sum(m) FROM wd_m5")
def path_mass_by_length(spark, sf_dir):
    return graph.path_mass(edges_of(spark, sf_dir)[1], 5)


CTES["rw_move"] = "SELECT 'u' AS side, u AS node, 'i' AS to_side, i AS dest, w FROM wd_ui UNION ALL SELECT 'i', i, 'u', u, w FROM wd_iu"
CTES["rw_s0"] = "SELECT u AS seed, 'u' AS side, u AS node, 1.0::DOUBLE AS m FROM evt_users"
for _k in range(1, 5):
    CTES[f"rw_t{_k}"] = f"SELECT seed, to_side AS side, dest AS node, 0.85::DOUBLE * sum(m * w) AS m FROM rw_s{_k - 1} JOIN rw_move USING (side, node) GROUP BY 1, 2, 3"
    CTES[f"rw_s{_k}"] = f"SELECT seed, side, node, sum(m) AS m FROM (SELECT * FROM rw_t{_k} UNION ALL SELECT u, 'u', u, 1 - coalesce((SELECT sum(m) FROM rw_t{_k} t WHERE t.seed = evt_users.u), 0) FROM evt_users) GROUP BY 1, 2, 3"


@query("seed:i side:s node:i m:d", "SELECT * FROM rw_s4")
def rwr_scores(spark, sf_dir):
    ctx, edges = edges_of(spark, sf_dir)
    return graph.random_walk(edges, ctx.users, iterations=4)


@query("n_seeds:i all_one:b", "SELECT count(*) AS n_seeds, true AS all_one FROM evt_users")
def rwr_mass(spark, sf_dir):
    """Certificate: after many steps every seed's mass is 1."""
    ctx, edges = edges_of(spark, sf_dir)
    rows = graph.random_walk(edges, ctx.users, iterations=12)
    return rows.groupBy("seed").agg(F.sum("m").alias("m")).agg(F.count(F.lit(1)).alias("n_seeds"), F.bool_and(F.abs(F.col("m") - 1) < 1e-9).alias("all_one"))


@query("u:i i:i via:i weight:d paths:i", """SELECT t.u, t.i, a.i AS via, sum(1.0 / (du.n * dj.n * dv.n)) AS weight, count(*) AS paths
  FROM evt_test t JOIN elike a ON a.u = t.u AND a.i <> t.i JOIN elike b ON b.i = a.i AND b.u <> t.u JOIN elike c ON c.u = b.u AND c.i = t.i
  JOIN (SELECT u, count(*) AS n FROM elike GROUP BY 1) du ON du.u = t.u JOIN (SELECT i, count(*) AS n FROM elike GROUP BY 1) dj ON dj.i = a.i JOIN (SELECT u, count(*) AS n FROM elike GROUP BY 1) dv ON dv.u = b.u GROUP BY 1, 2, 3""")
def graph_explain(spark, sf_dir):
    ctx, edges = edges_of(spark, sf_dir)
    return graph.explain_paths(edges, ctx.test.select("u", "i"))


CTES["e_score"] = "SELECT u, i, sum(s) AS score FROM (SELECT u, i, m * 0.5::DOUBLE AS s FROM wd_m1 UNION ALL SELECT u, i, m * 0.125::DOUBLE FROM wd_m3) GROUP BY 1, 2"
CTES["e_cal"] = "SELECT ln(1 + greatest(coalesce(score, 0), 0) * 10000.0::DOUBLE) AS x, r FROM evt_val LEFT JOIN e_score USING (u, i)"


@query("a:d b:d", "SELECT avg(r) - regr_slope(r, x) * avg(x) AS a, regr_slope(r, x) AS b FROM e_cal")
def calibration_head(spark, sf_dir):
    ctx, edges = edges_of(spark, sf_dir)
    score = graph.path_scores(edges, 3, 0.5)
    x = F.log1p(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)) * 1e4)
    return metrics.calibration(ctx.val.join(score, ["u", "i"], "left").select(x.alias("x"), "r"))


@query("n:i rmse:d mae:d", "SELECT count(*) AS n, sqrt(avg((p - r) ** 2)) AS rmse, avg(abs(p - r)) AS mae FROM (SELECT r, least(greatest((SELECT avg(r) - regr_slope(r, x) * avg(x) FROM e_cal) + (SELECT regr_slope(r, x) FROM e_cal) * ln(1 + coalesce(score, 0) * 10000.0::DOUBLE), (SELECT min(r) FROM evt)), (SELECT max(r) FROM evt)) AS p FROM evt_test LEFT JOIN e_score USING (u, i))")
def graph_rating_errors(spark, sf_dir):
    ctx, edges = edges_of(spark, sf_dir)
    data = ctx.data()
    data.targets = ctx.test.select("u", "i")
    pred = calibrated(graph.path_scores(edges, 3, 0.5), data, lambda c: F.log1p(F.greatest(c, F.lit(0.0)) * 1e4))
    return metrics.rating_errors(metrics.clipped(pred, ctx.ratings), ctx.test)


@query("u:i i:i score:d", "SELECT u, i, CAST(CAST('0x' || substr(md5(concat('42:', u, ':', i)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS score FROM evt")
def random_scores_hash(spark, sf_dir):
    return random_scores(VIEWS["evt"](spark, sf_dir))


CTES["ibnb_raw"] = "SELECT x.i AS i, t.i AS nbr, coalesce(s.sim, 0) AS sim, t.r FROM evt_items x JOIN evt_train t ON t.u = 7 AND t.i <> x.i LEFT JOIN eadj_cos_rel s ON s.a = x.i AND s.b = t.i QUALIFY row_number() OVER (PARTITION BY x.i ORDER BY round(coalesce(s.sim, 0), 9) DESC, t.i) <= 20"


@query("rank:i i:i score:d", "SELECT row_number() OVER (ORDER BY round(coalesce(num, 0), 9) DESC, i) AS rank, i, coalesce(num, 0) AS score FROM evt_items LEFT JOIN (SELECT i, sum(sim * r) AS num FROM ibnb_raw GROUP BY 1) s USING (i) ANTI JOIN (SELECT i FROM evt_train WHERE u = 7) t USING (i) QUALIFY rank <= 10")
def service_recommend_user(spark, sf_dir):
    ctx = context(spark, sf_dir)
    return Recommender(ctx, k=20).recommend(7, "score")


SERVED = {"popularity": {"family": "popularity"}, "ubcf": {"family": "ubcf", "k": 20, "similarity": "pearson"}, "ibcf": {"family": "ibcf", "k": 10, "rank_mode": "affinity"}, "graph": {"family": "graph"}}
SERVED_SQL = {"popularity": "SELECT 7 AS u, i, CAST(cnt AS DOUBLE) AS score FROM evt_cnt", "ubcf": "SELECT u, i, num AS score FROM ub_all WHERE u = 7", "ibcf": "SELECT u, i, aff AS score FROM ib_all WHERE u = 7", "graph": "SELECT u, i, score FROM e_score WHERE u = 7"}


def served(spark, sf_dir) -> Service:
    """Four families fitted, stored in buckets, and opened again from there."""
    ctx = context(spark, sf_dir)
    store = ModelStore(spark, shared_folder(spark, "served"), buckets=16)
    return Service.of(store, ctx, SERVED, {name: fit(spec, ctx.data(ctx.test)) for name, spec in SERVED.items()})


@query("model:s rank:i i:i score:d", " UNION ALL ".join(f"SELECT '{m}' AS model, rank, i, score FROM ({list_sql(q)})" for m, q in SERVED_SQL.items()))
def service_stored_lists(spark, sf_dir):
    """One user's lists from stored models, each the same as the model's own."""
    app = served(spark, sf_dir)
    return reduce(DataFrame.unionByName, (app.models[m].list_of(7, 10).withColumn("model", F.lit(m)) for m in SERVED))


@query("rank:i " + " ".join(f"{m}:i" for m in SERVED), "SELECT rank, " + ", ".join(f"max(i) FILTER (model = '{m}') AS {m}" for m in SERVED) + " FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS model, rank, i FROM ({list_sql(q)})" for m, q in SERVED_SQL.items()) + ") GROUP BY 1")
def service_compare(spark, sf_dir):
    return served(spark, sf_dir).compare(7, 10, list(SERVED))


@query("i:i r:d cnt:i grp:s", "SELECT i, r, cnt, grp FROM evt_train JOIN evt_grp USING (i) WHERE u = 7 ORDER BY r DESC, cnt DESC, i LIMIT 20")
def service_user_profile(spark, sf_dir):
    return Recommender(context(spark, sf_dir)).user_profile(7)


@query("n:i mean_r:d n_liked:i", "SELECT count(*) AS n, avg(r) AS mean_r, count(*) FILTER (r >= 4) AS n_liked FROM evt_train WHERE u = 7")
def service_user_summary(spark, sf_dir):
    return Recommender(context(spark, sf_dir)).user_summary(7)
