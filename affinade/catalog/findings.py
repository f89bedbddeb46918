"""Summaries that reports draw from metric tables, sanity checks, and one user's experiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinade.catalog.base import CTES, context, query, split
from affinade.catalog.models import edges_of, item_heads, ridge, with_held
from affinade.catalog.reports import metric_table
from affinade.catalog.tables import mean_lists, popularity_lists, random_lists, three_lists
from affinade.operators import baselines, graph, metrics, similarity
from affinade.operators.ordered import running
from affinade.plans import target
from affinade.sources.ratings import supplier_features

MODELS = {"popularity": popularity_lists, "item_mean": mean_lists, "random": random_lists}
CTES |= {
    "mt_user": "SELECT n.model, n.u, n_rel, coalesce(h, 0) / 10 AS precision, coalesce(h, 0) / n_rel AS recall FROM (SELECT model, u, n_rel FROM (SELECT DISTINCT model FROM mt_rows), supp_nrel) n LEFT JOIN (SELECT model, u, CAST(count(*) AS DOUBLE) AS h FROM mt_rows JOIN supp_rel USING (u, i) GROUP BY 1, 2) x ON x.u = n.u AND x.model = n.model",
    "mt_group": "SELECT model, grp, avg(precision) AS precision, avg(recall) AS recall FROM mt_user JOIN supp_hgrp USING (u) GROUP BY 1, 2",
}


def per_user(ctx) -> DataFrame:
    truth = metrics.relevant(ctx.test)
    return reduce(DataFrame.unionByName, (metrics.user_metrics(f(ctx), truth).withColumn("model", F.lit(n)) for n, f in MODELS.items()))


@query("model:s sparse:d medium:d heavy:d gain:d relative_gain:d", "SELECT model, sparse, medium, heavy, heavy - sparse AS gain, CASE WHEN sparse > 0 THEN (heavy - sparse) / sparse END AS relative_gain FROM (SELECT model, max(recall) FILTER (grp = 'sparse') AS sparse, max(recall) FILTER (grp = 'medium') AS medium, max(recall) FILTER (grp = 'heavy') AS heavy FROM mt_group GROUP BY 1)")
def coldstart_pivot(spark, sf_dir):
    """Recall by history group side by side, and what a heavy history gains."""
    ctx = context(spark, sf_dir, "supp")
    rows = per_user(ctx).join(ctx.histories().select("u", "grp"), "u").groupBy("model").pivot("grp", ["sparse", "medium", "heavy"]).agg(F.avg("recall"))
    gain = F.col("heavy") - F.col("sparse")
    return rows.select("model", "sparse", "medium", "heavy", gain.alias("gain"), F.when(F.col("sparse") > 0, gain / F.col("sparse")).alias("relative_gain"))


@query("model:s n_used:i n_groups:i monotone:b", "SELECT model, count(*) AS n_used, 3 AS n_groups, max(precision) FILTER (grp = 'sparse') < max(precision) FILTER (grp = 'medium') AND max(precision) FILTER (grp = 'medium') < max(precision) FILTER (grp = 'heavy') AS monotone FROM mt_group GROUP BY 1")
def group_monotone(spark, sf_dir):
    """Whether precision strictly grows with the history."""
    ctx = context(spark, sf_dir, "supp")
    rows = per_user(ctx).join(ctx.histories().select("u", "grp"), "u").groupBy("model", "grp").agg(F.avg("precision").alias("p")).groupBy("model").agg(F.count(F.lit(1)).alias("n_used"), *(F.max(F.when(F.col("grp") == g, F.col("p"))).alias(g) for g in ("sparse", "medium", "heavy")))
    return rows.select("model", "n_used", F.lit(3).alias("n_groups"), ((F.col("sparse") < F.col("medium")) & (F.col("medium") < F.col("heavy"))).alias("monotone"))


@query("popularity_beats_random:b item_mean_beats_mean:b", "SELECT (SELECT precision FROM mt WHERE model = 'popularity') > (SELECT precision FROM mt WHERE model = 'random') AS popularity_beats_random, (SELECT sqrt(avg((mean - r) ** 2)) FROM supp_test JOIN supp_im USING (i)) <= (SELECT sqrt(avg((mu - r) ** 2)) FROM supp_test, supp_mu) AS item_mean_beats_mean")
def baseline_sanity(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    table = {r["model"]: r["precision"] for r in metric_table(ctx).collect()}
    items = ctx.test.join(baselines.means(ctx.train, "i", ctx.items), "i").agg(F.sqrt(F.avg(F.pow(F.col("mean") - F.col("r"), 2))).alias("a"))
    overall = ctx.test.crossJoin(F.broadcast(baselines.global_mean(ctx.train))).agg(F.sqrt(F.avg(F.pow(F.col("mu") - F.col("r"), 2))).alias("b"))  # one row
    return items.crossJoin(overall).select(F.lit(table["popularity"] > table["random"]).alias("popularity_beats_random"), (F.col("a") <= F.col("b")).alias("item_mean_beats_mean"))


@query("n:i n_folds:i disjoint:b covering:b all_train:b", "SELECT count(*) AS n, count(DISTINCT fold) AS n_folds, count(*) = count(DISTINCT (u, i)) AS disjoint, count(*) = (SELECT count(*) FROM supp) AS covering, (SELECT count(DISTINCT u) FROM supp_train) = (SELECT count(*) FROM supp_users) AS all_train FROM supp_split")
def partition_checks(spark, sf_dir):
    rows = split(spark, sf_dir, "supp")
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("n_folds"), F.count_distinct("u", "i").alias("cells"), F.count_distinct("u").alias("users"), F.count_distinct(F.when(F.col("fold") == "train", F.col("u"))).alias("trained"))
    return one.select("n", "n_folds", (F.col("n") == F.col("cells")).alias("disjoint"), (F.col("n") == F.col("cells")).alias("covering"), (F.col("users") == F.col("trained")).alias("all_train"))


@query("bucket:i n:i", "SELECT CAST(floor(hist / 5) AS BIGINT) AS bucket, count(*) AS n FROM supp_hist GROUP BY 1")
def activity_histogram(spark, sf_dir):
    return context(spark, sf_dir, "supp").histories().groupBy(F.floor(F.col("hist") / 5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("slope:d intercept:d n:i", "SELECT regr_slope(mean, cnt) AS slope, regr_intercept(mean, cnt) AS intercept, count(*) AS n FROM supp_cnt JOIN supp_im USING (i)")
def popularity_line(spark, sf_dir):
    """Least-squares line of an item's mean over its popularity."""
    ctx = context(spark, sf_dir, "supp")
    rows = ctx.counts().join(baselines.means(ctx.train, "i", ctx.items), "i")
    return rows.agg(F.expr("regr_slope(mean, cnt)").alias("slope"), F.expr("regr_intercept(mean, cnt)").alias("intercept"), F.count(F.lit(1)).alias("n"))


@query("k:i model:s precision:d", "SELECT k, model, precision FROM (SELECT k, model, avg(coalesce(h, 0)) / k AS precision FROM (SELECT DISTINCT model FROM mt_rows), (SELECT unnest([3, 5, 10]) AS k), supp_nrel n LEFT JOIN (SELECT model AS m2, k AS k2, u, CAST(count(*) AS DOUBLE) AS h FROM mt_rows JOIN supp_rel USING (u, i), (SELECT unnest([3, 5, 10]) AS k) WHERE rank <= k GROUP BY 1, 2, 3) x ON x.u = n.u AND m2 = model AND k2 = k GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(precision, 9) DESC, model) = 1")
def best_per_k(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    truth, lists = metrics.relevant(ctx.test), {n: f(ctx).persist() for n, f in MODELS.items()}
    rows = [metrics.user_metrics(df, truth, k).agg(F.lit(k).alias("k"), F.lit(n).alias("model"), F.avg("precision").alias("precision")) for k in (3, 5, 10) for n, df in lists.items()]
    order = Window.partitionBy("k").orderBy(F.desc(F.round("precision", 9)), F.asc("model"))
    return reduce(DataFrame.unionByName, rows).withColumn("_n", F.row_number().over(order)).where("_n = 1")


@query("metric:s model:s reference:s gain:d gain_pct:d", "SELECT 'precision' AS metric, 'popularity' AS model, 'random' AS reference, p - r AS gain, CASE WHEN r > 0 THEN 100 * (p - r) / r END AS gain_pct FROM (SELECT max(precision) FILTER (model = 'popularity') AS p, max(precision) FILTER (model = 'random') AS r FROM mt)")
def relative_gains(spark, sf_dir):
    table = metric_table(context(spark, sf_dir, "supp"))
    one = table.agg(F.max(F.when(F.col("model") == "popularity", F.col("precision"))).alias("p"), F.max(F.when(F.col("model") == "random", F.col("precision"))).alias("r"))
    gain = F.col("p") - F.col("r")
    return one.select(F.lit("precision").alias("metric"), F.lit("popularity").alias("model"), F.lit("random").alias("reference"), gain.alias("gain"), F.when(F.col("r") > 0, 100 * gain / F.col("r")).alias("gain_pct"))


@query("axis:s winner:s", " UNION ALL ".join(f"SELECT '{a}' AS axis, first(model ORDER BY round({a}, 9) DESC, model) AS winner FROM mt" for a in ("precision", "coverage", "unpopularity")))
def axis_winners(spark, sf_dir):
    table = metric_table(context(spark, sf_dir, "supp"))
    long = table.select("model", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in ("precision", "coverage", "unpopularity")))).alias("x"))
    return long.groupBy("x.axis").agg(F.min_by("model", F.struct(-F.round("x.v", 9), "model")).alias("winner"))


@query("src:i dst:i sim:d w:d gap:d", "SELECT nbr AS src, n.i AS dst, sim, p / a AS w, p / a - sim AS gap FROM egram g JOIN enear n ON n.i = g.i AND n.pos = 1 ORDER BY round(abs(p / a - sim), 9) DESC, n.i LIMIT 50")
def regression_disagreements(spark, sf_dir):
    """Where a learned weight and the similarity differ most."""
    w = ridge(spark, sf_dir, 1)[1].withColumn("gap", F.col("w") - F.col("sim"))
    return w.orderBy(F.desc(F.round(F.abs("gap"), 9)), F.asc("dst")).limit(50)


CTES["simcoef"] = "SELECT round(sim, 9) AS s, round(p / a, 9) AS w FROM egram g JOIN enear n ON n.i = g.i AND n.pos = 1"


@query("n:i spearman:d", "SELECT count(*) AS n, corr(rs, rw) AS spearman FROM (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0 AS rw FROM simcoef)")
def sim_vs_coef_spearman(spark, sf_dir):
    """Rank correlation, ties sharing their mean rank; one row a catalogue item."""
    rows = ridge(spark, sf_dir, 1)[1].select(F.round("sim", 9).alias("s"), F.round("w", 9).alias("w"))

    def mean_rank(c, name):
        levels = running(rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, F.col("n"), "before")
        return levels.select(c, (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))

    ranks = rows.join(mean_rank("s", "a"), "s").join(mean_rank("w", "b"), "w")
    return ranks.agg(F.count(F.lit(1)).alias("n"), (F.covar_pop("a", "b") / F.sqrt(F.var_pop("a") * F.var_pop("b"))).alias("spearman"))


@query("lam:d mean_abs_w:d", "SELECT lam, avg(abs(p / (a - 25 + lam))) AS mean_abs_w FROM egram, (SELECT unnest([25.0, 100.0]) AS lam) GROUP BY 1")
def lambda_shrinkage(spark, sf_dir):
    """How a stronger ridge shrinks the weights."""
    from affinade.operators import regression

    ctx = context(spark, sf_dir)
    sim = similarity.similarity(similarity.by_item(ctx.train), "adjusted_cosine")
    one = [regression.regression_weights(ctx.train, sim, ctx.items, 1, lam, iterations=2)[0].agg(F.lit(lam).alias("lam"), F.avg(F.abs("w")).alias("mean_abs_w")) for lam in (25.0, 100.0)]
    return one[0].unionByName(one[1])


@query("u:i i:i text:s", "SELECT u, i, 'via item ' || via || ': ' || CAST(round(weight * 1000000) AS BIGINT) || ' millionths over ' || paths || ' paths' AS text FROM (SELECT * FROM (SELECT t.u, t.i, a.i AS via, sum(1.0 / (du.n * dj.n * dv.n)) AS weight, count(*) AS paths FROM evt_test t JOIN elike a ON a.u = t.u AND a.i <> t.i JOIN elike b ON b.i = a.i AND b.u <> t.u JOIN elike c ON c.u = b.u AND c.i = t.i JOIN (SELECT u, count(*) AS n FROM elike GROUP BY 1) du ON du.u = t.u JOIN (SELECT i, count(*) AS n FROM elike GROUP BY 1) dj ON dj.i = a.i JOIN (SELECT u, count(*) AS n FROM elike GROUP BY 1) dv ON dv.u = b.u GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY u, i ORDER BY round(weight, 9) DESC, via) = 1)")
def explain_text(spark, sf_dir):
    """The strongest path of each held-out pair in words."""
    ctx, edges = edges_of(spark, sf_dir)
    why = graph.explain_paths(edges, ctx.test.select("u", "i"))
    best = why.withColumn("_n", F.row_number().over(Window.partitionBy("u", "i").orderBy(F.desc(F.round("weight", 9)), F.asc("via")))).where("_n = 1")
    return best.select("u", "i", F.format_string("via item %d: %d millionths over %d paths", "via", F.round(F.col("weight") * 1000000).cast("long"), "paths").alias("text"))


@query("i:i n_features:i features:s", "SELECT i, count(*) AS n_features, string_agg(feature, ', ' ORDER BY feature) AS features FROM sfeat GROUP BY 1")
def item_features(spark, sf_dir):
    return supplier_features(spark, sf_dir).groupBy("i").agg(F.count(F.lit(1)).alias("n_features"), F.array_join(F.sort_array(F.collect_list("feature")), ", ").alias("features"))


@query("model:s k:i sparsity:d", "SELECT 'ibcf' AS model, 20 AS k, 1 - 20.0 / ((SELECT count(*) FROM supp_items) - 1) AS sparsity UNION ALL SELECT 'ubcf', 80, 1 - 80.0 / ((SELECT count(*) FROM supp_users) - 1)")
def neighbourhood_sparsity(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    n_items, n_users = ctx.items.agg(F.count(F.lit(1)).alias("n")), ctx.users.agg(F.count(F.lit(1)).alias("n"))
    return n_items.select(F.lit("ibcf").alias("model"), F.lit(20).alias("k"), (1 - 20 / (F.col("n") - 1)).alias("sparsity")).union(n_users.select(F.lit("ubcf"), F.lit(80), 1 - 80 / (F.col("n") - 1)))


TARGET = 7
HIDDEN = f"SELECT i FROM (SELECT i, row_number() OVER (ORDER BY md5(concat('{42 ^ 0x5EED}:', u, ':', i)), i) AS p, count(*) OVER () AS n FROM supp_train WHERE u = {TARGET}) WHERE p <= least(round_even(n * CAST(0.3 AS DOUBLE), 0), greatest(0, n - 5))"
CTES["t_hidden"] = HIDDEN
CTES["t_train"] = f"SELECT u, i, r FROM supp_train WHERE NOT (u = {TARGET} AND i IN (SELECT i FROM t_hidden))"
CTES["t_truth"] = f"SELECT i, r FROM supp_train WHERE u = {TARGET} AND i IN (SELECT i FROM t_hidden) UNION ALL SELECT i, r FROM supp_test WHERE u = {TARGET}"
CTES["t_score"] = "SELECT 'popularity' AS model, i, CAST(count(t.r) AS DOUBLE) AS score FROM supp_items LEFT JOIN t_train t USING (i) GROUP BY 2 UNION ALL SELECT 'positive', i, CAST(count(t.r) FILTER (t.r >= 4) AS DOUBLE) FROM supp_items LEFT JOIN t_train t USING (i) GROUP BY 2 UNION ALL SELECT 'item_mean', i, coalesce(avg(t.r), (SELECT avg(r) FROM t_train)) FROM supp_items LEFT JOIN t_train t USING (i) GROUP BY 2"
CTES["t_list"] = f"SELECT model, row_number() OVER (PARTITION BY model ORDER BY round(score, 9) DESC, i) AS rank, i, score FROM t_score WHERE i NOT IN (SELECT i FROM t_train WHERE u = {TARGET}) QUALIFY rank <= 10"
SPECS = {"popularity": {"family": "popularity"}, "positive": {"family": "popularity_positive"}, "item_mean": {"family": "item_mean"}}


@query("model:s rank:i i:i score:d cnt:i grp:s held_r:d is_hit:b", "SELECT model, rank, l.i, score, cnt, grp, t.r AS held_r, coalesce(t.r >= 4, false) AS is_hit FROM t_list l JOIN supp_grp g ON g.i = l.i LEFT JOIN t_truth t ON t.i = l.i")
def target_user_lists(spark, sf_dir):
    return target.lists_of(context(spark, sf_dir, "supp"), TARGET, SPECS)


@query("model:s hits:i n_rel:i precision:d recall:d recall_ceiling:d", "SELECT model, hits, n_rel, hits / 10.0 AS precision, CAST(hits AS DOUBLE) / n_rel AS recall, least(1.0, 10.0 / n_rel) AS recall_ceiling FROM (SELECT model, count(*) FILTER (t.r >= 4) AS hits FROM t_list l LEFT JOIN t_truth t ON t.i = l.i GROUP BY 1), (SELECT nullif(count(*), 0) AS n_rel FROM t_truth WHERE r >= 4)")
def target_user_metrics(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return target.metrics_of(ctx, TARGET, target.lists_of(ctx, TARGET, SPECS))


@query("n_models:i n_items:i", "SELECT n_models, count(*) AS n_items FROM (SELECT i, count(DISTINCT model) AS n_models FROM mt_rows GROUP BY 1) GROUP BY 1")
def consensus_counts(spark, sf_dir):
    from affinade.plans import analysis

    return analysis.consensus(three_lists(context(spark, sf_dir, "supp"))).groupBy("n_models").agg(F.count(F.lit(1)).alias("n_items"))


@query("u:i n_near:i", "SELECT a AS u, count(*) FILTER (sim > 0) AS n_near FROM euser_pea_rel GROUP BY 1")
def neighbourhood_sizes(spark, sf_dir):
    sim = similarity.similarity(similarity.by_user(context(spark, sf_dir).train), "pearson")
    return sim.groupBy(F.col("a").alias("u")).agg(F.count_if(F.col("sim") > 0).alias("n_near"))


CTES["ib_raw"] = "SELECT n.u AS u, n.i AS i, sum(sim * n.r) AS num, sum(abs(sim)) AS den FROM ibnb n GROUP BY 1, 2"


@query("u:i i:i pred:d", "SELECT c.u, c.i, CASE WHEN den > 1e-10 THEN num / den ELSE m.mean END AS pred FROM evt_cells c JOIN evt_um m USING (u) LEFT JOIN ib_raw s ON s.u = c.u AND s.i = c.i WHERE den > 0 OR EXISTS (SELECT 1 FROM evt_held h WHERE h.u = c.u AND h.i = c.i)")
def ibcf_raw_predict(spark, sf_dir):
    return with_held(*item_heads(spark, sf_dir, centre=False), True)


@query("n:i mean:d median:d std:d p99:d largest:d smallest:d", "SELECT count(*) AS n, avg(w) AS mean, quantile_cont(w, 0.5) AS median, stddev_samp(w) AS std, quantile_cont(w, 0.99) AS p99, max(w) AS largest, min(w) AS smallest FROM (SELECT p / a AS w FROM egram g JOIN enear n ON n.i = g.i AND n.pos = 1)")
def coefficient_stats(spark, sf_dir):
    """How the learned weights are distributed."""
    at = lambda p: F.percentile("w", F.lit(p))
    w = ridge(spark, sf_dir, 1)[1]
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean"), at(0.5).alias("median"), F.stddev_samp("w").alias("std"), at(0.99).alias("p99"), F.max("w").alias("largest"), F.min("w").alias("smallest"))


@query("n:i ceiling:d", "SELECT count(*) AS n, avg(least(n_rel, 10) / n_rel) AS ceiling FROM evt_nrel")
def recall_ceiling(spark, sf_dir):
    """The mean recall that lists of ten could reach at best."""
    n = metrics.relevant(context(spark, sf_dir).test).groupBy("u").agg(F.count(F.lit(1)).alias("n_rel"))
    return n.agg(F.count(F.lit(1)).alias("n"), F.avg(F.least("n_rel", F.lit(10)) / F.col("n_rel")).alias("ceiling"))


@query("u:i i:i r:d", "SELECT u, i, r FROM evt ORDER BY md5(concat('7:', u, ':', i)), u, i LIMIT 100")
def seeded_sample(spark, sf_dir):
    """A sample of 100 ratings by hash order, the same on every run and partitioning."""
    ratings = context(spark, sf_dir).ratings
    return ratings.orderBy(F.md5(F.concat_ws(":", F.lit("7"), "u", "i")), "u", "i").limit(100).select("u", "i", "r")


_BY_RATING = ", ".join(f"avg(mean - t.r) FILTER (t.r = {r}) AS r{r}" for r in range(1, 6))


@query("model:s r1:d r2:d r3:d r4:d r5:d", f"SELECT 'item_mean' AS model, {_BY_RATING} FROM supp_test t JOIN supp_im USING (i) UNION ALL SELECT 'user_mean', {_BY_RATING} FROM supp_test t JOIN supp_um USING (u)")
def bias_by_true_rating(spark, sf_dir):
    """Mean error by model and true rating: means pull high ratings down and low ones up."""
    ctx = context(spark, sf_dir, "supp")
    sides = (("item_mean", "i", ctx.items), ("user_mean", "u", ctx.users))
    rows = [ctx.test.join(baselines.means(ctx.train, c, all_), c).select(F.lit(m).alias("model"), "r", (F.col("mean") - F.col("r")).alias("e")) for m, c, all_ in sides]
    wide = rows[0].union(rows[1]).groupBy("model").pivot("r", [1.0, 2.0, 3.0, 4.0, 5.0]).agg(F.avg("e"))
    return wide.select("model", *(F.col(f"`{float(k)}`").alias(f"r{k}") for k in range(1, 6)))
