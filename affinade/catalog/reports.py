"""Analyses over several models' lists and metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinade.catalog.base import CTES, context, query
from affinade.catalog.models import item_heads
from affinade.catalog.tables import popularity_lists, three_lists
from affinade.operators import baselines, metrics, regression, similarity
from affinade.plans import analysis

CTES |= {
    "supp_pred": "SELECT t.u, i, t.r, m.mean AS pred FROM supp_test t JOIN supp_im m USING (i)",
    "mt_rows": "SELECT l.model, l.u, l.i, l.rank, l.score FROM supp_lists l",
    "mt_hit": "SELECT model, avg(coalesce(h, 0)) / 10 AS precision FROM (SELECT DISTINCT model FROM mt_rows), supp_nrel n LEFT JOIN (SELECT model AS m2, u, CAST(count(*) AS DOUBLE) AS h FROM mt_rows JOIN supp_rel USING (u, i) GROUP BY 1, 2) x ON x.u = n.u AND x.m2 = model GROUP BY 1",
    "mt_cov": "SELECT model, CAST(count(DISTINCT i) AS DOUBLE) / (SELECT count(*) FROM supp_items) AS coverage, avg(cnt) AS popularity FROM mt_rows JOIN supp_cnt USING (i) GROUP BY 1",
    "mt": "SELECT model, precision, coverage, -popularity AS unpopularity FROM mt_hit JOIN mt_cov USING (model)",
}


def metric_table(ctx) -> DataFrame:
    """model, precision, coverage, unpopularity of the three lists that need no fit."""
    lists, truth = three_lists(ctx).persist(), metrics.relevant(ctx.test)  # read four times
    names = ("popularity", "item_mean", "random")
    hits = reduce(DataFrame.unionByName, (metrics.user_metrics(lists.where(F.col("model") == m), truth).agg(F.lit(m).alias("model"), F.avg("precision").alias("precision")) for m in names))
    n = ctx.items.count()
    rest = lists.join(ctx.counts(), "i").groupBy("model").agg((F.count_distinct("i") / F.lit(float(n))).alias("coverage"), (-F.avg("cnt")).alias("unpopularity"))
    return hits.join(rest, "model")


def item_mean_pred(ctx) -> DataFrame:
    return ctx.test.join(baselines.means(ctx.train, "i", ctx.items), "i").select("u", "i", F.col("mean").alias("pred"))


@query("user_group:s n_users:i mean_history:d mean_positives:d median_positives:d precision:d recall:d hit_rate:d ndcg:d ap:d", "SELECT grp AS user_group, count(*) AS n_users, avg(hist) AS mean_history, avg(n_rel) AS mean_positives, quantile_cont(n_rel, 0.5) AS median_positives, avg(precision) AS precision, avg(recall) AS recall, avg(hit_rate) AS hit_rate, avg(ndcg) AS ndcg, avg(ap) AS ap FROM supp_hgrp LEFT JOIN supp_um10 USING (u) GROUP BY 1")
def user_group_breakdown(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return analysis.user_groups(metrics.user_metrics(popularity_lists(ctx), metrics.relevant(ctx.test)), ctx.histories())


@query("item_group:s n_users:i recall:d", "SELECT grp AS item_group, count(*) AS n_users, avg(CAST(h AS DOUBLE) / n) AS recall FROM (SELECT grp, r.u, count(*) AS n, count(p.i) AS h FROM supp_rel r JOIN supp_grp g ON g.i = r.i LEFT JOIN supp_pop p ON p.u = r.u AND p.i = r.i GROUP BY 1, 2) GROUP BY 1")
def item_group_breakdown(spark, sf_dir):
    """Truth restricted to a group, lists as they are."""
    ctx = context(spark, sf_dir, "supp")
    lists, truth = popularity_lists(ctx), metrics.relevant(ctx.test).join(ctx.groups().select("i", "grp"), "i")
    rows = truth.join(lists.select("u", "i", F.lit(1).alias("hit")), ["u", "i"], "left").groupBy("grp", "u").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return rows.groupBy(F.col("grp").alias("item_group")).agg(F.count(F.lit(1)).alias("n_users"), F.avg("recall").alias("recall"))


@query("model:s mean_popularity:d median_popularity:d mean_pop_rank:d head_pct:d medium_pct:d long_tail_pct:d n_distinct:i coverage:d gini:d", """SELECT * FROM (SELECT model, avg(cnt) AS mean_popularity, quantile_cont(cnt, 0.5) AS median_popularity, avg(pop_rank) AS mean_pop_rank,
  100 * avg((grp = 'head')::INT) AS head_pct, 100 * avg((grp = 'medium')::INT) AS medium_pct, 100 * avg((grp = 'long_tail')::INT) AS long_tail_pct, count(DISTINCT i) AS n_distinct, CAST(count(DISTINCT i) AS DOUBLE) / (SELECT count(*) FROM supp_items) AS coverage
  FROM mt_rows JOIN supp_grp USING (i) JOIN supp_rank USING (i) GROUP BY 1) JOIN (
  SELECT model, 2 * sum(rn * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*) AS gini FROM (SELECT model, x, row_number() OVER (PARTITION BY model ORDER BY x, i) AS rn FROM (
  SELECT m.model, s.i, count(l.u) AS x FROM (SELECT DISTINCT model FROM mt_rows) m CROSS JOIN supp_items s LEFT JOIN mt_rows l ON l.model = m.model AND l.i = s.i GROUP BY 1, 2)) GROUP BY 1) USING (model)""")
def popularity_bias_table(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return analysis.popularity_bias(three_lists(ctx).persist(), ctx.counts(), ctx.groups(), ctx.ranks(), ctx.items)


@query("stratum:s level:s n:i rmse:d mae:d bias:d", """SELECT stratum, level, count(*) AS n, sqrt(avg((pred - r) ** 2)) AS rmse, avg(abs(pred - r)) AS mae, avg(pred - r) AS bias FROM (
  SELECT 'overall' AS stratum, 'all' AS level, r, pred FROM supp_pred UNION ALL SELECT 'true_rating', CAST(CAST(r AS INT) AS VARCHAR), r, pred FROM supp_pred
  UNION ALL SELECT 'item_group', grp, r, pred FROM supp_pred JOIN supp_grp USING (i) UNION ALL SELECT 'user_group', grp, r, pred FROM supp_pred JOIN supp_hgrp USING (u)) GROUP BY 1, 2""")
def error_strata(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return analysis.error_strata(item_mean_pred(ctx), ctx.test, ctx.groups(), ctx.histories())


@query("users_evaluated:i users_with_a_hit:i hit_rate:d mean_first_hit:d median_first_hit:d", "SELECT count(*) AS users_evaluated, count(f) AS users_with_a_hit, CAST(count(f) AS DOUBLE) / count(*) AS hit_rate, avg(f) AS mean_first_hit, quantile_cont(f, 0.5) AS median_first_hit FROM supp_nrel LEFT JOIN (SELECT u, min(rank) AS f FROM supp_hits GROUP BY 1) USING (u)")
def first_hit_rank(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return analysis.first_hits(popularity_lists(ctx), metrics.relevant(ctx.test))


@query("i:i n:i rmse:d", "SELECT i, count(*) AS n, sqrt(avg((pred - r) ** 2)) AS rmse FROM supp_pred GROUP BY 1 HAVING count(*) >= 10 ORDER BY round(rmse, 9) DESC, i LIMIT 20")
def hardest_items(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return analysis.hardest_items(item_mean_pred(ctx), ctx.test)


@query("i:i n:i variance:d extreme_share:d", "SELECT i, count(*) AS n, var_samp(r) AS variance, avg((r IN (1, 2, 5))::INT) AS extreme_share FROM supp GROUP BY 1 HAVING count(*) >= 50")
def polarisation(spark, sf_dir):
    return analysis.polarisation(context(spark, sf_dir, "supp").ratings)


@query("i:i n_models:i models:s", "SELECT i, count(DISTINCT model) AS n_models, string_agg(DISTINCT model, ', ' ORDER BY model) AS models FROM mt_rows GROUP BY 1")
def consensus(spark, sf_dir):
    return analysis.consensus(three_lists(context(spark, sf_dir, "supp")))


@query("i:i n_models:i coverage:d best_rank:i divisiveness:d", "SELECT i, n_models, n_models / 3.0 AS coverage, best_rank, (1 - n_models / 3.0) / log2(best_rank + 1) AS divisiveness FROM (SELECT i, count(DISTINCT model) AS n_models, min(rank) AS best_rank FROM mt_rows GROUP BY 1)")
def divisiveness(spark, sf_dir):
    return analysis.divisiveness(three_lists(context(spark, sf_dir, "supp")).persist())


@query("model:s precision:d coverage:d unpopularity:d", "SELECT * FROM mt")
def model_metrics(spark, sf_dir):
    return metric_table(context(spark, sf_dir, "supp"))


GOALS = ["precision", "coverage", "unpopularity"]
WORSE = "b.precision >= a.precision AND b.coverage >= a.coverage AND b.unpopularity >= a.unpopularity AND (b.precision > a.precision OR b.coverage > a.coverage OR b.unpopularity > a.unpopularity)"


@query("model:s precision:d coverage:d unpopularity:d", f"SELECT * FROM mt a WHERE NOT EXISTS (SELECT 1 FROM mt b WHERE {WORSE})")
def pareto_front(spark, sf_dir):
    return analysis.pareto_front(metric_table(context(spark, sf_dir, "supp")), GOALS)


@query("model:s better:s", f"SELECT a.model, b.model AS better FROM mt a JOIN mt b ON {WORSE}")
def dominated_by(spark, sf_dir):
    return analysis.dominated(metric_table(context(spark, sf_dir, "supp")), GOALS).withColumnRenamed("by", "better")


@query("model:s rank_precision:i rank_coverage:i rank_unpopularity:i", "SELECT model, rank() OVER (ORDER BY precision DESC) AS rank_precision, rank() OVER (ORDER BY coverage DESC) AS rank_coverage, rank() OVER (ORDER BY unpopularity DESC) AS rank_unpopularity FROM mt")
def model_axis_ranks(spark, sf_dir):
    return analysis.axis_ranks(metric_table(context(spark, sf_dir, "supp")), {g: True for g in GOALS})


CTES["blocks"] = "SELECT model, CASE WHEN model = 'random' THEN 'none' ELSE 'counts' END AS family, precision, coverage FROM mt"


def blocks_of(spark, sf_dir):
    return metric_table(context(spark, sf_dir, "supp")).withColumn("family", F.when(F.col("model") == "random", "none").otherwise("counts"))


@query("family:s model:s delta:d spread:d", "SELECT family, model, precision - max(precision) OVER w AS delta, max(precision) OVER w - min(precision) OVER w AS spread FROM blocks WINDOW w AS (PARTITION BY family)")
def block_deltas(spark, sf_dir):
    return analysis.block_deltas(blocks_of(spark, sf_dir), ["family"], "precision")


@query("family:s best:s worst:s spread:d tied:b", "SELECT family, first(model ORDER BY round(precision, 9) DESC, model) AS best, first(model ORDER BY round(precision, 9), model) AS worst, max(precision) - min(precision) AS spread, max(precision) - min(precision) <= 1e-9 AS tied FROM blocks GROUP BY 1")
def block_summary(spark, sf_dir):
    return analysis.block_summary(blocks_of(spark, sf_dir), ["family"], "model", "precision")


@query("metric:s model:s value:d", " UNION ALL ".join(f"(SELECT '{m}' AS metric, model, {m} AS value FROM mt ORDER BY round({m}, 9) DESC, list_position(['popularity', 'item_mean', 'random'], model) LIMIT 1)" for m in ("precision", "coverage")))
def select_best_config(spark, sf_dir):
    """The first model of the list among equals on each metric."""
    order = F.array_position(F.array(*(F.lit(m) for m in ("popularity", "item_mean", "random"))), F.col("model"))
    table = metric_table(context(spark, sf_dir, "supp")).withColumn("grid", order)
    best = [table.orderBy(F.desc(F.round(m, 9)), "grid").limit(1).select(F.lit(m).alias("metric"), "model", F.col(m).alias("value")) for m in ("precision", "coverage")]
    return best[0].unionByName(best[1])


@query("u:i model:s r1:i r2:i r3:i r4:i r5:i", "SELECT u, model, " + ", ".join(f"max(i) FILTER (rank = {k}) AS r{k}" for k in range(1, 6)) + " FROM mt_rows GROUP BY 1, 2")
def compare_wide(spark, sf_dir):
    rows = analysis.wide(three_lists(context(spark, sf_dir, "supp")), 5)
    return rows.select("u", "model", *(F.col(str(k)).alias(f"r{k}") for k in range(1, 6)))


@query("u:i i:i percentile:d", "SELECT t.u, t.i, 100 * avg((round(s.num, 9) < round(o.num, 9))::INT) AS percentile FROM evt_test t JOIN ib_all o ON o.u = t.u AND o.i = t.i JOIN (SELECT u, i, num FROM ib_all ANTI JOIN evt_train USING (u, i)) s ON s.u = t.u GROUP BY 1, 2")
def score_percentile(spark, sf_dir):
    ctx, heads = item_heads(spark, sf_dir)
    return analysis.score_percentile(heads.select("u", "i", F.col("num").alias("score")), ctx.test, ctx.train, ctx.items)


@query("n:i pearson:d", "SELECT count(*) AS n, corr(cnt, mean) AS pearson FROM supp_cnt JOIN supp_im USING (i)")
def popularity_mean_correlation(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return analysis.correlation(ctx.counts().join(baselines.means(ctx.train, "i", ctx.items), "i"), "cnt", "mean")


@query("n:i pearson:d sign_flips:d negative:d", "SELECT count(*) AS n, corr(sim, p / a) AS pearson, avg((sim > 0.05 AND p / a < 0)::INT) AS sign_flips, avg((p / a < 0)::INT) AS negative FROM egram g JOIN enear n ON n.i = g.i AND n.pos = 1")
def sim_vs_coef_corr(spark, sf_dir):
    ctx = context(spark, sf_dir)
    sim = similarity.similarity(similarity.by_item(ctx.train), "adjusted_cosine")
    w, _ = regression.regression_weights(ctx.train, sim, ctx.items, 1, 25.0, iterations=2)
    return analysis.similarity_against_weights(w)


@query("rank_mode:s precision:d recall:d hit_rate:d", " UNION ALL ".join(f"SELECT '{mode}' AS rank_mode, avg(coalesce(h, 0)) / 10 AS precision, avg(coalesce(h, 0) / n_rel) AS recall, avg((coalesce(h, 0) > 0)::INT) AS hit_rate FROM evt_nrel LEFT JOIN (SELECT u, CAST(count(*) AS DOUBLE) AS h FROM (SELECT u, i FROM ({score}) s ANTI JOIN evt_train t USING (u, i) QUALIFY row_number() OVER (PARTITION BY u ORDER BY round(score, 9) DESC, i) <= 10) JOIN evt_rel USING (u, i) GROUP BY 1) USING (u)" for mode, score in (("rating", "SELECT u, i, pred AS score FROM ib_all"), ("score", "SELECT u, i, num AS score FROM ib_all"), ("affinity", "SELECT u, i, aff AS score FROM ib_all"))))
def rank_modes(spark, sf_dir):
    from affinade.plans.evaluate import rank_modes as modes

    ctx, heads = item_heads(spark, sf_dir)
    return modes(ctx, heads, ctx.test, "i")
