"""Statistics, splits, groups, baselines and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinade.catalog.base import VIEWS, context, query, split
from affinade.config import CONFIG
from affinade.operators import baselines, groups, metrics
from affinade.operators.split import hide_profile
from affinade.operators.topk import hashed_top_k, item_scores_top_k
from affinade.plans.evaluate import Context
from affinade.sources.ratings import totals_check


def popularity_lists(ctx: Context) -> DataFrame:
    return item_scores_top_k(ctx.users, baselines.popularity_scores(ctx.train, ctx.items), 10, ctx.train)


def mean_lists(ctx: Context) -> DataFrame:
    return item_scores_top_k(ctx.users, baselines.means(ctx.train, "i", ctx.items).select("i", F.col("mean").alias("score")), 10, ctx.train)


def random_lists(ctx: Context) -> DataFrame:
    return hashed_top_k(ctx.users, ctx.items, CONFIG.seed, 10, ctx.train)


def three_lists(ctx: Context) -> DataFrame:
    named = {"popularity": popularity_lists, "item_mean": mean_lists, "random": random_lists}
    return reduce(DataFrame.unionByName, (f(ctx).withColumn("model", F.lit(n)) for n, f in named.items()))


@query("rating:d n:i", "SELECT r AS rating, count(*) AS n FROM supp GROUP BY 1")
def rating_distribution(spark, sf_dir):
    return groups.rating_distribution(VIEWS["supp"](spark, sf_dir))


@query("n_users:i n_items:i nnz:i cells:i density_pct:d sparsity_pct:d", "SELECT *, n_users * n_items AS cells, 100.0 * nnz / (n_users * n_items) AS density_pct, 100 - 100.0 * nnz / (n_users * n_items) AS sparsity_pct FROM (SELECT count(DISTINCT u) AS n_users, count(DISTINCT i) AS n_items, count(*) AS nnz FROM supp)")
def sparsity_stats(spark, sf_dir):
    return groups.sparsity(VIEWS["supp"](spark, sf_dir))


@query("n:i min_r:d max_r:d n_values:i mean_r:d std_r:d median_r:d", "SELECT count(*) AS n, min(r) AS min_r, max(r) AS max_r, count(DISTINCT r) AS n_values, avg(r) AS mean_r, stddev_samp(r) AS std_r, quantile_cont(r, 0.5) AS median_r FROM supp")
def overview_stats(spark, sf_dir):
    return groups.overview(VIEWS["supp"](spark, sf_dir))


@query("u:i n:i mean_r:d", "SELECT u, count(*) AS n, avg(r) AS mean_r FROM supp GROUP BY 1")
def user_activity(spark, sf_dir):
    return VIEWS["supp"](spark, sf_dir).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_r"))


@query("i:i cnt:i", "SELECT i, cnt FROM supp_cnt")
def item_popularity(spark, sf_dir):
    return context(spark, sf_dir, "supp").counts()


@query("without_user:i without_item:i", "SELECT (SELECT count(*) FROM supp ANTI JOIN customer ON u = c_custkey) AS without_user, (SELECT count(*) FROM supp ANTI JOIN supplier ON i = s_suppkey) AS without_item")
def index_totality(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("u"))
    items = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("i"))
    return totals_check(VIEWS["supp"](spark, sf_dir), users, items)


@query("u:i i:i r:d fold:s", "SELECT * FROM supp_split")
def split_assign(spark, sf_dir):
    return split(spark, sf_dir, "supp")


@query("fold:s n:i pct:d n_users:i", "SELECT fold, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM supp) AS pct, count(DISTINCT u) AS n_users FROM supp_split GROUP BY 1")
def split_summary(spark, sf_dir):
    rows = split(spark, sf_dir, "supp")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("n_users")).crossJoin(F.broadcast(total)).withColumn("pct", 100 * F.col("n") / F.col("total"))  # one row


@query("i:i cnt:i pos:i cum_share:d grp:s", "SELECT * FROM supp_grp")
def popularity_groups(spark, sf_dir):
    return context(spark, sf_dir, "supp").groups()


@query("grp:s n_items:i n_ratings:i min_cnt:i share:d", "SELECT grp, count(*) AS n_items, sum(cnt) AS n_ratings, min(cnt) AS min_cnt, CAST(sum(cnt) AS DOUBLE) / (SELECT sum(cnt) FROM supp_grp) AS share FROM supp_grp GROUP BY 1")
def long_tail_curve(spark, sf_dir):
    rows = context(spark, sf_dir, "supp").groups()
    total = rows.agg(F.sum("cnt").alias("total"))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n_items"), F.sum("cnt").alias("n_ratings"), F.min("cnt").alias("min_cnt")).crossJoin(F.broadcast(total)).withColumn("share", F.col("n_ratings") / F.col("total"))  # one row


@query("i:i pop_rank:d", "SELECT * FROM supp_rank")
def pop_rank(spark, sf_dir):
    return context(spark, sf_dir, "supp").ranks()


@query("u:i hist:i grp:s", "SELECT * FROM supp_hgrp")
def user_history_groups(spark, sf_dir):
    return context(spark, sf_dir, "supp").histories()


@query("u:i i:i", "SELECT u, i FROM supp_train WHERE r >= 4")
def binarize(spark, sf_dir):
    return context(spark, sf_dir, "supp").train.where("r >= 4").select("u", "i")


@query("side:s id:i mean:d n:i", "SELECT 'user' AS side, u AS id, mean, n FROM supp_um UNION ALL SELECT 'item', i, mean, n FROM supp_im UNION ALL SELECT 'all', 0, mu, (SELECT count(*) FROM supp_train) FROM supp_mu")
def global_user_item_means(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    users = baselines.means(ctx.train, "u", ctx.users).select(F.lit("user").alias("side"), F.col("u").alias("id"), "mean", "n")
    items = baselines.means(ctx.train, "i", ctx.items).select(F.lit("item").alias("side"), F.col("i").alias("id"), "mean", "n")
    return users.unionByName(items).unionByName(ctx.train.agg(F.lit("all").alias("side"), F.lit(0).alias("id"), F.avg("r").alias("mean"), F.count(F.lit(1)).alias("n")))


@query("u:i rank:i i:i score:d", "SELECT * FROM supp_pop")
def popularity_topk(spark, sf_dir):
    return popularity_lists(context(spark, sf_dir, "supp"))


@query("u:i rank:i i:i score:d", "SELECT u, row_number() OVER (PARTITION BY u ORDER BY s DESC, i) AS rank, i, s AS score FROM supp_open JOIN (SELECT i, CAST(count(*) FILTER (r >= 4) AS DOUBLE) AS s FROM supp_items LEFT JOIN supp_train USING (i) GROUP BY 1) USING (i) QUALIFY rank <= 10")
def popularity_positive_topk(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return item_scores_top_k(ctx.users, baselines.popularity_scores(ctx.train, ctx.items, 4.0), 10, ctx.train)


@query("u:i rank:i i:i score:d", "SELECT * FROM evt_randtop")
def random_topk(spark, sf_dir):
    return random_lists(context(spark, sf_dir))


@query("u:i rank:i i:i score:d", "SELECT * FROM supp_imtop")
def item_mean_topk(spark, sf_dir):
    return mean_lists(context(spark, sf_dir, "supp"))


SWEEPS = 20  # of the production bias model


def bias_sql() -> str:
    """Each sweep as two expressions, items from the users' biases before."""
    out = ["e AS MATERIALIZED (SELECT u, i, r - (SELECT mu FROM supp_mu) AS e FROM supp_train)", "u0 AS MATERIALIZED (SELECT DISTINCT u, 0.0::DOUBLE AS b FROM supp_train)"]
    for k in range(1, SWEEPS + 1):
        out.append(f"i{k} AS MATERIALIZED (SELECT i, sum(e - b) / (10 + count(*)) AS b FROM e JOIN u{k - 1} USING (u) GROUP BY 1)")
        out.append(f"u{k} AS MATERIALIZED (SELECT u, sum(e - b) / (10 + count(*)) AS b FROM e JOIN i{k} USING (i) GROUP BY 1)")
    return "WITH " + ",\n".join(out)


@query("side:s id:i b:d", f"{bias_sql()} SELECT 'item' AS side, i AS id, b FROM i{SWEEPS} UNION ALL SELECT 'user', u, b FROM u{SWEEPS}")
def bias_baseline(spark, sf_dir):
    b_i, b_u, _ = baselines.bias_model(context(spark, sf_dir, "supp").train, iterations=SWEEPS, trace_every=0)
    return b_i.select(F.lit("item").alias("side"), F.col("i").alias("id"), F.col("b_i").alias("b")).union(b_u.select(F.lit("user"), "u", "b_u"))


@query("step:i rmse:d", f"{bias_sql()} " + " UNION ALL ".join(f"SELECT {k} AS step, sqrt(avg((e - i{k}.b - u{k}.b) ** 2)) AS rmse FROM e JOIN i{k} USING (i) JOIN u{k} USING (u)" for k in range(1, SWEEPS + 1)))
def bias_trace(spark, sf_dir):
    """The training error after every sweep."""
    _, _, trace = baselines.bias_model(context(spark, sf_dir, "supp").train, iterations=SWEEPS)
    return spark.createDataFrame(list(enumerate(trace, 1)), "step int, rmse double")


@query("n:i rmse:d mae:d", "SELECT count(*) AS n, sqrt(avg((mean - r) ** 2)) AS rmse, avg(abs(mean - r)) AS mae FROM supp_test JOIN supp_im USING (i)")
def rating_errors(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    pred = ctx.test.join(baselines.means(ctx.train, "i", ctx.items), "i").select("u", "i", F.col("mean").alias("pred"))
    return metrics.rating_errors(metrics.clipped(pred, ctx.ratings), ctx.test)


USER = "u:i n_rel:i precision:d recall:d hit_rate:d ndcg:d ap:d"


@query(USER, "SELECT * FROM supp_um10")
def ranking_metrics_per_user(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return metrics.user_metrics(popularity_lists(ctx), metrics.relevant(ctx.test))


LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM supp_um10" for m in ("precision", "recall", "hit_rate", "ndcg", "ap"))


@query("metric:s mean:d median:d std:d n:i", f"SELECT metric, avg(v) AS mean, quantile_cont(v, 0.5) AS median, coalesce(stddev_samp(v), 0) AS std, count(*) AS n FROM ({LONG}) GROUP BY 1")
def ranking_metrics_summary(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return metrics.summary(metrics.user_metrics(popularity_lists(ctx), metrics.relevant(ctx.test)), ["precision", "recall", "hit_rate", "ndcg", "ap"])


@query("users:i hit_rate:d precision:d ndcg:d", "SELECT count(*) AS users, avg(hit_rate) AS hit_rate, avg(precision) AS precision, avg(ndcg) AS ndcg FROM supp_um10")
def popularity_metrics(spark, sf_dir):
    """How good is a list that is the same for all: the flagship."""
    ctx = context(spark, sf_dir, "supp")
    rows = metrics.user_metrics(popularity_lists(ctx), metrics.relevant(ctx.test))
    return rows.agg(F.count(F.lit(1)).alias("users"), *(F.avg(c).alias(c) for c in ("hit_rate", "precision", "ndcg")))


@query("u:i novelty:d", "SELECT u, avg(-log2((cnt + 1.0) / ((SELECT count(DISTINCT u) FROM supp_train) + 1))) AS novelty FROM supp_pop JOIN supp_cnt USING (i) GROUP BY 1")
def novelty(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return metrics.novelty(popularity_lists(ctx), ctx.counts(), ctx.train.select("u").distinct().count())


@query("u:i ild:d", """SELECT l.u, CASE WHEN count(*) > 0 THEN 1 - avg(c) END AS ild FROM (
  SELECT a.u, a.i, b.i AS j, (SELECT count(*) FROM sfeat x JOIN sfeat y USING (feature) WHERE x.i = a.i AND y.i = b.i) / 2.0 AS c FROM supp_pop a JOIN supp_pop b ON a.u = b.u AND a.rank < b.rank) l GROUP BY 1""")
def intra_list_diversity(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return metrics.diversity(popularity_lists(ctx), ctx.features)


@query("u:i head_frac:d medium_frac:d long_tail_frac:d", "SELECT u, avg((grp = 'head')::INT) AS head_frac, avg((grp = 'medium')::INT) AS medium_frac, avg((grp = 'long_tail')::INT) AS long_tail_frac FROM supp_pop JOIN supp_grp USING (i) GROUP BY 1")
def group_exposure(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return metrics.group_share(popularity_lists(ctx), ctx.groups())


@query("u:i pop_rank:d", "SELECT u, avg(pop_rank) AS pop_rank FROM supp_pop JOIN supp_rank USING (i) GROUP BY 1")
def mean_popularity_rank(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return metrics.mean_popularity_rank(popularity_lists(ctx), ctx.ranks())


@query("n_covered:i catalog_coverage:d", "SELECT count(DISTINCT i) AS n_covered, CAST(count(DISTINCT i) AS DOUBLE) / (SELECT count(*) FROM supp_items) AS catalog_coverage FROM supp_pop")
def catalog_coverage(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return metrics.coverage(popularity_lists(ctx), ctx.items.count())


@query("user_coverage:d", "SELECT avg(coalesce(ok, 0)) AS user_coverage FROM supp_users LEFT JOIN (SELECT u, (count(DISTINCT round(score, 12)) > 1)::INT AS ok FROM supp_pop GROUP BY 1) USING (u)")
def user_coverage(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return metrics.user_coverage(popularity_lists(ctx), ctx.users)


@query("gini:d", "SELECT 2 * sum(rn * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*) AS gini FROM (SELECT x, row_number() OVER (ORDER BY x, i) AS rn FROM (SELECT i, count(p.u) AS x FROM supp_items LEFT JOIN supp_pop p USING (i) GROUP BY 1))")
def gini_exposure(spark, sf_dir):
    ctx = context(spark, sf_dir, "supp")
    return groups.gini(groups.item_counts(popularity_lists(ctx), ctx.items))


HIDE = "SELECT u, i, r, p <= least(round_even(n * CAST(0.3 AS DOUBLE), 0), greatest(0, n - 5)) AS hidden FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('24263:', u, ':', i)), i) AS p, count(*) OVER () AS n FROM supp_train WHERE u = 7)"


@query("u:i i:i r:d hidden:b", HIDE.replace("24263", str(42 ^ 0x5EED)))
def target_user_hide(spark, sf_dir):
    return hide_profile(context(spark, sf_dir, "supp").train, 7)
