"""Analyses over metric tables and top-N lists of several models (a ``model`` column)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinade.config import CONFIG
from affinade.functions.columns import discount


def user_groups(per_user: DataFrame, histories: DataFrame, columns: tuple[str, ...] = ("precision", "recall", "hit_rate", "ndcg", "ap")) -> DataFrame:
    """Mean metrics by history group, with users, mean history and held-out positives."""
    rows = histories.join(per_user, "u", "left")
    return rows.groupBy(F.col("grp").alias("user_group")).agg(F.count(F.lit(1)).alias("n_users"), F.avg("hist").alias("mean_history"), F.avg("n_rel").alias("mean_positives"), F.percentile("n_rel", F.lit(0.5)).alias("median_positives"), *(F.avg(c).alias(c) for c in columns))


def gini_by(lists: DataFrame, items: DataFrame, key: str = "model") -> DataFrame:
    """Gini coefficient of how often each item of the catalogue is listed, by model; items never listed count 0."""
    exposed = lists.groupBy(key, "i").agg(F.count(F.lit(1)).alias("x"))
    levels = exposed.groupBy(key, "x").agg(F.count(F.lit(1)).alias("m"))
    n = items.agg(F.count(F.lit(1)).alias("n"))
    zero = levels.groupBy(key).agg(F.sum("m").alias("some")).crossJoin(F.broadcast(n))  # one row
    levels = zero.select(key, (F.col("n") - F.col("some")).alias("z"), "n").join(levels, key)
    before = F.col("z") + F.coalesce(F.sum("m").over(Window.partitionBy(key).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = levels.withColumn("ranks", F.col("m") * before + F.col("m") * (F.col("m") + 1) / 2)
    g = 2 * F.sum(F.col("x") * F.col("ranks")) / (F.max("n") * F.sum(F.col("x") * F.col("m"))) - (F.max("n") + 1) / F.max("n")
    return rows.groupBy(key).agg(g.alias("gini"))


def popularity_bias(lists: DataFrame, counts: DataFrame, groups: DataFrame, ranks: DataFrame, items: DataFrame) -> DataFrame:
    """Per model over all list slots: mean and median popularity, mean rank, group shares, coverage, Gini."""
    rows = lists.join(counts, "i").join(groups.select("i", "grp"), "i").join(ranks, "i")
    share = [(100 * F.avg((F.col("grp") == g).cast("double"))).alias(f"{g}_pct") for g in ("head", "medium", "long_tail")]
    n = items.agg(F.count(F.lit(1)).alias("n_items"))
    out = rows.groupBy("model").agg(F.avg("cnt").alias("mean_popularity"), F.percentile("cnt", F.lit(0.5)).alias("median_popularity"), F.avg("pop_rank").alias("mean_pop_rank"), *share, F.count_distinct("i").alias("n_distinct"))
    out = out.crossJoin(F.broadcast(n)).withColumn("coverage", F.col("n_distinct") / F.col("n_items")).drop("n_items")  # one row
    return out.join(gini_by(lists, items), "model")


def divisiveness(lists: DataFrame) -> DataFrame:
    """Per listed item: models that list it, their share, best rank, (1 - share) / log2(best rank + 1)."""
    n = lists.agg(F.count_distinct("model").alias("n_all"))
    rows = lists.groupBy("i").agg(F.count_distinct("model").alias("n_models"), F.min("rank").alias("best_rank")).crossJoin(F.broadcast(n))  # one row
    cover = F.col("n_models") / F.col("n_all")
    return rows.select("i", "n_models", cover.alias("coverage"), "best_rank", ((1 - cover) * discount(F.col("best_rank"))).alias("divisiveness"))


def consensus(lists: DataFrame) -> DataFrame:
    return lists.groupBy("i").agg(F.count_distinct("model").alias("n_models"), F.array_join(F.sort_array(F.collect_set("model")), ", ").alias("models"))


def axis_ranks(table: DataFrame, axes: dict[str, bool], key: str = "model") -> DataFrame:
    """Rank (ties share the least) of every model on each axis; True: the highest value is first."""
    everything = Window.orderBy  # a table of models: a few rows
    return table.select(key, *(F.rank().over(everything(F.desc(a) if high else F.asc(a))).cast("long").alias(f"rank_{a}") for a, high in axes.items()))


def dominated(table: DataFrame, goals: list[str], key: str = "model") -> DataFrame:
    """(key, by): who is dominated by whom, with no goal worse and one better (higher is better)."""
    one, two = table.select(key, *goals), table.select(F.col(key).alias("by"), *(F.col(g).alias(f"{g}_") for g in goals))
    no_worse, better = F.lit(True), F.lit(False)
    for g in goals:
        no_worse, better = no_worse & (F.col(f"{g}_") >= F.col(g)), better | (F.col(f"{g}_") > F.col(g))
    return one.join(two, no_worse & better & (F.col(key) != F.col("by"))).select(key, "by")  # models against models


def pareto_front(table: DataFrame, goals: list[str], key: str = "model") -> DataFrame:
    return table.join(dominated(table, goals, key), key, "left_anti").select(key, *goals)


def error_strata(pred: DataFrame, held: DataFrame, groups: DataFrame, histories: DataFrame) -> DataFrame:
    """n, rmse, mae, bias overall and by true rating, item group and user group, in one pass."""
    rows = held.join(pred.select("u", "i", "pred"), ["u", "i"]).join(groups.select("i", F.col("grp").alias("item_group")), "i").join(histories.select("u", F.col("grp").alias("user_group")), "u")
    levels = F.array(*(F.struct(F.lit(s).alias("stratum"), v.alias("level")) for s, v in (("overall", F.lit("all")), ("true_rating", F.col("r").cast("int").cast("string")), ("item_group", F.col("item_group")), ("user_group", F.col("user_group")))))
    e = F.col("pred") - F.col("r")
    return rows.select("r", "pred", F.explode(levels).alias("s")).select("s.stratum", "s.level", "r", "pred").groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def first_hits(lists: DataFrame, truth: DataFrame) -> DataFrame:
    """users_evaluated, users_with_a_hit, hit_rate, mean and median rank of the first hit."""
    first = lists.join(truth, ["u", "i"]).groupBy("u").agg(F.min("rank").alias("first"))
    rows = truth.select("u").distinct().join(first, "u", "left")
    return rows.agg(F.count(F.lit(1)).alias("users_evaluated"), F.count("first").alias("users_with_a_hit"), (F.count("first") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("hit_rate"), F.avg("first").alias("mean_first_hit"), F.percentile("first", F.lit(0.5)).alias("median_first_hit"))


def hardest_items(pred: DataFrame, held: DataFrame, least: int = 10, n: int = 20) -> DataFrame:
    e = F.col("pred") - F.col("r")
    rows = held.join(pred.select("u", "i", "pred"), ["u", "i"]).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")).where(F.col("n") >= least)
    return rows.orderBy(F.desc(F.round("rmse", 9)), F.asc("i")).limit(n)


def polarisation(ratings: DataFrame, least: int = 50, extremes: tuple[float, ...] = (1.0, 2.0, 5.0)) -> DataFrame:
    """Items with ``least`` ratings: variance and share of extreme ratings."""
    return ratings.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.var_samp("r").alias("variance"), F.avg(F.col("r").isin(*extremes).cast("double")).alias("extreme_share")).where(F.col("n") >= least)


def block_deltas(table: DataFrame, block: list[str], metric: str) -> DataFrame:
    """Every row's metric less its block's best, and the block's spread."""
    w = Window.partitionBy(*block)
    return table.withColumn("delta", F.col(metric) - F.max(metric).over(w)).withColumn("spread", F.max(metric).over(w) - F.min(metric).over(w))


def block_summary(table: DataFrame, block: list[str], label: str, metric: str, tol: float = 1e-9) -> DataFrame:
    """Best and worst row of a block, their spread, and whether all tie; equal values go to the smaller label."""
    best = F.min_by(label, F.struct(-F.round(metric, 9), F.col(label)))
    worst = F.min_by(label, F.struct(F.round(metric, 9), F.col(label)))
    return table.groupBy(*block).agg(best.alias("best"), worst.alias("worst"), (F.max(metric) - F.min(metric)).alias("spread"), ((F.max(metric) - F.min(metric)) <= tol).alias("tied"))


def score_percentile(scores: DataFrame, targets: DataFrame, seen: DataFrame, items: DataFrame) -> DataFrame:
    """For each target (u, i): the percentage of the user's unseen items that score strictly lower; items without a score score 0.

    Scores are ranked once a user, and those that nothing stored scores are counted.
    """
    order, side = Window.partitionBy("u").orderBy("s"), Window.partitionBy("u")
    mine = scores.join(targets.select("u").distinct(), "u", "left_semi").join(seen.select("u", "i"), ["u", "i"], "left_anti").select("u", "i", F.round("score", 9).alias("s"))
    placed = mine.withColumns({"below": F.rank().over(order) - 1, "known": F.count(F.lit(1)).over(side)})
    sizes = mine.groupBy("u").agg(F.count(F.lit(1)).alias("n_known"), F.count_if(F.col("s") < 0).alias("n_negative"))
    n_seen, n = seen.groupBy("u").agg(F.count(F.lit(1)).alias("n_seen")), items.agg(F.count(F.lit(1)).alias("n_items"))
    rows = targets.select("u", "i").join(placed.select("u", "i", "s", "below"), ["u", "i"], "left").join(sizes, "u", "left").join(n_seen, "u", "left").crossJoin(F.broadcast(n))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    open_, known = F.col("n_items") - zero("n_seen"), zero("n_known")
    lower = F.when(F.col("s").isNull(), zero("n_negative")).otherwise(F.col("below") + F.when(F.col("s") > 0, open_ - known).otherwise(0))
    return rows.select("u", "i", (100.0 * lower / open_).alias("percentile"))


def correlation(table: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r; null with fewer than three rows or without variance."""
    s = table.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    return s.select("n", F.when((F.col("n") >= 3) & (F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).alias("pearson"))


def wide(lists: DataFrame, k: int = CONFIG.k) -> DataFrame:
    """A row per user and model with its list side by side."""
    return lists.groupBy("u", "model").pivot("rank", list(range(1, k + 1))).agg(F.first("i"))


def similarity_against_weights(weights: DataFrame) -> DataFrame:
    """Over (sim, w): rows, Pearson, share of sign flips (sim over .05, w below 0), share of negative weights."""
    s = weights.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("sim", "w").alias("c"), F.var_pop("sim").alias("vx"), F.var_pop("w").alias("vy"), F.avg(((F.col("sim") > 0.05) & (F.col("w") < 0)).cast("double")).alias("sign_flips"), F.avg((F.col("w") < 0).cast("double")).alias("negative"))
    return s.select("n", F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).alias("pearson"), "sign_flips", "negative")


def findings_by_factor(sweep: DataFrame, factors: list[str]) -> DataFrame:
    """For every value of each factor, and over all (factor null): settings, least RMSE and highest NDCG, and which settings have them.

    One pass of grouping sets; equal values go to the earlier setting (``grid``).
    """
    sets = ", ".join(f"({f})" for f in factors)
    best = "min_by({0}, struct(isnull({1}), {1}, grid))"
    chosen = [f"{best.format(f'struct(grid, {", ".join(factors)})', order)} AS {name}" for name, order in (("by_rmse", "round(rmse, 9)"), ("by_ndcg", "-round(ndcg_mean, 9)"))]
    names = "CASE " + " ".join(f"WHEN grouping({f}) = 0 THEN '{f}'" for f in factors) + " END"
    values = "CASE " + " ".join(f"WHEN grouping({f}) = 0 THEN CAST({f} AS STRING)" for f in factors) + " END"
    query = f"SELECT {names} AS factor, {values} AS level, count(*) AS n, min(rmse) AS best_rmse, max(ndcg_mean) AS best_ndcg, {', '.join(chosen)} FROM {{sweep}} GROUP BY GROUPING SETS ({sets}, ())"
    rows = sweep.sparkSession.sql(query, sweep=sweep)
    return rows.select("factor", "level", "n", "best_rmse", "best_ndcg", F.col("by_rmse.grid").alias("rmse_grid"), F.col("by_ndcg.grid").alias("ndcg_grid"))


def ablation_summary(rows: DataFrame, tol: float = 1e-9) -> DataFrame:
    """A row for each family and factor: variants, best and worst by NDCG (null where all tie) and by RMSE, spreads, which metric tells them apart, and the place by spread."""
    pick = lambda metric, sign: F.min_by("variant", F.struct(F.col(metric).isNull(), sign * F.round(metric, 9), "place"))
    one = rows.groupBy("family", "factor").agg(
        F.count(F.lit(1)).alias("n_variants"), pick("ndcg_mean", -1).alias("best"), pick("ndcg_mean", 1).alias("worst"), (F.max("ndcg_mean") - F.min("ndcg_mean")).alias("ndcg_spread"),
        pick("rmse", 1).alias("best_rmse"), pick("rmse", -1).alias("worst_rmse"), (F.max("rmse") - F.min("rmse")).alias("rmse_spread"),
    )
    tied = F.col("ndcg_spread") <= tol
    told = F.when(tied & (F.col("rmse_spread") <= tol), "none").when(tied, "rmse").otherwise("ndcg")
    order = Window.orderBy(F.desc(F.round("ndcg_spread", 9)), F.asc("family"), F.asc("factor"))  # a few blocks
    clear = {c: F.when(~tied, F.col(c)) for c in ("best", "worst")}
    return one.withColumns({**clear, "told_by": told, "position": F.row_number().over(order)})


BLOCKS: dict[str, list[tuple[str, str]]] = {  # factors of each family, and how the settings that stay are chosen
    "ubcf": [("similarity", "mean_center and k = {k}"), ("mean_center", "similarity = 'cosine' and k = {k}"), ("k", "similarity = 'cosine' and mean_center"), ("rank_mode", "true")],
    "ibcf": [("similarity", "mean_center and center_by = 'item' and k = {k}"), ("mean_center", "similarity = 'cosine' and center_by = 'item' and k = {k}"), ("center_by", "similarity = 'adjusted_cosine' and mean_center and k = {k}"), ("k", "similarity = 'cosine' and mean_center and center_by = 'item'")],
    "regression": [("lam", "weight_mode = 'ridge' and k = {k}"), ("weight_mode", "k = {k}"), ("k", "weight_mode = 'ridge'")],
    "slim": [("l1", "l2 = 50 and tau = 4 and top_m is null"), ("l2", "l1 = 2 and tau = 4 and top_m is null"), ("l1_ratio", "round(l1 + l2, 3) = 50 and tau = 4 and top_m is null"), ("tau", "l1 = {l1} and l2 = {l2} and top_m is null"), ("top_m", "l1 = {l1} and l2 = {l2} and tau = 4")],
    "graph": [("alpha", "mode = 'walk'"), ("length", "mode = 'path' and normalize = 'degree' and beta = {beta}"), ("beta", "mode = 'path' and normalize = 'degree' and length = {deepest}"), ("normalize", "mode = 'path'")],
}


def ablations(family: str, sweep: DataFrame) -> DataFrame:
    """family, factor, variant, place, rmse, ndcg_mean and their differences to the block's best, from a family's sweep (its settings as columns).

    A block changes one factor and keeps what its condition says; of the settings left of a variant the best by NDCG counts (regression: by RMSE for k). {k} is
    the k of the best row by NDCG (regression: by RMSE), {beta} the best one's beta among normalised paths, {deepest} the greatest length, {l1} and {l2} the best penalties.
    """
    by = "rmse" if family == "regression" else "ndcg_mean"
    if family == "slim":
        sweep = sweep.withColumn("l1_ratio", F.round(F.col("l1") / (F.col("l1") + F.col("l2")), 4))
    order = lambda c: [F.asc_nulls_last(F.round(c, 9)) if c == "rmse" else F.desc_nulls_last(F.round(c, 9)), F.asc("grid")]
    fixed: dict[str, object] = {}
    if "k" in sweep.columns:
        fixed["k"] = sweep.where("weight_mode = 'ridge'" if family == "regression" else "true").orderBy(*order(by)).first()["k"]
    if family == "graph":
        paths = sweep.where("mode = 'path' and normalize = 'degree'")
        top = paths.orderBy(*order("ndcg_mean")).first()
        fixed |= {"beta": top["beta"] if top else 0.0, "deepest": paths.agg(F.max("length")).first()[0] or 0}
    if family == "slim":
        best = sweep.where("tau = 4 and top_m is null").orderBy(*order("ndcg_mean")).first()
        fixed |= {"l1": best["l1"], "l2": best["l2"]} if best else {"l1": 0.0, "l2": 0.0}
    parts = []
    for factor, kept in BLOCKS[family]:
        rows = sweep.where(kept.format(**fixed)).where(F.col(factor).isNotNull() | F.lit(factor == "top_m"))
        metric = "rmse" if family == "regression" and factor == "k" else "ndcg_mean"
        best = Window.partitionBy(factor).orderBy(*order(metric))
        rows = rows.withColumn("_n", F.row_number().over(best)).where("_n = 1")
        variant = F.coalesce(F.col(factor).cast("string"), F.lit("all"))
        place = F.row_number().over(Window.orderBy(F.asc_nulls_last(factor)))  # a factor's values
        parts.append(rows.select(F.lit(family).alias("family"), F.lit(factor).alias("factor"), variant.alias("variant"), place.alias("place"), "rmse", "ndcg_mean"))
    rows, block = reduce(DataFrame.unionByName, parts), Window.partitionBy("family", "factor")
    return rows.withColumns({"delta_ndcg": F.col("ndcg_mean") - F.max("ndcg_mean").over(block), "delta_rmse": F.col("rmse") - F.min("rmse").over(block)})


def ols_against_ridge(sweep: DataFrame) -> DataFrame:
    """Of a regression sweep, for each k: the least RMSE without a penalty, the least with one and its penalty, and the gain."""
    rows = sweep.where("weight_mode = 'ridge'")
    best = F.min_by("lam", F.when(F.col("lam") > 0, F.struct(F.round("rmse", 9), "lam")))
    one = rows.groupBy("k").agg(F.min(F.when(F.col("lam") == 0, F.col("rmse"))).alias("ols"), F.min(F.when(F.col("lam") > 0, F.col("rmse"))).alias("ridge"), best.alias("lam"))
    return one.withColumn("gain", F.col("ols") - F.col("ridge"))
