"""Rating, ranking and beyond-accuracy metrics over long tables; undefined values are null and averages skip them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinade.config import CONFIG
from affinade.functions.columns import clip, discount, self_information


def calibration(x: DataFrame) -> DataFrame:
    """a, b of r = a + b x over (x, r) by least squares; without variance of x, b is 0 and a the mean."""
    sums = x.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("r").alias("mr"), F.covar_pop("x", "r").alias("c"), F.var_pop("x").alias("v"))
    b = F.when(F.col("v") > 1e-12, F.col("c") / F.col("v")).otherwise(0.0)
    return sums.select((F.col("mr") - b * F.col("mx")).alias("a"), b.alias("b"))


def scale(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.min("r").alias("low"), F.max("r").alias("high"))


def clipped(pred: DataFrame, ratings: DataFrame) -> DataFrame:
    """Predictions within the scale of all ratings (one row, so it is broadcast)."""
    rows = pred.crossJoin(F.broadcast(scale(ratings)))
    return rows.withColumn("pred", clip(F.col("pred"), F.col("low"), F.col("high"))).drop("low", "high")


def rating_errors(pred: DataFrame, held: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, rmse, mae over held-out cells with a prediction; null without any. ``by``: a row for each value of these columns of ``pred``."""
    e = F.col("pred") - F.col("r")
    rows = held.select("u", "i", "r").join(pred.select(*by, "u", "i", "pred"), ["u", "i"])
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def relevant(held: DataFrame, at_least: float = CONFIG.relevant_from) -> DataFrame:
    return held.where(F.col("r") >= at_least).select("u", "i")


def user_metrics(lists: DataFrame, truth: DataFrame, k: int = CONFIG.k, by: DataFrame | None = None) -> DataFrame:
    """Per user with a relevant item: n_rel, precision, recall, hit_rate, ndcg, ap. Precision divides by k, however short the list.

    ``by`` (a small table of settings): for each of its rows, whose columns the lists have too.
    """
    keys = [*(by.columns if by is not None else ()), "u"]
    hits = lists.where(F.col("rank") <= k).join(truth.withColumn("rel", F.lit(1)), ["u", "i"]).select(*keys, "rank")
    so_far = F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))
    sums = hits.withColumn("h", so_far).groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), F.sum(discount(F.col("rank"))).alias("dcg"), F.sum(F.col("h") / F.col("rank")).alias("ap"))
    rows = truth.groupBy("u").agg(F.count(F.lit(1)).alias("n_rel"))
    rows = (rows.crossJoin(F.broadcast(by)) if by is not None else rows).join(sums, keys, "left")  # settings, a few rows
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, p: s + discount(p))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        *keys, "n_rel", (zero("hits") / F.lit(float(k))).alias("precision"), (zero("hits") / F.col("n_rel")).alias("recall"), F.when(zero("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        (zero("dcg") / ideal).alias("ndcg"), (zero("ap") / F.least(F.col("n_rel"), F.lit(k))).alias("ap"),
    )


def summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """metric, mean, median, std (0 for one value), n of each column, nulls left out."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns))).alias("m")).select("m.metric", "m.v").where("v is not null")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"))


def novelty(lists: DataFrame, counts: DataFrame, n_users: int, by: tuple[str, ...] = ()) -> DataFrame:
    """u, novelty: mean self-information of the listed items."""
    info = self_information(F.coalesce("cnt", F.lit(0)), F.lit(float(n_users)))
    return lists.join(counts.select("i", "cnt"), "i", "left").groupBy(*by, "u").agg(F.avg(info).alias("novelty"))


def diversity(lists: DataFrame, features: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """u, ild: 1 less the mean cosine of all pairs of a list (null below two items).

    The sum over pairs is (|sum of unit vectors|^2 - sum of their squares) / 2, so no pairs are made. Items
    without features count as orthogonal to all.
    """
    norms = features.groupBy("i").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = features.join(norms, "i").select("i", "feature", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("x"))
    keys = [*by, "u"]
    cells = lists.select(*keys, "i").join(unit, "i").groupBy(*keys, "feature").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    sums = cells.groupBy(*keys).agg(((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / 2).alias("cos"))
    sizes = lists.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return sizes.join(sums, keys, "left").select(*keys, F.when(F.col("n") > 1, 1 - F.coalesce("cos", F.lit(0.0)) / pairs).alias("ild"))


def mean_popularity_rank(lists: DataFrame, ranks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return lists.join(ranks, "i").groupBy(*by, "u").agg(F.avg("pop_rank").alias("pop_rank"))


def group_share(lists: DataFrame, groups: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per user the share of its list in each popularity group."""
    shares = [F.avg((F.col("grp") == g).cast("double")).alias(f"{g}_frac") for g in ("head", "medium", "long_tail")]
    return lists.join(groups.select("i", "grp"), "i").groupBy(*by, "u").agg(*shares)


def coverage(lists: DataFrame, n_items: int, by: tuple[str, ...] = ()) -> DataFrame:
    return lists.groupBy(*by).agg(F.count_distinct("i").alias("n_covered"), (F.count_distinct("i") / F.lit(float(n_items))).alias("catalog_coverage"))


def user_coverage(lists: DataFrame, users: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of users whose list has two or more different scores (after 12 places)."""
    if by:
        ok = lists.groupBy(*by, "u").agg((F.count_distinct(F.round("score", 12)) > 1).cast("double").alias("ok"))
        return ok.groupBy(*by).agg((F.sum("ok") / F.lit(float(max(1, users.select("u").distinct().count())))).alias("user_coverage"))
    own = lists.groupBy("u").agg((F.count_distinct(F.round("score", 12)) > 1).cast("double").alias("ok"))
    return users.select("u").join(own, "u", "left").agg(F.avg(F.coalesce("ok", F.lit(0.0))).alias("user_coverage"))
