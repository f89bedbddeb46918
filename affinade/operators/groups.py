"""Popularity and history groups, and catalogue statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinade.config import CONFIG
from affinade.operators.baselines import settle


def item_counts(train: DataFrame, items: DataFrame) -> DataFrame:
    """i, cnt for every item of the catalogue, 0 where none rated it."""
    counts = train.groupBy("i").agg(F.count(F.lit(1)).alias("cnt"))
    return items.select("i").join(counts, "i", "left").select("i", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def ordered_counts(counts: DataFrame) -> DataFrame:
    """With ``pos`` (from 1, by count descending, then item) and ``before`` (the counts of all earlier items).

    Only the distinct counts, far fewer than items, meet in one window; places within a count are ranked apart.
    """
    levels = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("cnt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum(F.col("n") * F.col("cnt")).over(earlier), F.lit(0)).alias("m0"))
    within = F.row_number().over(Window.partitionBy("cnt").orderBy("i"))
    rows = counts.withColumn("_w", within).join(levels, "cnt")
    return rows.select("i", "cnt", (F.col("n0") + F.col("_w")).alias("pos"), (F.col("m0") + (F.col("_w") - 1) * F.col("cnt")).alias("before"))


def popularity_groups(counts: DataFrame, head: float = CONFIG.head_mass, medium: float = CONFIG.medium_mass) -> DataFrame:
    """i, cnt, pos, cum_share, grp: an item belongs where the share of all counts before it lies."""
    total = counts.agg(F.sum("cnt").alias("total"))
    rows = ordered_counts(counts).crossJoin(F.broadcast(total))  # one row
    mass = F.greatest(F.col("total"), F.lit(1))
    share = F.col("before") / mass
    grp = F.when(share < head, "head").when(share < medium, "medium").otherwise("long_tail")
    return rows.select("i", "cnt", "pos", ((F.col("before") + F.col("cnt")) / mass).alias("cum_share"), grp.alias("grp"))


def popularity_rank(counts: DataFrame) -> DataFrame:
    """i, pop_rank: place among all items from 0 (most popular) to 1."""
    n = counts.agg(F.count(F.lit(1)).alias("n"))
    rows = ordered_counts(counts).crossJoin(F.broadcast(n))  # one row
    return rows.select("i", ((F.col("pos") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).alias("pop_rank"))


def history_groups(train: DataFrame) -> DataFrame:
    """u, hist, grp by tertiles of the history length, ties going down."""
    hist = train.groupBy("u").agg(F.count(F.lit(1)).alias("hist"))
    cuts = hist.agg(F.percentile("hist", F.lit(1 / 3)).alias("q1"), F.percentile("hist", F.lit(2 / 3)).alias("q2"))
    grp = F.when(F.col("hist") <= F.col("q1"), "sparse").when(F.col("hist") <= F.col("q2"), "medium").otherwise("heavy")
    return hist.crossJoin(F.broadcast(cuts)).select("u", "hist", grp.alias("grp"))  # one row of cuts


def rating_distribution(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy(F.col("r").alias("rating")).agg(F.count(F.lit(1)).alias("n"))


def sparsity(ratings: DataFrame) -> DataFrame:
    sizes = ratings.agg(F.count_distinct("u").alias("n_users"), F.count_distinct("i").alias("n_items"), F.count(F.lit(1)).alias("nnz"))
    cells = F.col("n_users") * F.col("n_items")
    return sizes.select("n_users", "n_items", "nnz", cells.alias("cells"), (100 * F.col("nnz") / F.greatest(cells, F.lit(1))).alias("density_pct"), (100 - 100 * F.col("nnz") / F.greatest(cells, F.lit(1))).alias("sparsity_pct"))


def overview(ratings: DataFrame) -> DataFrame:
    return ratings.agg(
        F.count(F.lit(1)).alias("n"), F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.count_distinct("r").alias("n_values"),
        F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("std_r"), F.percentile("r", F.lit(0.5)).alias("median_r"),
    )


def gini(counts: DataFrame, value: str = "cnt") -> DataFrame:
    """Gini coefficient of a column over all rows, zeros included; values may repeat, so ranks are counted by level."""
    levels = counts.groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = levels.withColumn("b", before)
    ranks = F.col("m") * F.col("b") + F.col("m") * (F.col("m") + 1) / 2
    sums = rows.agg(F.sum(F.col("x") * ranks).alias("weighted"), F.sum(F.col("x") * F.col("m")).alias("total"), F.sum("m").alias("n"))
    g = 2 * F.col("weighted") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")
    return sums.select(F.when(F.col("total") > 0, g).otherwise(0.0).alias("gini"))


def dense_core(ratings: DataFrame, n_users: int, n_items: int) -> DataFrame:
    """user_rank, item_rank, u, i, r: the cells of the most active users and the most rated items (ties: the smaller number first)."""

    def first(key: str, n: int, name: str) -> DataFrame:
        best = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(n)
        return best.select(key, F.row_number().over(Window.orderBy(F.desc("n"), F.asc(key))).alias(name))  # n rows

    both = ratings.join(F.broadcast(first("u", n_users, "user_rank")), "u").join(F.broadcast(first("i", n_items, "item_rank")), "i")  # bounded by parameters
    return both.select("user_rank", "item_rank", "u", "i", "r")


def peeled(ratings: DataFrame, least_user: int, least_item: int, rounds: int = 100) -> DataFrame:
    """u, i, r where users and items with fewer ratings than the least are taken away, until none is left to take or ``rounds`` are over.

    Each round counts what the last one left; rows are only dropped, so few rounds change anything.
    """
    rows, n = ratings, None
    for _ in range(rounds):
        users = rows.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_user).select("u")
        items = rows.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_item).select("i")
        rows = settle(rows.join(users, "u", "left_semi").join(items, "i", "left_semi"))
        left = rows.count()
        if left == n:
            break
        n = left
    return rows.select("u", "i", "r")


def hexagonal_bins(rows: DataFrame, x: Column, y: Column, width: float, height: float) -> DataFrame:
    """col, row (in units of width and height; every other line is half a unit off), n: points by the nearer centre of two lattices."""
    at = rows.select((x / width).alias("x"), (y / height).alias("y"))
    at = at.select("x", "y", F.floor(F.col("x") + 0.5).alias("c0"), F.floor(F.col("y") + 0.5).alias("r0"), (F.floor("x") + 0.5).alias("c1"), (F.floor("y") + 0.5).alias("r1"))
    far = lambda c, r: F.pow(F.col("x") - F.col(c), F.lit(2)) + 3 * F.pow(F.col("y") - F.col(r), F.lit(2))
    near = far("c0", "r0") < far("c1", "r1")
    cell = lambda a, b: F.when(near, F.col(a).cast("double")).otherwise(F.col(b))
    return at.select(cell("c0", "c1").alias("col"), cell("r0", "r1").alias("row")).groupBy("col", "row").agg(F.count(F.lit(1)).alias("n"))
