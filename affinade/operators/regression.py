"""Regression neighbourhoods: per item, ridge weights on its most similar items' deviations.

The design of item i has a row for each user who rated i and a column for each of its k neighbours, with 0 where that user
didn't rate the neighbour. Neighbours are chosen by similarity over all items, so ties and zeros may fill the list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinade.config import CONFIG
from affinade.operators.baselines import bias_model, bias_predict, settle
from affinade.operators.ordered import running
from affinade.operators.pairs import few
from affinade.operators.topk import filled_top_k


def deviations(train: DataFrame, lam: float = 10.0, iterations: int = 20) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """u, i, dev on observed cells; item biases, user biases, the mean."""
    b_i, b_u, _ = bias_model(train, lam, lam, iterations, trace_every=0)
    mu = train.agg(F.avg("r")).first()[0] or 0.0
    rows = train.join(b_i, "i").join(b_u, "u").select("u", "i", (F.col("r") - mu - F.col("b_i") - F.col("b_u")).alias("dev"))
    return settle(rows), b_i, b_u, mu


def neighbours(sim: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """i, nbr, sim, pos: the k most similar other items, similarity descending, then the smaller item; unstored ones count 0.

    Pairs without similarity only matter where an item has fewer than k positive ones. They are filled from the first items of
    the catalogue: k + the number of stored ones are enough, so no item meets the whole catalogue.
    """
    order = Window.partitionBy("i").orderBy(F.desc(F.round("sim", 9)), F.asc("nbr"))
    stored = sim.select(F.col("a").alias("i"), F.col("b").alias("nbr"), "sim")
    best = stored.where("sim > 0").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).drop("pos")
    short = items.select("i").join(best.groupBy("i").agg(F.count(F.lit(1)).alias("n")), "i", "left").where(F.coalesce("n", F.lit(0)) < k).select("i")
    known = short.join(stored.groupBy("i").agg(F.count(F.lit(1)).alias("m")), "i", "left").select("i", (F.coalesce("m", F.lit(0)) + k + 1).alias("most"))
    catalogue = running(items.select("i").distinct(), "i", F.lit(1), "_b").select(F.col("i").alias("nbr"), (F.col("_b") + 1).cast("int").alias("_p"))
    fill = known.select("i", F.explode(F.sequence(F.lit(1), F.col("most").cast("int"))).alias("_p")).join(catalogue, "_p").where("i <> nbr").select("i", "nbr")
    zeros = fill.join(stored.where("sim > 0").select("i", "nbr"), ["i", "nbr"], "left_anti").join(stored.where("sim < 0").select("i", "nbr"), ["i", "nbr"], "left_anti").withColumn("sim", F.lit(0.0))
    negative = stored.where("sim < 0").join(short, "i", "left_semi")
    rows = best.unionByName(zeros).unionByName(negative)
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def design(dev: DataFrame, near: DataFrame) -> DataFrame:
    """i, u, y and the user's deviations at i's neighbours as (pos, dev) pairs: a row a rating, k pairs at most."""
    target = dev.select("i", "u", F.col("dev").alias("y"))
    cells = target.join(near.select("i", "nbr", "pos"), "i").join(dev.select("u", F.col("i").alias("nbr"), "dev"), ["u", "nbr"])
    z = cells.groupBy("i", "u").agg(F.collect_list(F.struct("pos", "dev")).alias("z"))
    return target.join(z, ["i", "u"], "left")


def solve_ridge(rows: DataFrame, k: int, lam: float) -> DataFrame:
    """i, pos, w, fallback: (Z'Z + lam I) w = Z'y; least squares of least norm where that has no inverse.

    Partial sums come first: each of a popular item's parts gives its own Z'Z and Z'y, at most k (k + 1) numbers, so
    no task holds all of an item's raters.
    """

    def partial(batches):
        gram: dict[int, np.ndarray] = {}
        for batch in batches:
            item, z = batch.column("i").to_numpy(), batch.column("z")
            sizes = pc.fill_null(pc.list_value_length(z), 0).to_numpy(zero_copy_only=False)
            cells, rows = z.flatten(), np.zeros((len(item), k + 1))
            rows[np.repeat(np.arange(len(item)), sizes), cells.field("pos").to_numpy() - 1] = cells.field("dev").to_numpy()
            rows[:, k] = batch.column("y").to_numpy()
            order = np.argsort(item, kind="stable")
            rows, item = rows[order], item[order]
            begin = np.flatnonzero(np.diff(item, prepend=item[0] - 1)) if len(item) else []
            for lo, hi in zip(begin, [*begin[1:], len(item)]):  # an item at a time: one product of its rows
                own = rows[lo:hi]
                g = own[:, :k].T @ own
                gram[item[lo]] = gram[item[lo]] + g if item[lo] in gram else g
            if len(gram) > 2000:
                yield flushed(gram)
                gram = {}
        yield flushed(gram)

    def flushed(gram: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(gram), pa.int64()), pa.array([g.ravel() for g in gram.values()], pa.list_(pa.float64()))], ["i", "g"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.sum([np.asarray(x) for x in pdf["g"]], axis=0).reshape(k, k + 1)
        a, b = g[:, :k] + lam * np.eye(k), g[:, k]
        try:
            w, fallback = np.linalg.solve(a, b), False
        except np.linalg.LinAlgError:
            w, fallback = np.linalg.lstsq(a, b, rcond=None)[0], True
        return pd.DataFrame({"i": pdf["i"].iloc[0], "pos": np.arange(1, k + 1, dtype="int32"), "w": w, "fallback": fallback})

    parts = rows.select("i", "y", "z").mapInArrow(partial, "i long, g array<double>")
    return parts.groupBy("i").applyInPandas(solve, "i long, pos int, w double, fallback boolean")


def regression_weights(train: DataFrame, sim: DataFrame, items: DataFrame, k: int = 40, lam: float = 25.0, mode: str = "ridge", lam_bias: float = 10.0, iterations: int = 20) -> tuple[DataFrame, tuple]:
    """(src, dst, w, sim) and what deviations() gave; ``mode='similarity'`` takes sim / sum |sim| for weights."""
    parts = deviations(train, lam_bias, iterations)
    sim = settle(sim)  # read four times
    near = settle(neighbours(sim, items, k))  # read for the design and for the weights
    if mode == "similarity":
        total = F.sum(F.abs("sim")).over(Window.partitionBy("i"))
        w = near.select(F.col("nbr").alias("src"), F.col("i").alias("dst"), F.when(total > 0, F.col("sim") / total).otherwise(0.0).alias("w"), "sim")
    else:
        solved = solve_ridge(design(parts[0], near), k, lam)
        w = near.join(settle(solved), ["i", "pos"]).select(F.col("nbr").alias("src"), F.col("i").alias("dst"), "w", "sim")
    return w, parts


def slopes(dev: DataFrame, near: DataFrame) -> DataFrame:
    """i, nbr, s: over the users who rated both, the sum of the deviation at nbr times what i's weights (near: i, nbr, w) miss of the one at i.

    Few weights are sent to the ratings: a user's deviations are one row, and nothing but sums of pairs of neighbours is shuffled after that.
    """
    near = settle(near)
    if not few(near):
        cells = dev.select("i", "u", F.col("dev").alias("y")).join(near, "i").join(dev.select("u", F.col("i").alias("nbr"), "dev"), ["u", "nbr"])
        fitted = cells.groupBy("i", "u").agg(F.sum(F.col("dev") * F.col("w")).alias("f"))
        return cells.join(fitted, ["i", "u"]).groupBy("i", "nbr").agg(F.sum(F.col("dev") * (F.col("f") - F.col("y"))).alias("s"))
    own = dev.groupBy("u").agg(F.map_from_entries(F.collect_list(F.struct("i", "dev"))).alias("m"))
    of = near.groupBy("i").agg(F.collect_list(F.struct("nbr", "w")).alias("z"))
    rows = own.select("m", F.explode("m").alias("i", "y")).join(F.broadcast(of), "i")
    known = F.filter(F.transform("z", lambda n: F.struct(n.nbr.alias("nbr"), n.w.alias("w"), F.try_element_at("m", n.nbr).alias("dev"))), lambda n: n.dev.isNotNull())
    rows = rows.select("i", "y", known.alias("z"))
    miss = F.aggregate("z", F.lit(0.0), lambda s, n: s + n.dev * n.w) - F.col("y")
    return rows.select("i", miss.alias("e"), F.explode("z").alias("n")).groupBy("i", F.col("n.nbr").alias("nbr")).agg(F.sum(F.col("n.dev") * F.col("e")).alias("s"))


def apply_weights(values: DataFrame, weights: DataFrame, column: str = "x") -> DataFrame:
    """u, i, score: the sum over a user's values of value times weight to i."""
    rows = values.select("u", F.col("i").alias("src"), F.col(column).alias("x")).join(weights.select("src", "dst", "w"), "src")
    return rows.groupBy("u", F.col("dst").alias("i")).agg(F.sum(F.col("x") * F.col("w")).alias("score"))


def rating_lists(moved: DataFrame, b_i: DataFrame, b_u: DataFrame, mu: float, train: DataFrame, users: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Top-N by prediction over every pair: items without a weighted neighbour of the user's are met in order of their bias, as few as can matter."""
    own = bias_predict(moved, b_i, b_u, mu).join(moved, ["u", "i"]).select("u", "i", (F.col("pred") + F.col("score")).alias("score"))
    line = items.select("i").join(b_i, "i", "left").select("i", F.coalesce("b_i", F.lit(0.0)).alias("score"))
    offset = users.select("u").join(b_u, "u", "left").select("u", (F.lit(mu) + F.coalesce("b_u", F.lit(0.0))).alias("c"))
    return filled_top_k(settle(own), users, line, n, train, offset)


def liked(train: DataFrame, liked_from: float = CONFIG.liked_from) -> DataFrame:
    return train.where(F.col("r") >= liked_from).select("u", "i", F.lit(1.0).alias("x"))


def explain(dev: DataFrame, weights: DataFrame, targets: DataFrame, top_n: int = 5) -> DataFrame:
    """Why (u, i): the user's observed deviations at i's weighted neighbours, by the size of their contribution."""
    rows = targets.select("u", F.col("i").alias("dst")).join(weights, "dst").join(dev.select("u", F.col("i").alias("src"), "dev"), ["u", "src"])
    rows = rows.withColumn("contribution", F.col("dev") * F.col("w"))
    order = Window.partitionBy("u", "dst").orderBy(F.desc(F.round(F.abs("contribution"), 9)), F.asc("src"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).select("u", F.col("dst").alias("i"), "rank", F.col("src").alias("nbr"), "w", "sim", "dev", "contribution")
