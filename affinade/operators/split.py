"""Splits per user in an order that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinade.config import CONFIG
from affinade.functions.columns import hashed_order


def assign_folds(ratings: DataFrame, seed: int = CONFIG.seed, test: float = CONFIG.test_frac, val: float = CONFIG.val_frac) -> DataFrame:
    """``fold``: of a user's n rows in hashed order the first floor(test n) are test, the next floor(val n) val; one stays train."""
    by_user = Window.partitionBy("u")
    place = F.row_number().over(by_user.orderBy(hashed_order(seed, F.col("u"), F.col("i")), "i"))
    rows = ratings.withColumn("_p", place).withColumn("_n", F.count(F.lit(1)).over(by_user))
    n_test = F.least(F.floor(F.col("_n") * test), F.col("_n") - 1)
    n_val = F.least(F.floor(F.col("_n") * val), F.col("_n") - n_test - 1)
    fold = F.when(F.col("_p") <= n_test, "test").when(F.col("_p") <= n_test + n_val, "val").otherwise("train")
    return rows.withColumn("fold", fold).drop("_p", "_n")


def fold(split: DataFrame, name: str) -> DataFrame:
    return split.where(F.col("fold") == name).drop("fold")


def hide_profile(train: DataFrame, user: int, seed: int = CONFIG.seed, frac: float = CONFIG.hide_frac, keep: int = CONFIG.hide_keep) -> DataFrame:
    """One user's training rows with ``hidden``: half-even rounded frac of them in hashed order, at least ``keep`` stay."""
    rows = train.where(F.col("u") == user)
    everything = Window.partitionBy("u")
    place = F.row_number().over(everything.orderBy(hashed_order(seed ^ 0x5EED, F.col("u"), F.col("i")), "i"))
    n = F.count(F.lit(1)).over(everything)
    n_hide = F.least(F.bround(n * F.lit(frac), 0), F.greatest(F.lit(0), n - keep))
    return rows.withColumn("_p", place).withColumn("_h", n_hide).withColumn("hidden", F.col("_p") <= F.col("_h")).drop("_p", "_h")


def profile_without(train: DataFrame, hidden: DataFrame) -> DataFrame:
    """All training rows but the hidden ones."""
    return train.join(hidden.select("u", "i"), ["u", "i"], "left_anti")
