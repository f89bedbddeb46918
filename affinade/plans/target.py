"""One user's experiment: hide part of the profile, refit, and hold the lists against what was hidden."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinade.config import CONFIG
from affinade.operators import metrics
from affinade.operators.split import hide_profile, profile_without
from affinade.plans.evaluate import Context
from affinade.plans.refit import BY_DIFFERENCE, Refit, profile
from affinade.plans.registry import fit


def truth_of(ctx: Context, user: int) -> tuple[DataFrame, DataFrame]:
    """The hidden rows, and all that counts as truth: these and the user's test rows."""
    hidden = hide_profile(ctx.train, user).where("hidden").select("u", "i", "r")
    return hidden, hidden.unionByName(ctx.test.where(F.col("u") == user))


def lists_of(ctx: Context, user: int, specs: dict[str, dict], k: int = CONFIG.k) -> DataFrame:
    """model, rank, i, score, cnt, grp, held_r, is_hit of every model, refitted without the hidden rows.

    Popularity and groups stay those of the full training rows.
    """
    hidden, truth = truth_of(ctx, user)
    less = replace(ctx, train=profile_without(ctx.train, hidden).persist())
    out = None
    for name, spec in specs.items():
        own = fit(spec, less.data()).lists(replace(less, users=less.users.where(F.col("u") == user)).data(), k).where(F.col("u") == user).withColumn("model", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return detailed(ctx, truth, out)


def lists_by_difference(ctx: Context, user: int, specs: dict[str, dict], k: int = CONFIG.k, refit: Refit | None = None) -> DataFrame:
    """lists_of() without a refit of what the hidden rows don't touch (see Refit); families that every row touches are fitted as there."""
    refit = refit or Refit(ctx)
    own = profile(ctx.train, user)
    parts = [refit.lists(own, spec, k).withColumn("model", F.lit(name)) for name, spec in specs.items() if by_difference(spec)]
    rest = {name: spec for name, spec in specs.items() if not by_difference(spec)}
    out = detailed(ctx, truth_of(ctx, user)[1], reduce(DataFrame.unionByName, parts)) if parts else None
    if rest:
        more = lists_of(ctx, user, rest, k)
        out = more if out is None else out.unionByName(more)
    return out


def by_difference(spec: dict) -> bool:
    return spec["family"] in BY_DIFFERENCE and not (spec["family"] == "graph" and (spec.get("mode") == "walk" or spec.get("length", 3) > 3))


def detailed(ctx: Context, truth: DataFrame, out: DataFrame) -> DataFrame:
    rows = out.join(ctx.groups().select("i", "cnt", "grp"), "i").join(truth.select("i", F.col("r").alias("held_r")), "i", "left")
    return rows.select("model", "rank", "i", "score", "cnt", "grp", "held_r", F.coalesce(F.col("held_r") >= CONFIG.relevant_from, F.lit(False)).alias("is_hit"))


def metrics_of(ctx: Context, user: int, lists: DataFrame, k: int = CONFIG.k) -> DataFrame:
    """Per model: hits, precision, recall, and the highest recall that k places allow."""
    _, truth = truth_of(ctx, user)
    n = metrics.relevant(truth).agg(F.count(F.lit(1)).alias("n_rel"))
    rows = lists.groupBy("model").agg(F.count_if("is_hit").alias("hits")).crossJoin(F.broadcast(n))  # one row
    return rows.select("model", "hits", "n_rel", (F.col("hits") / F.lit(float(k))).alias("precision"), (F.col("hits") / F.expr("nullif(n_rel, 0)")).alias("recall"), F.least(F.lit(1.0), F.lit(float(k)) / F.expr("nullif(n_rel, 0)")).alias("recall_ceiling"))
