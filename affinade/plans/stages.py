"""Batch stages, each from Parquet to Parquet: split, baselines, sweeps, test, analyses.

    python -m affinade.plans.stages --data DIR --out DIR [--grid full|small] [--only NAME ...] [--from NAME] [--list]
"""

from __future__ import annotations

import argparse
import json
import sys
import traceback
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinade.operators.groups import overview, rating_distribution, sparsity
from affinade.operators.metrics import relevant, user_metrics
from affinade.operators.split import assign_folds
from affinade.plans import analysis
from affinade.plans.evaluate import SETTINGS, Context, evaluate_lists, list_metrics, measured, select_best, sweep, with_settings
from affinade.plans.registry import settings_of
from affinade.sources.ratings import event_ratings
from affinade.sources.tables import load_table, save_table

Stage = Callable[[SparkSession, str, str], None]
BASELINES = [{"family": f} for f in ("random", "global_mean", "user_mean", "item_mean", "bias", "popularity", "popularity_positive")]
# The surveyed settings of the sweeps.
K_GRID = (5, 10, 20, 30, 50, 80, 120, 200, 300)
RANK_MODES = ("rating", "score", "affinity")
CENTRING = (("cosine", True, "item"), ("cosine", False, "item"), ("pearson", True, "item"), ("pearson", False, "item"), ("adjusted_cosine", True, "item"), ("adjusted_cosine", True, "user"))
RIDGE_K, RIDGE_LAMBDAS = (10, 20, 40, 80), (0.0, 1.0, 5.0, 25.0, 100.0, 300.0, 1000.0, 3000.0)
L1, L2, MIXES = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0), (0.0, 1.0, 10.0, 200.0, 1000.0), (0.02, 0.05, 0.2, 0.5, 0.8, 0.98)
LIKED_FROM, TOP_M = (1.0, 2.0, 3.0, 4.0, 5.0), (25, 50, 100, 200, 400, None)
ALPHAS, BETAS, LENGTHS = (0.05, 0.10, 0.15, 0.25, 0.40, 0.60, 0.80, 0.95), (0.2, 0.4, 0.6, 0.8), (1, 3, 5, 7, 9)
MIXED = 50.0  # l1 + l2 of the mixed settings


def slim_grid(l1: float = 5.0, l2: float = 50.0) -> list[dict]:
    """Both penalties, their mixes, and at (``l1``, ``l2``) the threshold of a like and the mask."""
    penalties = [(a, 50.0) for a in L1] + [(2.0, b) for b in L2] + [(round(m * MIXED, 4), round((1 - m) * MIXED, 4)) for m in MIXES]
    specs = [{"family": "slim", "l1": a, "l2": b} for a, b in penalties]
    return specs + [{"family": "slim", "l1": l1, "l2": l2, "tau": t} for t in LIKED_FROM] + [{"family": "slim", "l1": l1, "l2": l2, "top_m": m} for m in TOP_M]


GRIDS: dict[str, list[dict]] = {
    "ubcf": [{"family": "ubcf", "k": k, "similarity": s, "mean_center": c, "rank_mode": m} for s in ("cosine", "pearson") for c in (True, False) for k in K_GRID for m in RANK_MODES],
    "ibcf": [{"family": "ibcf", "k": k, "similarity": s, "mean_center": c, "center_by": by, "rank_mode": m} for s, c, by in CENTRING for k in K_GRID for m in RANK_MODES],
    "regression": [{"family": "regression", "k": k, "rank_mode": m, **w} for k in RIDGE_K for w in [*({"lam": lam} for lam in RIDGE_LAMBDAS), {"weight_mode": "similarity"}] for m in RANK_MODES],
    "slim": slim_grid(),
    "graph": [{"family": "graph", "mode": "walk", "alpha": a} for a in ALPHAS]
    + [{"family": "graph", "length": n, "beta": b, "normalize": how} for how in ("degree", "none") for b in BETAS for n in LENGTHS],
}
SMALL = {  # the same sweeps for a first look, and for tests
    "ubcf": [s for s in GRIDS["ubcf"] if s["k"] in (20, 50) and s["mean_center"] and s["rank_mode"] == "score"],
    "ibcf": [s for s in GRIDS["ibcf"] if s["k"] in (10, 20) and s["similarity"] != "pearson" and s["center_by"] == "item" and s["mean_center"] and s["rank_mode"] == "rating"],
    "regression": [s for s in GRIDS["regression"] if s["k"] in (10, 20) and s.get("lam") in (25.0, 100.0) and s["rank_mode"] == "rating"],
    "slim": [s for s in GRIDS["slim"] if s["l2"] == 50.0 and s["l1"] in (0.5, 5.0) and len(s) == 3],
    "graph": [{"family": "graph", "length": length} for length in (1, 3)],
}


def context(spark: SparkSession, out: str) -> Context:
    return Context.of(load_table(spark, f"{out}/split"))


def split_stage(spark: SparkSession, data: str, out: str) -> None:
    save_table(assign_folds(event_ratings(spark, data)), f"{out}/split", ("fold",))


def eda_stage(spark: SparkSession, data: str, out: str) -> None:
    ratings = context(spark, out).ratings
    for name, f in (("rating_distribution", rating_distribution), ("sparsity", sparsity), ("overview", overview)):
        save_table(f(ratings), f"{out}/{name}")


def sweep_stage(grid: dict[str, list[dict]], name: str) -> Stage:
    """All specs on the validation rows; the best of them by NDCG and by RMSE."""

    def run(spark: SparkSession, data: str, out: str) -> None:
        ctx = context(spark, out)
        path, specs = f"{out}/{name}_sweep", grid[name]
        if name == "slim" and specs == GRIDS["slim"]:  # thresholds and masks at the penalties that are best without them
            penalties = [s for s in specs if len(s) == 3]
            best = json.loads(select_best(sweep(ctx, penalties, ctx.val, path=path), "ndcg_mean").first()["spec"])
            specs = slim_grid(best["l1"], best["l2"])
        table = sweep(ctx, specs, ctx.val, path=path)  # rows that an earlier run has left there are taken
        save_table(table, f"{out}/{name}_table")
        table = load_table(spark, f"{out}/{name}_table")
        save_table(select_best(table, "ndcg_mean"), f"{out}/{name}_best")
        save_table(select_best(table, "rmse", highest=False), f"{out}/{name}_best_rating")

    return run


def selected(spark: SparkSession, grid: dict[str, list[dict]], out: str) -> dict[str, dict]:
    """Model name to spec: each family's best by NDCG, where another one is best by RMSE that as ``<family>-rating``, the baselines."""
    found = {}
    for name in grid:
        best, rating = (load_table(spark, f"{out}/{name}_{kind}").first() for kind in ("best", "best_rating"))
        found[name] = json.loads(best["spec"])
        if rating["spec_id"] != best["spec_id"]:
            found[f"{name}-rating"] = json.loads(rating["spec"])
    return found | {s["family"]: s for s in BASELINES}


def test_stage(grid: dict[str, list[dict]]) -> Stage:
    """The selected models and the baselines, on the test rows once, with their lists, predictions, per-user metrics and tables."""

    def run(spark: SparkSession, data: str, out: str) -> None:
        ctx, rows, took = context(spark, out), [], []
        for name, spec in selected(spark, grid, out).items():
            label = F.lit(name).alias("model")
            m = measured(ctx, spec, ctx.test, {"tables": f"{out}/models/{name}", "pred": f"{out}/predictions/model={name}", "lists": f"{out}/lists/model={name}"})
            save_table(list_metrics(ctx, m.lists, relevant(ctx.test)), f"{out}/per_user/model={name}")
            rows.append(evaluate_lists(ctx, m.lists, m.pred, ctx.test).withColumns({"model": F.lit(name), "spec": F.lit(json.dumps(settings_of(spec), sort_keys=True))}))
            took.append(m.resources.select(label, F.lit(spec["family"]).alias("family"), "*"))
        for name, parts in (("test", rows), ("resources", took)):
            save_table(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), f"{out}/{name}")

    return run


def resource_stage(grid: dict[str, list[dict]]) -> Stage:
    """Seconds and sizes of the selected models, which the test stage has measured as it made them, the costliest first."""

    def run(spark: SparkSession, data: str, out: str) -> None:
        table = load_table(spark, f"{out}/resources")
        save_table(table.withColumn("total_s", F.col("fit_s") + F.col("predict_s") + F.col("rank_s")).orderBy(F.desc("total_s"), "model"), f"{out}/resource_summary")

    return run


def ablation_stage(grid: dict[str, list[dict]]) -> Stage:
    """One-factor blocks of every family's sweep, and what each factor moves."""

    def run(spark: SparkSession, data: str, out: str) -> None:
        parts = [analysis.ablations(name, with_settings(load_table(spark, f"{out}/{name}_table"), SETTINGS[name])) for name in grid if name in analysis.BLOCKS]
        if parts:
            save_table(reduce(DataFrame.unionByName, parts), f"{out}/ablations")
            save_table(analysis.ablation_summary(load_table(spark, f"{out}/ablations")), f"{out}/ablation_summary")

    return run


def analysis_stage(spark: SparkSession, data: str, out: str) -> None:
    ctx, lists, table = context(spark, out), load_table(spark, f"{out}/lists"), load_table(spark, f"{out}/test")
    goals = ["ndcg_mean", "catalog_coverage", "novelty_mean"]
    parts: dict[str, DataFrame] = {
        "popularity_bias": analysis.popularity_bias(lists, ctx.counts(), ctx.groups(), ctx.ranks(), ctx.items),
        "pareto": analysis.pareto_front(table, goals),
        "axis_ranks": analysis.axis_ranks(table, {"rmse": False, "ndcg_mean": True, "catalog_coverage": True}),
        "user_groups": analysis.user_groups(user_metrics(lists.where("model = 'slim'"), relevant(ctx.test)), ctx.histories()),
    }
    for name, df in parts.items():
        save_table(df, f"{out}/{name}")


def stages(grid: dict[str, list[dict]]) -> dict[str, Stage]:
    sweeps = {name: sweep_stage(grid, name) for name in grid}
    return {"split": split_stage, "eda": eda_stage, "baselines": sweep_stage({"baselines": BASELINES}, "baselines"), **sweeps, "test": test_stage(grid), "resources": resource_stage(grid), "ablations": ablation_stage(grid), "analysis": analysis_stage}


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data")
    p.add_argument("--out")
    p.add_argument("--only", nargs="*")
    p.add_argument("--from", dest="first")
    p.add_argument("--list", action="store_true")
    p.add_argument("--grid", choices=("full", "small"), default="full")
    a = p.parse_args(args)
    todo = stages(GRIDS if a.grid == "full" else SMALL)
    names = list(todo)
    unknown = [n for n in [*(a.only or ()), *([a.first] if a.first else ())] if n not in todo]
    if unknown:
        p.error(f"unknown stage {', '.join(unknown)}; known: {', '.join(names)}")
    if a.list:
        print("\n".join(names))
        return 0
    chosen = a.only or names[names.index(a.first) if a.first else 0 :]
    spark, failed = SparkSession.builder.getOrCreate(), []
    for name in chosen:
        try:
            todo[name](spark, a.data, a.out)
        except Exception:
            traceback.print_exc()
            failed.append(name)  # later stages may not need it
        spark.catalog.clearCache()
    print(f"failed: {', '.join(failed)}" if failed else "all stages done")
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
