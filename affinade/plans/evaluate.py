"""Evaluation of one model: rating errors over held-out cells, ranking metrics over top-N lists."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from affinade.config import CONFIG
from affinade.operators import metrics, neighbourhood, similarity, wide
from affinade.operators.baselines import settle
from affinade.operators.groups import history_groups, item_counts, popularity_groups, popularity_rank
from affinade.plans.registry import Data, Fitted, fit, settings_of
from affinade.sources.tables import append_table, exists, load_table, save_table, spec_id

PER_USER = ["precision", "recall", "hit_rate", "ndcg", "ap", "novelty", "ild", "pop_rank", "head_frac", "medium_frac", "long_tail_frac"]


@dataclass
class Context:
    """What all models share. Exclusion is by training rows only: validation and test items stay candidates."""

    ratings: DataFrame
    train: DataFrame
    val: DataFrame
    test: DataFrame
    users: DataFrame
    items: DataFrame
    features: DataFrame | None = None

    @classmethod
    def of(cls, split: DataFrame, items: DataFrame | None = None, features: DataFrame | None = None) -> Context:
        part = lambda name: split.where(F.col("fold") == name).drop("fold")
        return cls(split.drop("fold"), part("train"), part("val"), part("test"), split.select("u").distinct(), items if items is not None else split.select("i").distinct(), features)

    def counts(self) -> DataFrame:
        return item_counts(self.train, self.items)

    def groups(self) -> DataFrame:
        return popularity_groups(self.counts())

    def ranks(self) -> DataFrame:
        return popularity_rank(self.counts())

    def histories(self) -> DataFrame:
        return history_groups(self.train)

    def data(self, held: DataFrame | None = None) -> Data:
        """What a model gets; with ``held`` it predicts ratings for these cells only."""
        return Data(self.train, self.users, self.items, self.val, held=held)


def list_metrics(ctx: Context, lists: DataFrame, truth: DataFrame, k: int = CONFIG.k, by: DataFrame | None = None) -> DataFrame:
    """Per user: accuracy where something is relevant (else null), and what doesn't need a truth for every listed user; ``by`` as of user_metrics()."""
    n_users = ctx.train.select("u").distinct().count()
    on = tuple(by.columns) if by is not None else ()
    parts = [metrics.user_metrics(lists, truth, k, by), metrics.novelty(lists, ctx.counts(), n_users, on), metrics.mean_popularity_rank(lists, ctx.ranks(), on), metrics.group_share(lists, ctx.groups(), on)]
    if ctx.features is not None:
        parts.append(metrics.diversity(lists, ctx.features, on))
    rows = reduce(lambda a, b: a.join(b, [*on, "u"], "full"), parts)
    return rows if ctx.features is not None else rows.withColumn("ild", F.lit(None).cast("double"))


def evaluate(ctx: Context, fitted: Fitted, held: DataFrame, k: int = CONFIG.k) -> DataFrame:
    """One row: rmse, mae, coverage, user coverage, and mean, median, std of every per-user metric."""
    return evaluate_lists(ctx, fitted.lists(ctx.data(), k), fitted.pred, held, k)


def evaluate_lists(ctx: Context, lists: DataFrame, pred: DataFrame, held: DataFrame, k: int = CONFIG.k, by: DataFrame | None = None) -> DataFrame:
    """evaluate() of lists and predictions; with ``by`` (a small table of settings) of all settings at once, a row each."""
    on = tuple(by.columns) if by is not None else ()
    rows = list_metrics(ctx, lists, metrics.relevant(held), k, by)
    stats = []
    for c in PER_USER:
        v = F.col(c).cast("double")
        stats += [F.avg(v).alias(f"{c}_mean"), F.percentile(v, F.lit(0.5)).alias(f"{c}_median"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{c}_std")]
    one = rows.groupBy(*on).agg(*stats, F.count("n_rel").alias("n_users_with_relevant"), F.count(F.lit(1)).alias("n_users_scored"))
    errors = metrics.rating_errors(metrics.clipped(pred, ctx.ratings), held, on)
    for part in (errors, metrics.coverage(lists, ctx.items.count(), on), metrics.user_coverage(lists, ctx.users, on)):
        one = one.join(part, list(on), "left") if on else one.crossJoin(part)  # one row each
    return one


def rank_modes(ctx: Context, heads: DataFrame, held: DataFrame, side: str, k: int = CONFIG.k) -> DataFrame:
    """Mean metrics of each ranking head of a neighbourhood model (predict()'s rows): rating, score, affinity. ``side``: whose mean is the base."""
    modes = {"rating": "pred", "score": "num", "affinity": "aff"}
    lists = [neighbourhood.filled_lists(neighbourhood.head(heads, m), m, ctx.train, ctx.users, ctx.items, side, k).withColumn("rank_mode", F.lit(m)) for m in modes]
    by = ctx.train.sparkSession.createDataFrame([(m,) for m in modes], "rank_mode string")
    rows = metrics.user_metrics(reduce(DataFrame.unionByName, lists), metrics.relevant(held), k, by)
    return rows.groupBy("rank_mode").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "hit_rate", "ndcg", "ap")))


class Meter:
    """What the jobs of a block take, from Spark's own accounts: seconds by the clock, CPU seconds, and the largest task's execution memory."""

    def __init__(self, spark: SparkSession):
        self.sc, self.group = spark.sparkContext, f"meter-{uuid.uuid4().hex}"
        self.seconds = self.cpu_s = self.peak_mb = 0.0

    def __enter__(self) -> Meter:
        self.sc.setJobGroup(self.group, "measured")
        self.began = time.time()
        return self

    def __exit__(self, *_: object) -> None:
        self.seconds = time.time() - self.began
        for name in ("spark.jobGroup.id", "spark.job.description"):
            self.sc.setLocalProperty(name, None)
        tracker, store = self.sc.statusTracker(), self.sc._jsc.sc().statusStore()
        stages = {s for job in tracker.getJobIdsForGroup(self.group) if (info := tracker.getJobInfo(job)) for s in info.stageIds}
        for stage in stages:
            if tracker.getStageInfo(stage) is None:  # skipped: its output was there
                continue
            data = store.lastStageAttempt(stage)
            self.cpu_s += data.executorCpuTime() / 1e9
            self.peak_mb = max(self.peak_mb, data.peakExecutionMemory() / 1e6 / max(1, data.numCompleteTasks()))


def bytes_of(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


@dataclass
class Measured:
    """A fitted model whose tables, predictions and lists are stored, and one row of what they took."""

    fitted: Fitted
    pred: DataFrame
    lists: DataFrame
    resources: DataFrame


def measured(ctx: Context, spec: dict, held: DataFrame, paths: dict[str, str], k: int = CONFIG.k) -> Measured:
    """Fit, keep the tables, predict ``held`` and rank, each once: what is measured is what is stored (``paths``: tables, pred, lists) and read from then on.

    One row: seconds to fit, predict and rank, per user, rows and bytes of the tables, CPU seconds and the largest stage's mean execution memory of a task.
    """
    spark, rows = ctx.train.sparkSession, 0
    with Meter(spark) as fit_m:
        fitted = fit(spec, ctx.data(held))
        for part, df in fitted.tables.items():
            seen = Observation()
            save_table(df.observe(seen, F.count(F.lit(1)).alias("n")), f"{paths['tables']}/{part}")
            rows += seen.get["n"]
    with Meter(spark) as predict_m:
        save_table(fitted.pred, paths["pred"])
    with Meter(spark) as rank_m:
        save_table(fitted.lists(ctx.data(), k), paths["lists"])
    size, users = sum(bytes_of(spark, f"{paths['tables']}/{part}") for part in fitted.tables), max(1, ctx.users.count())
    meters = (fit_m, predict_m, rank_m)
    columns = {
        "fit_s": fit_m.seconds, "predict_s": predict_m.seconds, "rank_s": rank_m.seconds, "rank_ms_per_user": 1000 * rank_m.seconds / users,
        "cpu_s": sum(m.cpu_s for m in meters), "peak_task_mb": max(m.peak_mb for m in meters),
    }
    row = spark.range(1).select(*(F.lit(float(v)).alias(c) for c, v in columns.items()), F.lit(rows).cast("long").alias("model_rows"), F.lit(size).cast("long").alias("model_bytes"))
    return Measured(fitted, load_table(spark, paths["pred"]), load_table(spark, paths["lists"]), row)


def sweep(ctx: Context, specs: list[dict], held: DataFrame, k: int = CONFIG.k, path: str | None = None) -> DataFrame:
    """A row per spec, in order of the list (``grid``), with its settings and metrics.

    Neighbourhoods of one similarity share its table and one ranked scan for all their k, centrings and heads, and are evaluated together. With ``path`` rows
    are appended there as they are done, under their spec's id; a later call with the same path takes what is there and makes the rest only.
    """
    named = [(grid, spec_id(spec), spec) for grid, spec in enumerate(specs)]
    spark = ctx.train.sparkSession
    done = {r["spec_id"] for r in load_table(spark, path).select("spec_id").distinct().collect()} if path and exists(spark, path) else set()
    todo = {key: spec for _, key, spec in named if key not in done}  # equal specs once
    parts = []

    def note(rows: DataFrame) -> None:
        if path:
            append_table(rows, path)
        else:
            parts.append(rows)

    shared: dict[tuple, dict[str, dict]] = {}
    for key, spec in todo.items():
        if scan := scan_of(spec):
            shared.setdefault(scan, {})[key] = spec
        else:
            note(evaluate(ctx, fit(spec, ctx.data(held)), held, k).withColumn("spec_id", F.lit(key)))
    for scan, group in shared.items():
        note(scanned(ctx, dict(scan), group, held, k))
    if path:
        parts = [load_table(spark, path)]
    elif not parts:
        raise ValueError("no specs")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = spark.createDataFrame([(grid, key, spec["family"], json.dumps(settings_of(spec), sort_keys=True)) for grid, key, spec in named], "grid int, spec_id string, family string, spec string")
    return rows.join(F.broadcast(order), "spec_id").select("grid", "family", "spec", *rows.columns)


def with_settings(table: DataFrame, schema: str) -> DataFrame:
    """A sweep's rows with some settings of their specs as columns (``schema``: names and types); null where a spec has no such setting."""
    return table.select("*", F.from_json("spec", schema).alias("_s")).select(*table.columns, "_s.*")


SETTINGS = {  # of each family, for with_settings()
    "ubcf": "k int, similarity string, mean_center boolean, rank_mode string",
    "ibcf": "k int, similarity string, mean_center boolean, center_by string, rank_mode string",
    "regression": "k int, lam double, weight_mode string, rank_mode string",
    "slim": "l1 double, l2 double, tau double, top_m int",
    "graph": "mode string, alpha double, length int, beta double, normalize string",
}


SCANNED = ("similarity", "min_support", "beta")  # what neighbourhoods of one ranked scan have in common


def scan_of(spec: dict) -> tuple | None:
    """The settings whose similarity table and ranked scan a spec needs; None for other families."""
    full = settings_of(spec)
    return tuple((c, full[c]) for c in ("family", *SCANNED)) if spec["family"] in ("ubcf", "ibcf") else None


def scanned(ctx: Context, scan: dict, group: dict[str, dict], held: DataFrame, k: int) -> DataFrame:
    """evaluate() of all specs of one similarity (spec id to spec), a row each, from one similarity table and one ranked scan up to the largest k (users with
    very many candidates: from blocks, see wide)."""
    user_based = scan["family"] == "ubcf"
    full = {key: settings_of(spec) for key, spec in group.items()}
    if user_based and (shape := wide.shape(ctx.train)) and not ctx.users.select("u").union(held.select("u")).join(ctx.train, "u", "left_anti").take(1):
        return widely(ctx, scan, full, held, k, *shape)
    matrix = similarity.by_user(ctx.train) if user_based else similarity.by_item(ctx.train)
    sim = settle(similarity.similarity(matrix, scan["similarity"], scan["min_support"], scan["beta"]))
    near = settle(neighbourhood.slots(ctx.train, sim, max(s["k"] for s in full.values()), user_based))
    centrings: dict[tuple, dict[str, dict]] = {}
    for key, s in full.items():
        centrings.setdefault((s["mean_center"], s.get("center_by", "user"), s["like_threshold"]), {})[key] = s
    lists, preds = [], []
    for (centre, by, liked_from), own in centrings.items():
        heads = settle(neighbourhood.heads_by_k(near, ctx.train, sorted({s["k"] for s in own.values()}), user_based, centre, by, liked_from))
        side = neighbourhood.base_side(user_based, centre, by)
        schema = "spec_id string, k int, mode string"
        wanted = ctx.train.sparkSession.createDataFrame([(key, s["k"], s["rank_mode"]) for key, s in own.items()], schema)
        score = F.when(F.col("mode") == "rating", F.col("pred")).when(F.col("mode") == "affinity", F.col("aff")).otherwise(F.col("num"))
        scores = heads.join(F.broadcast(wanted), "k").select("spec_id", "mode", "u", "i", score.alias("score"))
        for mode in sorted({s["rank_mode"] for s in own.values()}):
            mine = wanted.where(F.col("mode") == mode).select("spec_id")
            lists.append(neighbourhood.filled_lists(scores.where(F.col("mode") == mode).drop("mode"), mode, ctx.train, ctx.users, ctx.items, side, k, mine))
        cells = held.select("u", "i").distinct().crossJoin(F.broadcast(wanted.select("k").distinct()))  # settings, a few rows
        empty = cells.join(heads.select("u", "i", "k", "num", "den", "aff"), ["u", "i", "k"], "left").na.fill(0.0, ["num", "den", "aff"])
        preds.append(neighbourhood.with_predictions(empty, ctx.train, side, centre).join(F.broadcast(wanted), "k").select("spec_id", "u", "i", "pred"))
    by = ctx.train.sparkSession.createDataFrame([(key,) for key in group], "spec_id string")
    return evaluate_lists(ctx, settle(reduce(DataFrame.unionByName, lists)), reduce(DataFrame.unionByName, preds), held, k, by)


def widely(ctx: Context, scan: dict, full: dict[str, dict], held: DataFrame, k: int, users: int, items: int) -> DataFrame:
    """scanned() of user neighbourhoods with very many candidates: lists and predictions of all settings are made in blocks of users."""
    settings = [(s["k"], s["mean_center"], s["like_threshold"], s["rank_mode"]) for s in full.values()]
    kind = wide.Kind(scan["similarity"], scan["min_support"], scan["beta"])
    names = ctx.train.sparkSession.createDataFrame([(n, key) for n, key in enumerate(full)], "setting long, spec_id string")
    rows = settle(wide.listed(ctx.train, kind, settings, held.select("u", "i"), ctx.items, k, users, items).join(F.broadcast(names), "setting"))
    lists = rows.where("rank > 0").select("spec_id", "u", F.col("rank").cast("int").alias("rank"), "i", "score")
    preds = rows.where("rank = 0").select("spec_id", "u", "i", F.col("score").alias("pred"))
    return evaluate_lists(ctx, lists, preds, held, k, names.select("spec_id"))


def select_best(table: DataFrame, metric: str, highest: bool = True) -> DataFrame:
    """The row with the best metric; the first of the grid among equals."""
    order = F.desc_nulls_last(metric) if highest else F.asc_nulls_last(metric)
    return table.orderBy(order, "grid").limit(1)
