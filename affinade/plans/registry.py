"""Model specs: a dict with ``family`` and its settings becomes prediction and ranking tables."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinade.config import CONFIG
from affinade.operators import baselines, graph, neighbourhood, regression, similarity, slim, wide
from affinade.operators.metrics import calibration
from affinade.operators.topk import hashed_top_k, item_scores_top_k, top_k


@dataclass
class Data:
    """What a model may learn from and must score: training rows, calibration rows, the users and items."""

    train: DataFrame
    users: DataFrame
    items: DataFrame
    calibrate: DataFrame | None = None
    targets: DataFrame | None = None  # (u, i) to score; None: every user with every item
    held: DataFrame | None = None  # (u, i) to predict a rating for; None: those to score
    extra: dict = field(default_factory=dict)

    def cells(self) -> DataFrame:
        return self.held.select("u", "i").distinct() if self.held is not None else self.pairs()

    def pairs(self) -> DataFrame:
        return self.targets.select("u", "i") if self.targets is not None else self.users.select("u").crossJoin(self.items.select("i"))  # asked for: all cells


@dataclass
class Fitted:
    """``pred`` (u, i, pred) for rating metrics, ``score`` (u, i, score) for ranking, and the model's tables.

    Models whose order of items is the same for all users give ``shared`` (i, score) and need no product of users and items
    for their lists; ``score`` is then for those who ask for every cell.
    """

    pred: DataFrame
    score: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    shared: DataFrame | None = None
    hashed: int | None = None  # the seed of a score that is a hash of u and i
    listed: Callable[[Data, int], DataFrame] | None = None  # top-N of models that score every cell, most of them alike

    def lists(self, data: Data, k: int) -> DataFrame:
        """Top-N without the training items: u, rank, i, score."""
        if self.listed is not None:
            return self.listed(data, k)
        if self.shared is not None:
            return item_scores_top_k(data.users, self.shared, k, data.train)
        if self.hashed is not None:
            return hashed_top_k(data.users, data.items, self.hashed, k, data.train)
        return top_k(self.score, k, data.train)


MODELS: dict[str, Callable[..., Fitted]] = {}


def model(family: str):
    def add(f):
        MODELS[family] = f
        return f

    return add


def per_item(data: Data, scores: DataFrame, pred: DataFrame) -> Fitted:
    return Fitted(data.cells().join(pred, "i").select("u", "i", "pred"), data.pairs().join(scores, "i").select("u", "i", "score"), {"items": scores}, shared=scores)


def flat(data: Data) -> DataFrame:
    """The same score for all items: lists go by the items' numbers."""
    return data.items.select("i", F.lit(0.0).alias("score"))


@model("global_mean")
def _global_mean(data: Data) -> Fitted:
    of = lambda cells: cells.crossJoin(F.broadcast(baselines.global_mean(data.train))).select("u", "i", F.col("mu").alias("pred"))  # noqa: E731  one row
    return Fitted(of(data.cells()), of(data.pairs()).withColumnRenamed("pred", "score"), shared=flat(data))


@model("user_mean")
def _user_mean(data: Data) -> Fitted:
    of = lambda cells: cells.join(baselines.means(data.train, "u", data.users), "u").select("u", "i", F.col("mean").alias("pred"))
    return Fitted(of(data.cells()), of(data.pairs()).withColumnRenamed("pred", "score"), shared=flat(data))


@model("item_mean")
def _item_mean(data: Data) -> Fitted:
    pred = baselines.means(data.train, "i", data.items).select("i", F.col("mean").alias("pred"))
    return per_item(data, pred.withColumnRenamed("pred", "score"), pred)


@model("bias")
def _bias(data: Data, lam_user: float = 10.0, lam_item: float = 10.0, iterations: int = 20) -> Fitted:
    b_i, b_u, _ = baselines.bias_model(data.train, lam_user, lam_item, iterations, trace_every=0)
    mu = data.train.agg(F.avg("r")).first()[0] or 0.0
    of = lambda cells: baselines.bias_predict(cells, b_i, b_u, mu)
    shared = data.items.select("i").join(b_i, "i", "left").select("i", F.coalesce("b_i", F.lit(0.0)).alias("score"))
    return Fitted(of(data.cells()), of(data.pairs()).withColumnRenamed("pred", "score"), {"b_i": b_i, "b_u": b_u}, shared)


@model("popularity")
def _popularity(data: Data, liked_from: float | None = None) -> Fitted:
    pred = baselines.means(data.train, "i", data.items).select("i", F.col("mean").alias("pred"))
    return per_item(data, baselines.popularity_scores(data.train, data.items, liked_from), pred)


@model("popularity_positive")
def _popularity_positive(data: Data, liked_from: float = CONFIG.liked_from) -> Fitted:
    return _popularity(data, liked_from)


@model("random")
def _random(data: Data, seed: int = CONFIG.seed) -> Fitted:
    pred = data.cells().crossJoin(F.broadcast(baselines.global_mean(data.train))).select("u", "i", F.col("mu").alias("pred"))  # one row
    return Fitted(pred, baselines.random_scores(data.pairs(), seed), hashed=seed)


def _neighbours(data: Data, user_based: bool, k: int, kind: str, centre: bool, centre_by: str, min_support: int | None, beta: float | None, rank_mode: str, liked_from: float) -> Fitted:
    """``heads`` has the pairs with evidence; predictions are for the cells asked for, and lists meet as few other items as can matter. ``sim`` has all
    similarities, or those that wide.used() gives."""
    if user_based and data.targets is None and (shape := wide.shape(data.train)):
        of = wide.Kind(kind, min_support, beta)
        rows, sim = baselines.settle(neighbourhood.predict_users(data.train, of, k, centre, liked_from, shape)), wide.used(data.train, of, k, *shape)
    else:
        matrix = similarity.by_user(data.train) if user_based else similarity.by_item(data.train)
        sim = baselines.settle(similarity.similarity(matrix, kind, min_support, beta))
        rows = baselines.settle(neighbourhood.predict(data.train, sim, k, user_based, centre, centre_by, liked_from, data.targets))
    side = neighbourhood.base_side(user_based, centre, centre_by)
    every = lambda cells: neighbourhood.completed(rows, cells, data.train, side == "u")
    listed = lambda d, n: neighbourhood.filled_lists(neighbourhood.head(rows, rank_mode), rank_mode, d.train, d.users, d.items, side, n)
    return Fitted(every(data.cells()).select("u", "i", "pred"), neighbourhood.head(every(data.pairs()), rank_mode), {"sim": sim, "heads": rows}, listed=listed)


@model("ubcf")
def _ubcf(data: Data, k: int = 80, similarity: str = "cosine", mean_center: bool = True, min_support: int | None = CONFIG.min_support, beta: float | None = CONFIG.beta, rank_mode: str = "score", like_threshold: float = CONFIG.liked_from) -> Fitted:
    if similarity == "adjusted_cosine":
        raise ValueError("users have no adjusted cosine: it centres by user")
    return _neighbours(data, True, k, similarity, mean_center, "user", min_support, beta, rank_mode, like_threshold)


@model("ibcf")
def _ibcf(data: Data, k: int = 20, similarity: str = "adjusted_cosine", mean_center: bool = True, center_by: str = "item", min_support: int | None = CONFIG.min_support, beta: float | None = CONFIG.beta, rank_mode: str = "rating", like_threshold: float = CONFIG.liked_from) -> Fitted:
    return _neighbours(data, False, k, similarity, mean_center, center_by, min_support, beta, rank_mode, like_threshold)


@model("regression")
def _regression(data: Data, k: int = 40, lam: float = 25.0, similarity: str = "adjusted_cosine", weight_mode: str = "ridge", rank_mode: str = "rating", lam_bias: float = 10.0, iterations: int = 20, like_threshold: float = CONFIG.liked_from) -> Fitted:
    from affinade.operators.similarity import by_item
    from affinade.operators.similarity import similarity as build

    sim = build(by_item(data.train), similarity)
    w, (dev, b_i, b_u, mu) = regression.regression_weights(data.train, sim, data.items, k, lam, weight_mode, lam_bias, iterations)
    moved = baselines.settle(regression.apply_weights(dev, w, "dev"))
    of = lambda cells: baselines.bias_predict(cells, b_i, b_u, mu).join(moved, ["u", "i"], "left").select("u", "i", (F.col("pred") + F.coalesce("score", F.lit(0.0))).alias("pred"))
    tables = {"w": w, "sim": sim, "dev": dev, "b_i": b_i, "b_u": b_u}
    if rank_mode == "rating":
        return Fitted(of(data.cells()), of(data.pairs()).withColumnRenamed("pred", "score"), tables, listed=lambda d, n: regression.rating_lists(moved, b_i, b_u, mu, d.train, d.users, d.items, n))
    score = moved if rank_mode == "score" else regression.apply_weights(regression.liked(data.train, like_threshold), w)
    return Fitted(of(data.cells()), score, tables)


def calibrated(score: DataFrame, data: Data, x=lambda c: c) -> DataFrame:
    """Predictions a + b x(score), fitted on the calibration rows (training rows without any); no score counts as 0."""
    rows = data.calibrate if data.calibrate is not None else data.train
    fit = calibration(rows.join(score, ["u", "i"], "left").select(x(F.coalesce("score", F.lit(0.0))).alias("x"), "r"))
    cells = data.cells().join(score, ["u", "i"], "left").crossJoin(F.broadcast(fit))  # one row
    return cells.select("u", "i", (F.col("a") + F.col("b") * x(F.coalesce("score", F.lit(0.0)))).alias("pred"))


@model("slim")
def _slim(data: Data, l1: float = 5.0, l2: float = 50.0, tau: float = CONFIG.liked_from, top_m: int | None = None) -> Fitted:
    likes = regression.liked(data.train, tau)
    w = baselines.settle(slim.weights(slim.fit(likes, l1, l2, top_m)))
    score = regression.apply_weights(likes, w)
    return Fitted(calibrated(score, data), score, {"w": w})


@model("graph")
def _graph(data: Data, mode: str = "path", length: int = 3, beta: float = 0.5, normalize: str = "degree", alpha: float = 0.15, n_iter: int = 200, tau: float = CONFIG.liked_from) -> Fitted:
    edges = data.train.where(F.col("r") >= tau).select("u", "i")
    if mode == "path":
        score = graph.path_scores(edges, length, beta, normalize, data.users)
    else:
        score = graph.walk_scores(edges, data.users, alpha, n_iter)
    return Fitted(calibrated(score, data, graph.damped), score, {"edges": edges})


def settings_of(spec: dict) -> dict:
    """A spec with its family's defaults: the one place where these are."""
    given = inspect.signature(MODELS[spec["family"]]).parameters
    return {name: p.default for name, p in given.items() if p.default is not inspect.Parameter.empty} | spec


def fit(spec: dict, data: Data) -> Fitted:
    settings = dict(spec)
    family = settings.pop("family", None)
    if family not in MODELS:
        raise KeyError(f"unknown model {family!r}; known: {', '.join(sorted(MODELS))}")
    return MODELS[family](data, **settings)
