"""One user's refit by difference: hiding some of the user's ratings changes only the sums that these ratings are part of.

Kept are pair sums of items, rows' squares, and totals of items and users of all training rows. Hidden ratings are taken from the sums of
pairs of the user's items (of these alone; adjusted cosines change by the user's mean too), from the totals of those items and of the user.
A list then needs similarities to the user's own items only. So a refit costs the user's rows squared and one read of the pairs that touch them,
not a self-join of all ratings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinade.config import CONFIG
from affinade.operators import graph, neighbourhood, similarity
from affinade.operators.baselines import settle
from affinade.operators.split import hide_profile
from affinade.operators.topk import filled_top_k, item_scores_top_k, top_k
from affinade.plans.evaluate import Context
from affinade.plans.registry import settings_of

SUMS = ("n_co", "sx", "sy", "sxx", "syy", "dot")
BY_DIFFERENCE = ("popularity", "popularity_positive", "item_mean", "global_mean", "user_mean", "ubcf", "ibcf", "graph")


@dataclass
class Profile:
    """One user's training rows before and after hiding."""

    user: int
    old: DataFrame
    new: DataFrame
    hidden: DataFrame


def profile(train: DataFrame, user: int) -> Profile:
    rows = settle(hide_profile(train, user))
    return Profile(user, rows.drop("hidden"), rows.where("not hidden").drop("hidden"), rows.where("hidden").drop("hidden"))


def with_difference(kept: DataFrame, difference: DataFrame, keys: list[str], sums: tuple[str, ...]) -> DataFrame:
    """Stored sums plus a difference; keys that the difference doesn't name stay as they are."""
    named = difference.select(*keys, *(F.col(c).alias(f"_{c}") for c in sums))
    rows = kept.join(named, keys, "left")
    return rows.select(*keys, *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums))


def signed(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.withColumn("_sign", F.lit(1)).union(old.withColumn("_sign", F.lit(-1)))


class Refit:
    """Sums over all training rows, made once, for the refits of any number of users."""

    def __init__(self, ctx: Context):
        self.ctx = ctx
        self._items: dict[bool, tuple[DataFrame, DataFrame]] = {}
        self._users: DataFrame | None = None
        totals = lambda key: settle(ctx.train.groupBy(key).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") >= CONFIG.liked_from).alias("n_liked")))
        self.totals = {key: totals(key) for key in ("u", "i")}

    def item_sums(self, centred: bool) -> tuple[DataFrame, DataFrame]:
        """Pair sums and squares of items, of ratings or of ratings less their user's mean."""
        if centred not in self._items:
            matrix = similarity.by_item(self.ctx.train)
            matrix = similarity.centred(matrix) if centred else matrix
            self._items[centred] = settle(similarity.paired(matrix, similarity.pair_sums())), settle(similarity.squares(matrix))
        return self._items[centred]

    def item_similarity(self, p: Profile, kind: str, min_support: int | None, beta: float | None) -> DataFrame:
        """Similarities (a, b) of every item a to the user's remaining items b, as a full refit has them."""
        centred = kind == "adjusted_cosine"
        pairs, rows = self.item_sums(centred)
        less_mean = lambda own: own.crossJoin(F.broadcast(own.agg(F.avg("r").alias("m")))).select(F.col("i").alias("a"), (F.col("r") - F.col("m")).alias("x"))  # noqa: E731  one row
        values = less_mean if centred else (lambda own: own.select(F.col("i").alias("a"), F.col("r").alias("x")))

        def contributions(own: DataFrame) -> DataFrame:
            one, two = values(own), values(own).select(F.col("a").alias("b"), F.col("x").alias("y"))
            x, y = F.col("x"), F.col("y")
            return one.join(two, F.col("a") < F.col("b")).select("a", "b", F.lit(1).alias("n_co"), x.alias("sx"), y.alias("sy"), (x * x).alias("sxx"), (y * y).alias("syy"), (x * y).alias("dot"))  # of one user

        change = signed(contributions(p.new), contributions(p.old)).groupBy("a", "b").agg(*(F.sum(F.col(c) * F.col("_sign")).alias(c) for c in SUMS))
        mine = p.new.select(F.col("i").alias("b"))
        touching = pairs.join(mine, "b", "left_semi").unionByName(pairs.join(mine, "b", "left_anti").join(mine.withColumnRenamed("b", "a"), "a", "left_semi"))
        pairs = with_difference(touching, change, ["a", "b"], SUMS).where("n_co > 0")
        square = signed(values(p.new), values(p.old)).groupBy("a").agg(F.sum(F.col("x") * F.col("x") * F.col("_sign")).alias("q"))
        rows = with_difference(rows, square, ["a"], ("q",))
        sims = similarity.pearson_of(pairs) if kind == "pearson" else similarity.cosine_of(pairs, rows)
        return similarity.mirrored(similarity.reliable(sims, min_support, beta)).join(mine, "b", "left_semi")

    def user_similarity(self, p: Profile, kind: str, min_support: int | None, beta: float | None) -> DataFrame:
        """Similarities (a, b) of the user a to all others: one row of the table, from the raters of the remaining items."""
        if self._users is None:
            self._users = settle(similarity.squares(similarity.by_user(self.ctx.train)))
        own = p.new.select("i", F.col("r").alias("x"))
        others = self.ctx.train.where(F.col("u") != p.user).select(F.col("u").alias("b"), "i", F.col("r").alias("y"))
        pairs = others.join(own, "i").groupBy("b").agg(F.count(F.lit(1)).alias("n_co"), *similarity.pair_sums()).withColumn("a", F.lit(p.user).cast("long"))
        new = p.new.groupBy(F.col("u").alias("a")).agg(F.sum(F.col("r") * F.col("r")).alias("q"))
        rows = self._users.where(F.col("a") != p.user).union(new)
        sims = similarity.pearson_of(pairs) if kind == "pearson" else similarity.cosine_of(pairs, rows)
        return similarity.reliable(sims, min_support, beta)

    def means(self, p: Profile, key: str) -> DataFrame:
        """key, m, n, n_liked of all training rows but the hidden ones."""
        gone = p.hidden.groupBy(key).agg((-F.sum("r")).alias("s"), (-F.count(F.lit(1))).alias("n"), (-F.count_if(F.col("r") >= CONFIG.liked_from)).alias("n_liked"))
        rows = with_difference(self.totals[key], gone, [key], ("s", "n", "n_liked")).where("n > 0")
        return rows.select(key, (F.col("s") / F.col("n")).alias("m"), "n", "n_liked")

    def mu(self, p: Profile) -> float:
        s, n = self.totals["u"].agg(F.sum("s"), F.sum("n")).first()
        gone, m = p.hidden.agg(F.coalesce(F.sum("r"), F.lit(0.0)), F.count(F.lit(1))).first()
        return (s - gone) / (n - m) if n > m else 0.0

    def lists(self, p: Profile, spec: dict, k: int = CONFIG.k) -> DataFrame:
        """u, rank, i, score of the one user by a family of BY_DIFFERENCE: the list of a full refit without the hidden rows."""
        s, one = settings_of(spec), self.ctx.users.where(F.col("u") == p.user)
        family, items = s["family"], self.ctx.items.select("i")
        if family in ("ubcf", "ibcf"):
            return self._neighbours(p, s, one, k)
        if family == "graph":
            if s["mode"] != "path" or s["length"] > 3:
                raise ValueError("longer walks pass the hidden edges of others' ways too: refit them")
            return self._paths(p, s, k)
        of = self.means(p, "i")
        mu = self.mu(p)
        score = {"item_mean": F.coalesce("m", F.lit(mu)), "popularity": F.coalesce("n", F.lit(0)), "popularity_positive": F.coalesce("n_liked", F.lit(0))}.get(family, F.lit(0.0))
        rows = items.join(of, "i", "left").select("i", score.cast("double").alias("score"))
        return item_scores_top_k(one, rows, k, p.new)

    def _neighbours(self, p: Profile, s: dict, one: DataFrame, k: int) -> DataFrame:
        user_based, centre, by = s["family"] == "ubcf", s["mean_center"], s.get("center_by", "user")
        sim = settle((self.user_similarity if user_based else self.item_similarity)(p, s["similarity"], s["min_support"], s["beta"]))
        known = self.ctx.train if user_based else p.new
        near = neighbourhood.slots(known, sim, s["k"], user_based)
        near = near.where(F.col("u") == p.user)
        rows = neighbourhood.contributing(near, self.means(p, "u" if user_based or by == "user" else "i"), user_based, centre, by)
        w, liked = F.col("sim"), (F.col("r") >= s["like_threshold"]).cast("double")
        rows = rows.groupBy("u", "i").agg(F.sum(w * F.col("d")).alias("num"), F.sum(F.abs(w)).alias("den"), F.sum(F.greatest(w, F.lit(0.0)) * liked).alias("aff"))
        side, mu = neighbourhood.base_side(user_based, centre, by), F.lit(self.mu(p))
        base = self.means(p, side).select(side, "m")
        rows = rows.join(base, side, "left").withColumn("base", F.coalesce("m", mu))
        pred = F.when(F.col("den") > neighbourhood.DEN_EPS, F.col("num") / F.col("den") + (F.col("base") if centre else F.lit(0.0))).otherwise(F.col("base"))
        score = {"rating": pred, "score": F.col("num"), "affinity": F.col("aff")}[s["rank_mode"]]
        own = settle(rows.select("u", "i", score.alias("score")))
        items = self.ctx.items.select("i")
        if s["rank_mode"] != "rating":
            return filled_top_k(own, one, items, k, p.new)
        if side == "u":
            return filled_top_k(own, one, items, k, p.new, one.join(base, "u", "left").select("u", F.coalesce("m", mu).alias("c")))
        return filled_top_k(own, one, items.join(base, "i", "left").select("i", F.coalesce("m", mu).alias("score")), k, p.new)

    def _paths(self, p: Profile, s: dict, k: int) -> DataFrame:
        """Walks of at most three edges: the user's items, their raters, and those raters' items; no other edge is read."""
        tau = s["tau"]
        old = self.ctx.train.where(F.col("r") >= tau).select("u", "i").join(p.hidden.select("u", "i"), ["u", "i"], "left_anti")
        first = p.new.where(F.col("r") >= tau).select("i")
        raters = old.join(first, "i", "left_semi")
        near = old.join(raters.select("u").distinct(), "u", "left_semi")  # edges of all who share an item
        if s["normalize"] == "degree":
            of_u, of_i = near.groupBy("u").agg((1.0 / F.count(F.lit(1))).alias("w")), raters.groupBy("i").agg((1.0 / F.count(F.lit(1))).alias("w"))
            ui, iu = near.join(of_u, "u"), raters.join(of_i, "i").select("i", "u", "w")
        else:
            ui, iu = near.withColumn("w", F.lit(1.0)), raters.select("i", "u", F.lit(1.0).alias("w"))
        ui = settle(ui.select("u", "i", "w"))
        start = ui.where(F.col("u") == p.user).select("i", F.col("w").alias("m"))
        parts = start.select("i", (F.col("m") * s["beta"]).alias("s"))
        if s["length"] >= 3:
            hop = graph.item_hop(ui, iu)
            parts = parts.union(start.join(hop, "i").select(F.col("j").alias("i"), (F.col("m") * F.col("w") * s["beta"] ** 3).alias("s")))
        score = parts.groupBy("i").agg(F.sum("s").alias("score")).select(F.lit(p.user).cast("long").alias("u"), "i", "score")
        return top_k(score, k, p.new)
