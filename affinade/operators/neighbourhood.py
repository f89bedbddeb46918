"""User- and item-based neighbourhoods with three heads.

For a pair (u, i) the user-based neighbours are the k most similar users among those who rated i, the item-based ones the k most
similar items among those u rated. Similarities of 0 take neighbour slots ahead of negative ones, though they add nothing
and aren't stored: a negative one counts only if slots are left after all candidates that aren't negative. So a pair needs
its number of candidates (the raters of i, or the items of u, without itself), not the candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinade.config import CONFIG
from affinade.operators import similarity, wide
from affinade.operators.baselines import means, settle
from affinade.operators.pairs import few, small
from affinade.operators.topk import filled_top_k

DEN_EPS = wide.DEN_EPS
SLOT_ROWS = 2_000_000  # candidates that a task of item_slots() ranks


def evidence(train: DataFrame, sim: DataFrame, user_based: bool, targets: DataFrame | None = None) -> DataFrame:
    """Every candidate of every (u, i) with a stored similarity: u, i, nbr, sim, r (the candidate's rating).

    ``targets`` (u, i) restricts the pairs, and with them the work.
    """
    kept = sim.where(F.col("sim") != 0).select("a", "b", "sim")
    if user_based:
        own = train.select(F.col("u").alias("b"), "i", "r")
        if targets is not None:
            own = own.join(targets.select("i").distinct(), "i", "left_semi")
            kept = kept.join(targets.select(F.col("u").alias("a")).distinct(), "a", "left_semi")
        rows = own.join(kept, "b").select(F.col("a").alias("u"), "i", F.col("b").alias("nbr"), "sim", "r")
    else:
        own = train.select("u", F.col("i").alias("b"), "r")
        if targets is not None:
            own = own.join(targets.select("u").distinct(), "u", "left_semi")
            kept = kept.join(targets.select(F.col("i").alias("a")).distinct(), "a", "left_semi")
        rows = own.join(kept, "b").select("u", F.col("a").alias("i"), F.col("b").alias("nbr"), "sim", "r")
    return rows if targets is None else rows.join(targets.select("u", "i"), ["u", "i"], "left_semi")


def slots(train: DataFrame, sim: DataFrame, most: int, user_based: bool, targets: DataFrame | None = None) -> DataFrame:
    """evidence() with ``slot``, the place it takes among all candidates of its pair, up to ``most``: one ranked scan for every k up to it.

    A positive one's slot is its rank among the positive, which Spark bounds by ``most`` rows a pair before it shuffles them. A negative one's comes after all
    candidates that aren't negative, stored or not; only negative ones are counted for that.
    """
    if not user_based and few(sim := settle(sim)):
        return item_slots(train, sim, most, targets)
    return slotted(evidence(train, sim.where("sim > 0"), user_based, targets), evidence(train, sim.where("sim < 0"), user_based, targets), train, most, user_based)


def user_slots(train: DataFrame, kind: wide.Kind, most: int, targets: DataFrame) -> DataFrame:
    """slots() of users for the pairs ``targets``, by a similarity that isn't stored: in blocks where candidates are very many."""
    if shape := wide.shape(train):
        return wide.near(train, kind, most, *shape, targets.select("u", "i"))
    return slots(train, similarity.similarity(similarity.by_user(train), kind.name, kind.min_support, kind.beta), most, True, targets)


def item_slots(train: DataFrame, sim: DataFrame, most: int, targets: DataFrame | None = None) -> DataFrame:
    """slots() of items with so few similarities (stored) that these are sent to the ratings: all candidates of a pair are the user's own, so
    once ratings are dealt by user nothing of what they make is shuffled. An item counts itself with ``_own``, to know what the user has."""
    rated = train.select("u", F.col("i").alias("b"), "r")
    if targets is not None:
        rated = rated.join(targets.groupBy("u").agg(F.collect_set("i").alias("_t")), "u")  # a user's few, carried along
        sim = sim.join(F.broadcast(targets.select(F.col("i").alias("a")).distinct()), "a", "left_semi")
    same = train.select(F.col("i").alias("a"), F.col("i").alias("b")).distinct().select("a", "b", F.lit(None).cast("double").alias("sim"))
    table = sim.where("sim != 0").select("a", "b", "sim").union(same)
    made = rated.count() * table.count() // max(1, same.count())
    rated = rated.repartition(max(rated.sparkSession.sparkContext.defaultParallelism, -(-made // SLOT_ROWS)), "u")
    rated = rated.withColumn("n_side", F.count(F.lit(1)).over(Window.partitionBy("u")))
    pair, s = Window.partitionBy("u", "i"), F.col("sim")
    rows = rated.join(F.broadcast(table), "b")
    rows = rows if targets is None else rows.where(F.array_contains("_t", F.col("a")))
    rows = rows.select("u", F.col("a").alias("i"), F.col("b").alias("nbr"), "sim", "r", "n_side")
    order = pair.orderBy(F.desc(F.when(s > 0, 1).when(s < 0, -1).otherwise(0)), F.desc(F.round("sim", 9)), F.asc("nbr"))
    rows = rows.withColumns({"_p": F.row_number().over(order), "_n": F.count(F.lit(1)).over(pair), "_own": F.count_if(s.isNull()).over(pair)})
    slot = F.when(s > 0, F.col("_p")).otherwise(F.col("n_side") - F.col("_own") - F.col("_n") + F.col("_p")).cast("int")
    return rows.where("sim is not null").withColumn("slot", slot).where(F.col("slot") <= most).select("u", "i", "nbr", "sim", "r", "slot")


def slotted(up: DataFrame, down: DataFrame, train: DataFrame, most: int, user_based: bool) -> DataFrame:
    """slots() of the positive and the negative rows of evidence()."""
    pair = Window.partitionBy("u", "i")
    place = F.row_number().over(pair.orderBy(F.desc(F.round("sim", 9)), F.asc("nbr")))
    up = up.withColumn("slot", place).where(F.col("slot") <= most)
    side = "i" if user_based else "u"
    sizes = train.groupBy(side).agg(F.count(F.lit(1)).alias("n_side"))
    own = train.select("u", "i", F.lit(1).alias("_own"))
    down = down.withColumn("_p", place).withColumn("_n", F.count(F.lit(1)).over(pair)).where(F.col("_p") <= most)
    others = F.col("n_side") - F.coalesce("_own", F.lit(0))
    down = down.join(sizes, side).join(own, ["u", "i"], "left").withColumn("slot", (others - F.col("_n") + F.col("_p")).cast("int")).where(F.col("slot") <= most)
    names = ["u", "i", "nbr", "sim", "r", "slot"]
    return up.select(*names).union(down.select(*names))


def nearest(rows: DataFrame, train: DataFrame, k: int, user_based: bool) -> DataFrame:
    """The rows of evidence() that are among the k nearest of their pair."""
    return slotted(rows.where("sim > 0"), rows.where("sim < 0"), train, k, user_based).drop("slot")


def contributing(near: DataFrame, means_of: DataFrame, user_based: bool, centre: bool, centre_by: str) -> DataFrame:
    """slots() with ``d``, what a neighbour's rating counts: less the neighbour's mean (user-based), the item's, the user's, or as it is.

    ``means_of``: (u or i, m), the means of who is centred by.
    """
    if not centre:
        return near.withColumn("d", F.col("r"))
    key = "u" if not user_based and centre_by == "user" else "nbr"
    of = means_of.select(F.col("u" if user_based or centre_by == "user" else "i").alias(key), "m")
    return near.join(small(of), key).withColumn("d", F.col("r") - F.col("m")).drop("m")


def centres(train: DataFrame, user_based: bool, centre_by: str) -> DataFrame:
    return train.groupBy("u" if user_based or centre_by == "user" else "i").agg(F.avg("r").alias("m"))


def base_side(user_based: bool, centre: bool, centre_by: str) -> str:
    """Whose mean a pair without evidence is predicted by."""
    return "u" if user_based or centre_by == "user" or not centre else "i"


def with_predictions(sums: DataFrame, train: DataFrame, side: str, centre: bool) -> DataFrame:
    """Rows of u, i, num, den, aff get ``pred``; the base mean where there is no evidence of weight."""
    base, mu = small(train.groupBy(side).agg(F.avg("r").alias("base"))), train.agg(F.avg("r").alias("mu"))
    sums = sums.join(base, side, "left").crossJoin(F.broadcast(mu))  # one row
    base_of = F.coalesce("base", "mu")
    pred = F.when(F.col("den") > DEN_EPS, F.col("num") / F.col("den") + (base_of if centre else F.lit(0.0))).otherwise(base_of)
    return sums.withColumn("pred", pred).drop("base", "mu")


def heads_by_k(near: DataFrame, train: DataFrame, ks: list[int], user_based: bool, centre: bool = True, centre_by: str = "item", liked_from: float = CONFIG.liked_from) -> DataFrame:
    """u, i, k, pred, num, den, aff for every k of ``ks`` and pair with evidence among its ks, from one ranked scan (slots() up to the largest k)."""
    rows = contributing(near, centres(train, user_based, centre_by), user_based, centre, centre_by)
    s, liked = F.col("sim"), (F.col("r") >= liked_from).cast("double")
    parts = {"num": s * F.col("d"), "den": F.abs(s), "aff": F.greatest(s, F.lit(0.0)) * liked}
    within = lambda k, x: F.coalesce(F.sum(F.when(F.col("slot") <= k, x)), F.lit(0.0))
    sums = rows.groupBy("u", "i").agg(F.min("slot").alias("_s"), *(within(k, x).alias(f"{name}_{k}") for k in ks for name, x in parts.items()))
    return heads_of(sums, train, ks, base_side(user_based, centre, centre_by), centre)


def heads_of(sums: DataFrame, train: DataFrame, ks: list[int], side: str, centre: bool) -> DataFrame:
    """heads_by_k() of the sums of every pair (u, i, _s, the first slot, and num, den, aff of each k)."""
    parts = ("num", "den", "aff")
    each = F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"{name}_{k}").alias(name) for name in parts)) for k in ks))
    long = sums.select("u", "i", "_s", F.explode(each).alias("h")).select("u", "i", "_s", "h.*").where(F.col("_s") <= F.col("k")).drop("_s")
    return with_predictions(long, train, side, centre).select("u", "i", "k", "pred", "num", "den", "aff")


def wide_heads(sums: DataFrame, train: DataFrame, ks: list[int], c: int, centre: bool) -> DataFrame:
    """heads_by_k() of centring ``c`` of wide.head_sums()."""
    own = sums.select("u", "i", "_s", *(F.col(f"{p}_{c}_{k}").alias(f"{p}_{k}") for k in ks for p in ("num", "aff")), *(f"den_{k}" for k in ks))
    return heads_of(own, train, ks, "u", centre)


def predict_users(train: DataFrame, kind: wide.Kind, k: int, centre: bool, liked_from: float, shape: tuple[int, int]) -> DataFrame:
    """predict() of all users by a similarity that isn't stored, for ratings of a wide.shape()."""
    return wide_heads(wide.head_sums(train, kind, [k], [(centre, liked_from)], *shape), train, [k], 0, centre).drop("k")


def predict(train: DataFrame, sim: DataFrame, k: int, user_based: bool, centre: bool = True, centre_by: str = "item", liked_from: float = CONFIG.liked_from, targets: DataFrame | None = None) -> DataFrame:
    """u, i, pred, num, den, aff for every pair with evidence (see completed() and filled_lists() for the others).

    Centred, a neighbour counts by its rating less its mean (user-based: the neighbour's; item-based: the item's, or with
    ``centre_by='user'`` the user's), on top of the pair's own mean; raw, by its rating.
    """
    near = slots(train, sim, k, user_based, targets)
    return heads_by_k(near, train, [k], user_based, centre, centre_by, liked_from).drop("k")


def filled_lists(rows: DataFrame, mode: str, train: DataFrame, users: DataFrame, items: DataFrame, side: str, n: int, by: DataFrame | None = None) -> DataFrame:
    """Top-N over every pair from the rows of pairs with evidence (u, i, score): others score the base mean (mode ``rating``) or 0, and
    are met in order of it, as few as can matter. ``by``: as of filled_top_k()."""
    if mode != "rating":
        return filled_top_k(rows, users, items.select("i"), n, train, by=by)
    if side == "u":
        return filled_top_k(rows, users, items.select("i"), n, train, offset=means(train, "u", users).select("u", F.col("mean").alias("c")), by=by)
    return filled_top_k(rows, users, means(train, "i", items).select("i", F.col("mean").alias("score")), n, train, by=by)


def completed(rows: DataFrame, cells: DataFrame, train: DataFrame, by_user: bool) -> DataFrame:
    """predict()'s rows for every one of ``cells`` (u, i): without evidence the base mean (the user's or item's, else the
    global one), and num, den, aff 0."""
    side = "u" if by_user else "i"
    base = train.groupBy(side).agg(F.avg("r").alias("base"))
    mu = train.agg(F.avg("r").alias("mu"))
    found = rows.select("u", "i", "pred", "num", "den", "aff")
    out = cells.select("u", "i").distinct().join(found, ["u", "i"], "left").join(base, side, "left").crossJoin(F.broadcast(mu))  # one row
    return out.select("u", "i", F.coalesce("pred", "base", "mu").alias("pred"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("num", "den", "aff")))


def head(scores: DataFrame, mode: str) -> DataFrame:
    """u, i, score by the rating, affinity or score head."""
    column = {"rating": "pred", "affinity": "aff", "score": "num"}[mode]
    return scores.select("u", "i", F.col(column).alias("score"))


def explain(train: DataFrame, sim: DataFrame, k: int, user_based: bool, targets: DataFrame, top_n: int = 5) -> DataFrame:
    """Why (u, i): the neighbours of the score itself, by the size of their contribution (similarity times rating)."""
    return explained(slots(train, sim, k, user_based, targets), top_n)


def explained(near: DataFrame, top_n: int = 5) -> DataFrame:
    """explain() of a scan's rows."""
    rows = near.withColumn("contribution", F.col("sim") * F.col("r"))
    return strongest(rows, top_n).select("u", "i", "rank", "nbr", "sim", "r", "contribution", "weight_share")


def strongest(rows: DataFrame, top_n: int) -> DataFrame:
    """The largest contributions of each pair with ``rank`` and ``weight_share``, their share of all its similarities' size."""
    whole = Window.partitionBy("u", "i")
    order = whole.orderBy(F.desc(F.round(F.abs("contribution"), 9)), F.asc("nbr"))
    size = F.sum(F.abs("sim")).over(whole)
    rows = rows.withColumn("weight_share", F.when(size > 0, F.col("contribution") / size).otherwise(0.0))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def reasons(train: DataFrame, sim: DataFrame, k: int, user_based: bool, targets: DataFrame, mode: str, centre: bool = True, centre_by: str = "item", liked_from: float = CONFIG.liked_from, top_n: int | None = 5) -> DataFrame:
    """Why the head ``mode`` scores (u, i) as it does: what each neighbour adds to it, so that all contributions add up to the head's sum.

    affinity: similarity, if positive, where the rating is liked; score and rating: similarity times what the rating counts, centred as the model is
    (rating: the sum is then divided by ``weight``, the similarities' size, and added to the base mean). ``top_n`` None: all of them.
    """
    near = slots(train, sim, k, user_based, targets)
    return reasoned(near, centres(train, user_based, centre_by), user_based, centre, centre_by, liked_from, mode, top_n)


def reasoned(near: DataFrame, means_of: DataFrame, user_based: bool, centre: bool, centre_by: str, liked_from: float, mode: str, top_n: int | None) -> DataFrame:
    """reasons() of a scan's rows."""
    rows, s = contributing(near, means_of, user_based, centre, centre_by), F.col("sim")
    liked = F.greatest(s, F.lit(0.0)) * (F.col("r") >= liked_from).cast("double")
    rows = rows.withColumn("contribution", liked if mode == "affinity" else s * F.col("d"))
    n = 2_147_483_647 if top_n is None else top_n
    return strongest(rows, n).select("u", "i", "rank", "nbr", "sim", "r", "d", "contribution", "weight_share", F.lit(mode).alias("head"))
