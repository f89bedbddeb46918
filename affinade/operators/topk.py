"""Top-N lists: best scores per user without what the user already has."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinade.functions.columns import finite, hashed_uniform
from affinade.functions.compiled import java_function
from affinade.functions.digests import HIT, by_length, first_words, java_source
from affinade.operators.baselines import settle
from affinade.operators.ordered import running

DIGITS = 9  # engines add in different orders; scores are compared after this many places


def exclude(scores: DataFrame, seen: DataFrame) -> DataFrame:
    return scores.join(seen.select("u", "i"), ["u", "i"], "left_anti")


def top_k(scores: DataFrame, k: int, seen: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """u, rank, i, score: highest score first, then the smaller item; short lists stay short. ``by``: further columns that tell lists apart."""
    rows = scores if seen is None else exclude(scores, seen)
    rows = rows.select(*by, "u", "i", F.round(finite(F.col("score")), DIGITS).alias("score")).where("score is not null")
    order = Window.partitionBy(*by, "u").orderBy(F.desc("score"), F.asc("i"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, "u", "rank", "i", "score")


PAIRS_A_TASK = 50_000_000  # of which hashed_top_k() makes the hashes in one task
BLOCK = 1_000, 50_000  # users and items that meet in one row of it at most
TILE = 32_768  # pairs hashed at once


def every_pair_top_k(users: DataFrame, items: DataFrame, score: Column, k: int, seen: DataFrame) -> DataFrame:
    """Top-N where ``score``, an expression of u and i, is known for every pair.

    The pairs are made where each user is, and ranked there without a shuffle; a user's best k + (items seen) are all
    that can matter, so only these, not the product, meet the seen items.
    """
    mine = users.select("u").distinct().join(seen.groupBy("u").agg(F.count(F.lit(1)).alias("_n")), "u", "left")
    pairs = mine.crossJoin(F.broadcast(items.select("i"))).withColumn("score", F.round(score, DIGITS))  # asked for: scores of all pairs
    order = Window.partitionBy("u").orderBy(F.desc("score"), F.asc("i"))
    best = pairs.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= F.coalesce("_n", F.lit(0)) + k)
    return top_k(best.select("u", "i", "score"), k, seen)


def hashed_top_k(users: DataFrame, items: DataFrame, seed: int, k: int, seen: DataFrame) -> DataFrame:
    """every_pair_top_k() of hashed_uniform(seed, u, i), without a sort or a shuffle of the product.

    Every pair is hashed, in blocks of users by blocks of items, and goes on only if its score reaches a bound that some 5 k items of a user reach. The
    bound decides the work alone: a user with k unseen items over it has its list; for others (nearly everything seen) all pairs are ranked.
    """
    own, catalogue = users.select("u").distinct(), items.select("i").distinct()
    n_users, n_items = own.count(), catalogue.count()
    if n_items <= 10 * k:
        return every_pair_top_k(own, catalogue, hashed_uniform(seed, F.col("u"), F.col("i")), k, seen)
    low = int((1 - 5 * k / n_items) * 2**32)

    def dealt(rows: DataFrame, key: str, n: int, most: int) -> DataFrame:
        return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(-(-n // most))).alias(f"_{key}")).agg(F.collect_list(key).alias(key))

    def hashes(batches):
        for batch in batches:
            for us, those in zip(batch.column("u"), batch.column("i")):
                us, those = us.values.to_numpy(), those.values.to_numpy()
                tails = by_length(those)
                for own, heads in by_length(us, f"{seed}:", ":"):
                    for ids, texts in tails:
                        for at in range(0, len(ids), TILE):
                            tail, step = texts[at : at + TILE], max(1, TILE // len(texts))
                            for first in range(0, len(own), step):
                                word = first_words(heads[first : first + step], tail)
                                x, y = np.nonzero(word >= low)
                                columns = us[own[first + x]], those[ids[at + y]], word[x, y] / 2.0**32
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "i", "score"])

    many = own.sparkSession.sparkContext.defaultParallelism
    cells = dealt(own, "u", n_users, max(1, min(BLOCK[0], n_users // (4 * many)))).crossJoin(F.broadcast(dealt(catalogue, "i", n_items, BLOCK[1])))
    n = max(4 * many, -(-n_users * n_items // PAIRS_A_TASK))
    met = cells.repartition(n).select("u", "i")
    if name := java_function(own.sparkSession, "FirstWords", java_source(), f"array<{HIT}>"):
        hits = met.select(F.call_function(name, "u", "i", F.lit(f"{seed}:"), F.lit(low).cast("long")).alias("l"))
        best = hits.select(F.explode("l").alias("h")).select("h.u", "h.i", (F.col("h.w") / F.lit(2.0**32)).alias("score"))
    else:
        best = met.mapInArrow(hashes, "u long, i long, score double")
    lists = settle(top_k(best, k, seen))
    clear = F.min("score") > low / 2**32 + 10.0 ** (1 - DIGITS)  # no pair under the bound is rounded up to it
    full = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), clear.alias("clear")).where((F.col("n") == k) & F.col("clear"))
    short = settle(own.join(full, "u", "left_anti"))
    if not short.take(1):
        return lists
    rest = every_pair_top_k(short, catalogue, hashed_uniform(seed, F.col("u"), F.col("i")), k, seen)
    return lists.join(short, "u", "left_anti").select(*lists.columns).unionByName(rest)


def item_scores_top_k(users: DataFrame, scores: DataFrame, k: int, seen: DataFrame) -> DataFrame:
    """Top-N where every user has the same item scores (i, score).

    Of a user's best k unseen items each is among the best k + (items seen), so a user only meets that many items of the
    ordered list, not the catalogue: the shared list is cut at k plus the longest history, and ranked once.
    """
    mine = users.select("u").join(seen.groupBy("u").agg(F.count(F.lit(1)).alias("_n")), "u", "left")
    mine = mine.withColumn("_n", F.coalesce("_n", F.lit(0)) + k)
    longest = mine.agg(F.max("_n")).first()[0] or 0
    best = scores.select("i", F.round(finite(F.col("score")), DIGITS).alias("score")).where("score is not null").orderBy(F.desc("score"), F.asc("i")).limit(int(longest))
    place = best.withColumn("_p", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("i"))))  # of the cut list only
    pairs = mine.select("u", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_p")).join(place, "_p")
    return top_k(pairs.select("u", "i", "score"), k, seen)


def filled_top_k(own: DataFrame, users: DataFrame, fill: DataFrame, k: int, seen: DataFrame, offset: DataFrame | None = None, by: DataFrame | None = None) -> DataFrame:
    """Top-N where every pair has a score: ``own`` (u, i, score) where there is one, else ``offset`` (u, c; 0 without) plus the item's ``fill`` (i, score; 0 without that column).

    No product of users and items: a user meets as many items of the ordered fill as it has own and seen ones, and k. Where fill has no
    scores, users with k better own ones meet none. ``by`` (a small table of settings): lists apart for each of its rows, whose columns own has too.
    """
    names = tuple(by.columns) if by is not None else ()
    keys, flat = [*names, "u"], "score" not in fill.columns
    count = lambda rows, on, name: rows.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    own = own.select(*keys, "i", F.round(finite(F.col("score")), DIGITS).alias("score")).where("score is not null")
    who = users.select("u").distinct()
    who = who.join(offset, "u", "left").withColumn("c", F.coalesce("c", F.lit(0.0))) if offset is not None else who.withColumn("c", F.lit(0.0))
    who = who.crossJoin(F.broadcast(by)) if by is not None else who  # settings, a few rows
    better = exclude(own, seen)
    if flat:
        good = count(better.join(who, keys).where(F.col("score") > F.round("c", DIGITS)), keys, "_good")
        who = who.join(good, keys, "left").where(F.coalesce("_good", F.lit(0)) < k).drop("_good")
    who = who.join(count(own, keys, "_own"), keys, "left").join(count(seen, ["u"], "_seen"), "u", "left")
    who = who.select(*keys, "c", (F.coalesce("_own", F.lit(0)) + F.coalesce("_seen", F.lit(0)) + k).cast("int").alias("_n"))
    score = F.lit(0.0) if flat else F.round(finite(F.col("score")), DIGITS)
    line = fill.select("i", score.alias("f")).where("f is not null").withColumn("_key", F.struct((-F.col("f")).alias("f"), "i"))
    line = running(line, "_key", F.lit(1), "_p").select("i", "f", (F.col("_p") + 1).cast("int").alias("_p"))
    met = who.select(*keys, "c", F.explode(F.sequence(F.lit(1), "_n")).alias("_p")).join(line, "_p").join(own.select(*keys, "i"), [*keys, "i"], "left_anti")
    rows = better.select(*keys, "i", "score").unionByName(met.select(*keys, "i", (F.col("c") + F.col("f")).alias("score")))
    return top_k(rows, k, seen, names)
