"""Exact similarities of rows that share columns, as one self-join.

A matrix is (a, k, x): row, shared column, value. For item similarities rows are items and columns users, for user
similarities the other way round. Results are (a, b, sim, n_co) for a <> b; pairs without a shared column don't exist.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinade.config import CONFIG
from affinade.functions.columns import EPS
from affinade.operators.pairs import pairs as row_pairs
from affinade.operators.pairs import small

SUMS = ["sx", "sy", "sxx", "syy", "dot"]
SIDE = 1_500  # rows of a block of block_paired()
CHUNK = 1_024  # columns that one of its products takes
DENSE = 20  # how often the rows it sends the pairs of rows must be at least
LISTED = 1_000  # rows of a column that list_paired() puts into a list at most
PART_PAIRS = 2_000_000  # pairs of rows that one of its tasks sums on average
GROUP_ROWS = 2_000_000  # rows that one of its tasks gets on average at most
KINDS = ("cosine", "pearson", "adjusted_cosine")


def by_item(ratings: DataFrame) -> DataFrame:
    return ratings.select(F.col("i").alias("a"), F.col("u").alias("k"), F.col("r").alias("x"))


def by_user(ratings: DataFrame) -> DataFrame:
    return ratings.select(F.col("u").alias("a"), F.col("i").alias("k"), F.col("r").alias("x"))


def centred(matrix: DataFrame) -> DataFrame:
    """Values less their column's mean."""
    means = matrix.groupBy("k").agg(F.avg("x").alias("m"))
    return matrix.join(means, "k").select("a", "k", (F.col("x") - F.col("m")).alias("x"))


def paired(matrix: DataFrame, sums: list[Column]) -> DataFrame:
    """Sums over the shared columns of each pair a < b (half the pairs: every kind is symmetric)."""
    n_rows, n_pairs, most = matrix.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n")), F.max("n")).first()
    blocks = -(-matrix.select("a").distinct().count() // SIDE)
    if blocks > 1 and n_pairs > DENSE * n_rows * blocks and 2 * n_rows <= GROUP_ROWS * blocks:
        return block_paired(matrix, blocks, [SUMS[-1]] if len(sums) < len(SUMS) else SUMS)
    if blocks > 1 and most <= LISTED:
        return list_paired(matrix, sums, n_pairs // 2)
    left = matrix.select(F.col("k"), F.col("a"), F.col("x"))
    right = matrix.select(F.col("k"), F.col("a").alias("b"), F.col("x").alias("y"))
    return row_pairs(left, right, "k").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_co"), *sums)


def list_paired(matrix: DataFrame, sums: list[Column], n_pairs: int) -> DataFrame:
    """paired() where columns have few rows each: every row takes the list of the later rows of its column to where its pairs are summed, and is dealt by itself,
    so that lists are shuffled and pairs aren't."""
    (kind, value), own = packed(matrix), F.struct(F.col("a"), F.col("x"))
    lists = matrix.groupBy("k").agg(F.array_sort(F.collect_list(own)).alias("l"))
    each = lists.select(F.col("l.a").cast(f"array<{kind}>").alias("la"), F.col("l.x").cast(f"array<{value}>").alias("lx"))
    each = each.select("la", "lx", F.posexplode("la").alias("p", "a")).where(F.col("p") + 1 < F.size("la"))
    later = lambda c: F.slice(c, F.col("p") + 2, F.size(c) - F.col("p") - 1).alias(c)
    each = each.select(F.col("a").cast("long").alias("a"), F.get("lx", "p").cast("double").alias("x"), later("la"), later("lx"))
    n = max(matrix.sparkSession.sparkContext.defaultParallelism, -(-n_pairs // PART_PAIRS))
    both = each.repartition(n, "a").select("a", "x", "lx", F.posexplode("la").alias("p", "b"))
    both = both.select("a", F.col("b").cast("long").alias("b"), "x", F.get("lx", "p").cast("double").alias("y"))
    return both.where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_co"), *sums)


def packed(matrix: DataFrame) -> tuple[str, str]:
    """The smallest types that hold the numbers of rows and their values as they are: lists of them are most of what list_paired() shuffles."""
    x = F.col("x")
    low, high, whole = matrix.agg(F.min("a"), F.max("a"), F.bool_and((x == F.floor(x)) & (F.abs(x) < 128))).first()
    return "int" if low is None or -(2**31) <= low and high < 2**31 else "long", "byte" if whole else "double"


def block_paired(matrix: DataFrame, blocks: int, names: list[str]) -> DataFrame:
    """paired() where columns have very many rows: rows are dealt into blocks, and of each two blocks one task makes all sums as matrix products.

    Each row is sent to as many tasks as there are blocks; what is shuffled is far less than the pairs of rows, and pairs themselves aren't.
    """

    def products(group: pa.Table) -> pa.Table:
        a, k, x, own = (group.column(c).to_numpy() for c in ("a", "k", "x", "own"))
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        _, k = np.unique(k, return_inverse=True)
        sides = []
        for block in (low, high):
            mine = own == block
            rows, at = np.unique(a[mine], return_inverse=True)
            sides.append((rows, at, k[mine], x[mine]))
        out = {c: np.zeros((len(sides[0][0]), len(sides[1][0]))) for c in ("n_co", *names)}
        for first in range(0, int(k.max()) + 1, CHUNK):
            tiles = []
            for rows, at, column, value in sides:
                here = (column >= first) & (column < first + CHUNK)
                known, values = np.zeros((2, len(rows), CHUNK))
                known[at[here], column[here] - first], values[at[here], column[here] - first] = 1.0, value[here]
                tiles.append((known, values))
            (m, v), (n, w) = tiles
            parts = {"n_co": (m, n), "sx": (v, n), "sy": (m, w), "sxx": (v * v, n), "syy": (m, w * w), "dot": (v, w)}
            for c in out:
                out[c] += parts[c][0] @ parts[c][1].T
        i, j = np.nonzero(out["n_co"])
        one, two = sides[0][0][i], sides[1][0][j]
        wanted = one < two if low == high else np.full(len(one), True)
        swap = one > two  # of two blocks either may have the smaller row
        i, j, one, two, swap = i[wanted], j[wanted], one[wanted], two[wanted], swap[wanted]
        other = {"sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}
        sums = {c: np.where(swap, out[other.get(c, c)][i, j], out[c][i, j]) for c in out}
        return pa.table({"a": np.minimum(one, two), "b": np.maximum(one, two), "n_co": sums.pop("n_co").astype(np.int64), **sums})

    own = F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int")
    sent = matrix.select("a", "k", "x", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select("a", "k", "x", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    sent = sent.repartition(blocks * (blocks + 1) // 2, "low", "high")
    return sent.groupBy("low", "high").applyInArrow(products, "a long, b long, n_co long, " + ", ".join(f"{c} double" for c in names))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both ways round, from one pass over the pairs."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_w")
    return pairs.select(ways, *rest).select("_w.a", "_w.b", *rest)


def cosine_pairs(matrix: DataFrame) -> DataFrame:
    """Dot product over the shared columns by the norms of the whole rows."""
    return cosine_of(paired(matrix, [F.sum(F.col("x") * F.col("y")).alias("dot")]), squares(matrix))


def squares(matrix: DataFrame) -> DataFrame:
    """a, q: the sum of a row's squares."""
    return matrix.groupBy("a").agg(F.sum(F.col("x") * F.col("x")).alias("q"))


def cosine_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Cosines from pairs' dot products (a, b, dot, n_co) and rows' squares (a, q)."""
    norms = small(rows.select("a", F.sqrt("q").alias("norm")))
    rows = pairs.join(norms, "a").join(norms.select(F.col("a").alias("b"), F.col("norm").alias("norm_b")), "b")
    den = F.col("norm") * F.col("norm_b")
    return rows.select("a", "b", F.when(den > EPS, F.col("dot") / den).otherwise(0.0).alias("sim"), "n_co")


def pair_sums() -> list[Column]:
    x, y = F.col("x"), F.col("y")
    return [F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("dot")]


def pearson_pairs(matrix: DataFrame) -> DataFrame:
    """Correlation over the shared columns only; 0 without variance; within -1 and 1."""
    return pearson_of(paired(matrix, pair_sums()))


def pearson_of(pairs: DataFrame) -> DataFrame:
    """Correlations from pairs' sums (a, b, n_co, sx, sy, sxx, syy, dot)."""
    n = F.col("n_co")
    var = lambda q, s: F.greatest(n * q - s * s, F.lit(0.0))
    den = F.sqrt(var(F.col("sxx"), F.col("sx")) * var(F.col("syy"), F.col("sy")))
    num = n * F.col("dot") - F.col("sx") * F.col("sy")
    sim = F.when(den > EPS, F.least(F.greatest(num / den, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)
    return pairs.select("a", "b", sim.alias("sim"), "n_co")


def reliable(pairs: DataFrame, min_support: int | None = CONFIG.min_support, beta: float | None = CONFIG.beta) -> DataFrame:
    """0 below ``min_support`` shared columns, times min(n, beta) / beta; either step is off when None or 0."""
    sim = F.col("sim")
    if min_support:
        sim = F.when(F.col("n_co") < min_support, 0.0).otherwise(sim)
    if beta:
        sim = sim * F.least(F.col("n_co").cast("double"), F.lit(float(beta))) / F.lit(float(beta))
    return pairs.select("a", "b", sim.alias("sim"), "n_co")


def similarity(matrix: DataFrame, kind: str = "cosine", min_support: int | None = CONFIG.min_support, beta: float | None = CONFIG.beta) -> DataFrame:
    """The two-sided similarity table of a kind, made reliable."""
    if kind not in KINDS:
        raise ValueError(f"unknown similarity {kind!r}; known: {', '.join(KINDS)}")
    pairs = pearson_pairs(matrix) if kind == "pearson" else cosine_pairs(centred(matrix) if kind == "adjusted_cosine" else matrix)
    return mirrored(reliable(pairs, min_support, beta))
