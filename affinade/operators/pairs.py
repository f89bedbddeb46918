"""Joins of rows that share a key, where one key may hold very many of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinade.operators.baselines import settle

HEAVY = 5_000  # rows of a key from which its pairs are cut
BROADCAST = 100_000  # heavy keys that are broadcast at most
SMALL = 1_000_000  # rows of numbers of a table that is sent to all executors at most


def few(rows: DataFrame) -> bool:
    """Whether a stored table has so few rows that it is cheaper to send it to all executors than to shuffle what it is joined with."""
    return rows.count() <= SMALL


def small(rows: DataFrame) -> DataFrame:
    """``rows`` for a join, stored, and sent to all executors if they are few()."""
    kept = settle(rows)
    return F.broadcast(kept) if few(kept) else kept


def pairs(left: DataFrame, right: DataFrame, key: str, heavy: int = HEAVY) -> DataFrame:
    """Every row of ``left`` with every row of ``right`` of the same key, as an inner join gives them.

    A key with n rows on each side makes n * n pairs, which one task would have to make alone. The rows of a key with more than
    ``heavy`` are dealt into blocks, and each pair of blocks is a key of its own; others are joined as they are.
    """
    many = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy)
    many = many.select(key, F.ceil(F.col("_n") / heavy).cast("int").alias("_blocks"))
    n = many.count()
    if not n:
        return left.join(right, key)
    many = F.broadcast(many) if n <= BROADCAST else many

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        cut = rows.join(many, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        block = F.pmod(F.xxhash64(*rows.columns), F.col("_blocks")).cast("int")
        return cut.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")

    return dealt(left, "_l", "_r").join(dealt(right, "_r", "_l"), [key, "_l", "_r"]).drop("_l", "_r")
