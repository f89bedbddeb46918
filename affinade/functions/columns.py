"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def ratio(num: Column, den: Column, eps: float = EPS) -> Column:
    """num / den, and 0 where den is not above eps."""
    return F.when(den > eps, num / den).otherwise(F.lit(0.0))


def discount(rank: Column) -> Column:
    """What a hit at this rank adds to the discounted gain."""
    return 1 / F.log2(rank + F.lit(1.0))


def self_information(popularity: Column, n_users: Column) -> Column:
    return -F.log2((popularity + 1) / (n_users + 1))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def hashed_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the keys, the same on any engine and partitioning: 8 hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hashed_order(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
