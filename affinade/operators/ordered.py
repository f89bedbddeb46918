"""Running sums over a whole table's order without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinade.operators.baselines import settle

PART_BITS = 33  # monotonically_increasing_id keeps the partition above these


def running(df: DataFrame, by: str, weight: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` over the rows before each, in ascending order of ``by`` (distinct values).

    Rows are range-sorted; a range sums its own, and the sums of the ranges before, one number each, come from the driver.
    """
    placed = df.withColumn("_w", weight.cast("long")).repartitionByRange(by).sortWithinPartitions(by)
    placed = settle(placed.withColumn("_m", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_m", PART_BITS).cast("int"))
    sums = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.sum("_w").alias("n")).collect()}
    before, total = [], 0
    for part in range(max(sums, default=0) + 1):
        before.append(total)
        total += sums.get(part) or 0
    line = Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.element_at(F.array(*(F.lit(n).cast("long") for n in before)), F.col("_part") + 1)
    return placed.withColumn(name, offset + F.coalesce(F.sum("_w").over(line), F.lit(0))).drop("_w", "_m", "_part")
