"""Helpers that several operators share: tables, shared scratch folders, global order."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_ROWS = 1000
RANGE_ROWS = 200_000  # of a range partition
BIT_ROWS = 15  # a bitmap of bitmap_construct_agg has 2**15 bits
ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this bit
_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; set here only where unset and local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"/tmp/checkpoints/{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; delete() removes what was handed out."""
    path = f"{shared_root(spark)}/affinade/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _scratch:
        _scratch.remove(path)


def handed_out() -> list[str]:
    """The scratch paths that were handed out and not deleted."""
    return list(_scratch)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete a written scratch table when it ends, if nothing does so before."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key``, a number of monotonically_increasing_id, is in the same column of ``ids``, a stored table.

    ``df`` may be wide: it isn't shuffled, whatever its size. The ids become bitmaps of up to 2**BIT_ROWS rows each; these are broadcast,
    a bit for each row of ``df`` at most.
    """
    chunk, place = F.shiftright(key, BIT_ROWS), F.col(key).bitwiseAND((1 << BIT_ROWS) - 1)
    bits = ids.select(chunk.alias("_chunk"), place.alias("_place")).groupBy("_chunk")
    bits = bits.agg(F.substring(F.bitmap_construct_agg("_place"), F.lit(1), F.max(F.shiftright("_place", 3)).cast("int") + 1).alias("_bits"))
    of_row = df.withColumn("_chunk", chunk).join(F.broadcast(store(bits, "bits")), "_chunk")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return of_row.where(F.getbit(byte, place.bitwiseAND(7)) == 1).drop("_chunk", "_bits")


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, which carries whole texts, with the session's Arrow batches cut to TEXT_ROWS rows (never widened).

    A batch is in memory on both sides of each running task, so its rows times the texts' length must stay small.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > TEXT_ROWS:
        df.sparkSession.conf.set(key, TEXT_ROWS)
    return df


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def globally_ordered(df: DataFrame, keys: list, label: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Range-sort a stored narrow table.

    Returns it with ``_pid`` (range partition, ascending) and ``_pos`` (place in it), read back from the
    shared folder so that both stay the same however often it is read. The ranges' number grows with the data: each
    has about ``rows`` rows. Give a stored table: it is counted, and the range sampler reads it once more.
    """
    n = ranges(df, rows)
    out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    out = store(out.withColumn("_m", F.monotonically_increasing_id()), label)
    pid, pos = F.shiftright("_m", ROW_BITS).cast("int"), F.col("_m").bitwiseAND((1 << ROW_BITS) - 1)
    return out.withColumns({"_pid": pid, "_pos": pos}).drop("_m")


def ranges(df: DataFrame, rows: int = RANGE_ROWS) -> int:
    """How many range partitions of about ``rows`` rows a stored table makes."""
    return 1 + df.count() // rows


def partition_offsets(ordered: DataFrame, total: Column) -> dict[int, int]:
    """Sum of ``total`` in all range partitions before each one; a row per partition reaches the driver."""
    rows = ordered.groupBy("_pid").agg(total.cast("long").alias("n")).collect()
    offsets, so_far = {}, 0
    for r in sorted(rows, key=lambda r: r["_pid"]):
        offsets[r["_pid"]] = so_far
        so_far += r["n"] or 0
    return offsets


def lookup(offsets: dict[int, int], key: Column) -> Column:
    """A literal array indexed by partition number (as many entries as range partitions)."""
    if not offsets:
        return F.lit(0).cast("long")
    dense, last = [], 0
    for i in range(max(offsets) + 1):
        last = offsets.get(i, last)
        dense.append(last)
    joined = F.lit(",".join(map(str, dense)))
    return F.element_at(F.split(joined, ",").cast("array<bigint>"), key + 1)
