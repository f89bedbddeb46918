"""Sharding by proportional stratified interleaving: every shard holds each source in the mixture's share.

Rows are shuffled by a seeded hash within their source, the r-th of n rows of a source stands at (2 r - 1) / 2 n of the whole, and rows in
order of these fractions are cut into shards whose row counts are at most one apart (the law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinade.llm.common import globally_ordered, lookup, partition_offsets, store

LAW = "rows"
BROADCAST = 100_000  # rows of strata by range partition that are broadcast at most
ROW_BYTES = 8  # that a row takes besides its text


def seeded_order(seed: int, doc_id: Column) -> Column:
    """An MD5 of seed and id, so that any engine can repeat the shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def row_key(docs: DataFrame) -> list[Column]:
    """Two hashes that tell rows apart which differ in any column; nulls have a place of their own."""
    values = [c for name in docs.columns for c in (docs[name].isNull(), docs[name])]
    return [F.xxhash64(F.lit(k), *values).alias(f"_key{k}") for k in (1, 2)]


def numbered(ordered: DataFrame) -> tuple[DataFrame, int]:
    """A globally_ordered table with ``_at``, each row's place from 0, and its rows."""
    offsets = partition_offsets(ordered, F.count(F.lit(1)))
    return ordered.withColumn("_at", lookup(offsets, F.col("_pid")) + F.col("_pos")), ordered.count()


def fractions(ordered: DataFrame) -> DataFrame:
    """``_at`` of rows sorted by ``stratum`` becomes ``fraction``, the place of a row's rank within its stratum.

    A stratum is contiguous, so strata by range partition are at most partitions plus strata. Their places are put together
    first, and a row meets those of its own range and stratum only: no stratum, however large, meets in one task.
    """
    parts = ordered.groupBy("_pid", "stratum").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = store(parts, "strata")
    whole = parts.groupBy("stratum").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    places = parts.select("_pid", "stratum").join(whole, "stratum")
    places = F.broadcast(places) if parts.count() <= BROADCAST else places
    rank = F.col("_at") - F.col("first")
    return ordered.join(places, ["_pid", "stratum"]).withColumn("fraction", (2 * rank + 1) / (2 * F.col("n")).cast("double"))


def assign(docs: DataFrame, shards: int, seed: int = 42, by: str = "source", keyed: bool = False) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``stratum``, ``shard``, ``slot`` of every row; ``keyed`` adds row_key()'s columns.

    size: UTF-8 bytes of the text plus 8. Slots count from 0 in each shard, in order of the fractions. A shard holds each
    stratum's share to within a row or two. Null texts count as empty, null sources are a stratum of their own, null ids are
    shuffled as one id; rows of one id stand in order of source and content, so only rows that are alike in all
    that is returned may change places. With fewer rows than shards some shards are empty; an empty table gives none. Columns of docs
    may have any names besides doc_id, text and ``by``. Texts are read whole and stay where they are: hashes and sizes are sorted.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    source = docs[by].cast("string")
    rows = docs.select(
        docs["doc_id"].alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("stratum"), seeded_order(seed, docs["doc_id"]).alias("order"), *(row_key(docs) if keyed else []),
    )
    rows = store(rows, "shard-rows")
    ties = [c for c in rows.columns if c not in ("stratum", "order")]
    first, _ = numbered(globally_ordered(rows, ["stratum", "order", *ties], "by-stratum"))
    kept = [c for c in rows.columns if c != "order"]
    mixed, n = numbered(globally_ordered(store(fractions(first).select(*kept, "fraction"), "fractions"), ["fraction", "stratum"], "interleaved"))
    shard = F.expr(f"CAST(_at * {shards} div {max(n, 1)} AS INT)")
    begin = F.expr(f"(CAST(shard AS BIGINT) * {n} + {shards - 1}) div {shards}")  # the first place of the shard
    out = mixed.withColumn("shard", shard).withColumn("slot", F.col("_at") - begin)
    return out.select("doc_id", "size", "text_crc32", "stratum", "shard", "slot", *(c for c in rows.columns if c.startswith("_key")))


def digest(assigned: DataFrame) -> DataFrame:
    """The contract's columns of assign()'s rows."""
    return assigned.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 42, by: str = "source", file_rows: int = 100_000) -> DataFrame:
    """Write every row of ``docs`` with its ``shard`` and ``slot`` as Parquet, a folder for each shard; returns the table as read back.

    Each file holds a run of some ``file_rows`` slots of one shard in order. Rows that are alike in all columns are interchangeable,
    so texts meet their slots by content: distinct rows once, each with all slots it got. Columns named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    keys = ["_key1", "_key2"]
    once = docs.select(*(docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)), *row_key(docs))
    values = [c for c in once.columns if c not in keys]
    once = once.groupBy(*keys).agg(*(F.first(c).alias(c) for c in values))
    slots = store(assign(docs, shards, seed, by, keyed=True).select("shard", "slot", *keys), "shard-slots")
    rows = slots.join(once, keys).select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)), "shard", "slot")
    files = max(shards, 1 + slots.count() // file_rows)
    rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    schema = T.StructType([*docs.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return docs.sparkSession.read.schema(schema).parquet(path)


def shard_mixture(assigned: DataFrame) -> DataFrame:
    """Rows and bytes of every stratum in every shard, and the stratum's share of the shard's rows."""
    rows = assigned.groupBy("shard", "stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    whole = rows.groupBy("shard").agg(F.sum("n").alias("of"))
    return rows.join(whole, "shard").select("shard", "stratum", "n", "bytes", (F.col("n") / F.col("of")).alias("share"))
