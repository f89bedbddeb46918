"""Content-addressed store of token ids.

A rolling hash over a document's ids sets the cuts, so equal passages give equal chunks wherever they stand. Each
distinct chunk is stored once under its digest; a document is a recipe, the list of its chunks' digests;
recipes lie in ascending id order with each document's place in the stream of all ids; a manifest holds a Merkle
root for every recipe segment. Layout of a store at ``path`` (Parquet containers, ids as little-endian bytes):

* ``staged``: what the encoding wrote at once, a row per document: its recipe, and the chunks its task hadn't met before
* ``pack``: ``key`` (digest of the payload), ``payload`` (ids, ``width`` bytes each), every key once
* ``recipes``: ``_pid``, ``_pos``, doc_id, ``start``, ``n_tokens``, ``keys``, ``lens``, ``root``
* ``manifest``: segment, documents, tokens, Merkle root of its recipes' roots, id width
* ``head``: one row, the Merkle root over the segments' roots

Chunks that several tasks met are told apart by their keys and places alone; payloads move once, from ``staged`` to
``pack``, by a hash join that never sorts them. ``staged`` is deleted when the store is whole.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinade.llm.common import delete, globally_ordered, in_small_batches, lookup, partition_offsets
from affinade.llm.word_codec import codec, slices

DIGEST = 16
REACH = 32  # ids the rolling hash sees
SHORTEST, LONGEST, MEAN_BITS = 64, 1024, 8  # ids of a chunk; a cut at 1 of 2**MEAN_BITS places
POLY = 0xEDB88320  # fixed value: the reflected CRC-32 polynomial
PAYLOADS = {"parquet.block.size": 16 << 20, "compression": "zstd"}  # a writing task holds a row group in memory
SEEN = 100_000  # chunk keys a task remembers so as not to send a chunk again


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; a lone node moves up as it is; no leaves: the digest of nothing."""
    level = [digest(b"\x00" + x) for x in leaves]
    if not level:
        return digest(b"")
    while len(level) > 1:
        pairs = [digest(b"\x01" + a + b) for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


@functools.cache
def gear() -> np.ndarray:
    """A random word for each low 16 bits of an id, by rule."""
    return np.random.default_rng(1).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document, the last at its end."""
    h = gear()[ids & 0xFFFF]
    reach = 1
    while reach < REACH and reach < len(h):
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    ends, begin, n = [], 0, len(ids)
    for at in (np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist():
        while at - begin > LONGEST:
            begin += LONGEST
            ends.append(begin)
        if at - begin >= SHORTEST and n - at >= SHORTEST:
            begin = at
            ends.append(at)
    while n - begin > LONGEST:
        begin += LONGEST
        ends.append(begin)
    if begin < n:
        ends.append(n)
    return ends


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo the CRC polynomial, element by element (reflected bits)."""
    a, b = np.broadcast_arrays(a, b)
    out, b = np.zeros(a.shape, np.uint32), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(POLY), np.uint32(0))
    return out


@functools.cache
def powers() -> list[np.ndarray]:
    """Tables of x**(32 i 1024**k), i from 0 to 1023, for k from 0 to 3: what i 1024**k more ids do to a CRC."""
    tables, step = [], np.array([1 << (31 - 1)], np.uint32)  # x
    for _ in range(5):
        step = times(step, step)  # x**32
    for _ in range(4):
        table = np.array([1 << 31], np.uint32)  # 1
        for _ in range(10):
            table = np.concatenate([table, times(table, step)])
            step = times(step, step)
        tables.append(table)
    return tables


def shifted(crc: np.ndarray, ids_after: np.ndarray) -> np.ndarray:
    """A chunk's share of its document's CRC-32 when so many 32-bit ids follow it; the shares' xor is the CRC."""
    out = crc.astype(np.uint32)
    for k, table in enumerate(powers()):
        part = (ids_after >> (10 * k)) & 1023
        if part.any():
            out = times(out, table[part])
    return out


def encode(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """A recipe row per document, with its chunks of which the task had sent none before."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        c = codec(tokenizer_path)
        end = np.array([end_id], dtype=c.dtype).tobytes()
        seen: set[bytes] = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts]):
                n_tokens, recipes, sizes, roots, new, own, payloads = [], [], [], [], [0], [], []
                for raw in c.encode(texts[a:b]):
                    ids = np.frombuffer(raw + end, c.dtype)
                    keys, lens, begin, data = [], [], 0, memoryview(raw + end)
                    for at in cuts(ids):
                        payload = bytes(data[begin * ids.itemsize : at * ids.itemsize])
                        key = digest(payload)
                        keys.append(key)
                        lens.append(at - begin)
                        begin = at
                        if key not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(key)
                            own.append(key)
                            payloads.append(payload)
                    n_tokens.append(len(ids))
                    recipes.append(b"".join(keys))
                    sizes.append(np.array(lens, "<u2").tobytes())
                    roots.append(merkle(keys))
                    new.append(len(own))
                chunks = pa.StructArray.from_arrays([pa.array(own, pa.binary()), pa.array(payloads, pa.binary())], ["key", "payload"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n_tokens, pa.int64()), *(pa.array(x, pa.binary()) for x in (recipes, sizes, roots)), pa.ListArray.from_arrays(pa.array(new, pa.int32()), chunks)],
                    ["doc_id", "n_tokens", "keys", "lens", "root", "chunks"],
                )

    return in_small_batches(docs).mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens long, keys binary, lens binary, root binary, chunks array<struct<key:binary,payload:binary>>")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the store.

    A null text counts as empty (the end id only). Repeated rows and null ids have recipes of their own, null ids
    first; an empty table gives an empty store; very long texts are encoded in parts and stored as many chunks; other
    columns aren't read, so their names don't matter. Texts are tokenized once.
    """
    spark = docs.sparkSession
    rows = encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenizer_path, end_id)
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows.write.options(**PAYLOADS).parquet(f"{path}/staged")
    staged = spark.read.schema(rows.schema).parquet(f"{path}/staged")

    places = staged.select("_row", F.posexplode("chunks.key").alias("_pos", "key"))
    first = places.groupBy("key").agg(F.min(F.struct("_row", "_pos")).alias("f")).select("f._row", "f._pos")
    chunks = staged.select("_row", F.posexplode("chunks").alias("_pos", "c")).select("_row", "_pos", "c.key", "c.payload")
    chunks.join(first.hint("shuffle_hash"), ["_row", "_pos"], "left_semi").select("key", "payload").write.options(**PAYLOADS).parquet(f"{path}/pack")

    recipes = staged.drop("chunks", "_row")
    ordered = globally_ordered(recipes, [F.asc("doc_id"), F.asc("root")], "recipes")
    before = partition_offsets(ordered, F.sum("n_tokens"))
    so_far = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    start = lookup(before, F.col("_pid")) + F.coalesce(F.sum("n_tokens").over(so_far), F.lit(0))
    ordered.withColumn("start", start).write.parquet(f"{path}/recipes")

    width = codec(tokenizer_path).dtype.itemsize
    manifest = segment_roots(spark.read.parquet(f"{path}/recipes")).withColumn("width", F.lit(width))
    manifest.write.parquet(f"{path}/manifest")
    spark.createDataFrame([(head_of(spark.read.parquet(f"{path}/manifest")),)], "root binary").write.parquet(f"{path}/head")
    delete(spark, f"{path}/staged")


def head_of(segments: DataFrame) -> bytearray:
    """Merkle root over the segments' roots in their order; a row per segment reaches the driver."""
    return bytearray(merkle([bytes(r["root"]) for r in segments.select("segment", "root").orderBy("segment").collect()]))


def segment_roots(recipes: DataFrame) -> DataFrame:
    """Per segment (a range partition of RANGE_ROWS recipes or so): Merkle root of its recipes' roots."""

    def run(key, t):
        t = t.sort_by("_pos")
        root = merkle(t["root"].to_pylist())
        n = t["n_tokens"].to_pylist()
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([sum(n)], pa.int64()), pa.array([root], pa.binary())], ["segment", "documents", "tokens", "root"])

    narrow = recipes.select("_pid", "_pos", "root", "n_tokens")
    return narrow.groupBy("_pid").applyInArrow(run, "segment int, documents long, tokens long, root binary")


def entries(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each document, with the ids that follow it; a recipe that isn't its root's is an error."""
    kind = recipes.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            owner, key, after, no = [], [], [], []
            for row, (n, keys, lens, root) in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))):
                each = [keys[i : i + DIGEST] for i in range(0, len(keys), DIGEST)]
                if merkle(each) != root:
                    raise ValueError("a recipe's chunks don't give its root")
                left = n - np.cumsum(np.frombuffer(lens, "<u2"), dtype=np.int64)
                owner += [row] * len(each)
                key += each
                after += left.tolist()
                no += range(len(each))
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in (0, 1, 2)), pa.array(key, pa.binary()), pa.array(after, pa.int64()), pa.array(no, pa.int32())], ["doc_id", "start", "n_tokens", "key", "ids_after", "no"])

    narrow = recipes.select("doc_id", "start", "n_tokens", "keys", "lens", "root")
    return narrow.mapInArrow(run, f"doc_id {kind.simpleString()}, start long, n_tokens long, key binary, ids_after long, no int")


def packs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, payload binary").parquet(f"{path}/pack")


def chunk_checks(chunks: DataFrame, width: int) -> DataFrame:
    """Reads every stored chunk: its key, number of ids, and CRC-32 of them as 32-bit ids; a payload that isn't its key's is an error."""

    def run(batches):
        for batch in batches:
            keys, n, crc = batch.column(0), [], []
            for key, payload in zip(keys.to_pylist(), batch.column(1).to_pylist()):
                if digest(payload) != key:
                    raise ValueError("a chunk's ids don't give its key")
                ids = np.frombuffer(payload, f"<u{width}")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["key", "n", "crc"])

    return chunks.mapInArrow(run, "key binary, n long, crc long")


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the store's files: doc_id, start, n_tokens, ids_crc32.

    Every chunk is read and held against its key, every recipe against its Merkle root, every segment against the
    manifest, the manifest against its head, and every document's length against its chunks; a document's CRC-32 is put
    together from its chunks' by xor of their shifted CRCs, so the ids themselves aren't shuffled again. A key that very
    many documents hold makes rows of some 60 bytes on one side of a join, which adaptive execution splits.
    """
    if not verify(spark, path):
        raise ValueError("the recipes don't give the manifest's Merkle roots")
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    width = (manifest.agg(F.max("width")).first()[0]) or 2
    used = entries(recipes).join(chunk_checks(packs(spark, path), width), "key", "left")
    kind = recipes.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            crc = batch.column(5).to_numpy(zero_copy_only=False)
            share = shifted(crc, batch.column(3).to_numpy(zero_copy_only=False)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 4)), pa.array(share)], ["doc_id", "start", "n_tokens", "n", "share"])

    crc = F.when(F.col("crc").isNotNull(), F.col("crc")).otherwise(F.raise_error(F.lit("a recipe's chunk is missing")))
    shares = used.select("doc_id", "start", "n_tokens", "ids_after", "n", crc.alias("crc")).mapInArrow(run, f"doc_id {kind.simpleString()}, start long, n_tokens long, n long, share long")
    whole = shares.groupBy("doc_id", "start", "n_tokens").agg(F.sum("n").alias("n"), F.bit_xor("share").alias("ids_crc32"))
    n = F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's chunks don't give its length")))
    return whole.select("doc_id", "start", n.alias("n_tokens"), "ids_crc32")


def verify(spark: SparkSession, path: str) -> bool:
    """True if every segment's recipes give the manifest's Merkle root, counts included, and the segments its head's."""
    now = segment_roots(spark.read.parquet(f"{path}/recipes"))
    kept = spark.read.parquet(f"{path}/manifest").drop("width")
    odd = now.withColumn("_n", F.lit(1)).union(kept.withColumn("_n", F.lit(-1))).groupBy(now.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    head = spark.read.parquet(f"{path}/head").first()[0]
    return odd.isEmpty() and bytes(head) == bytes(head_of(kept))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents put together again: doc_id, start, ids. One document's ids must fit a task."""
    width = (spark.read.parquet(f"{path}/manifest").agg(F.max("width")).first()[0]) or 2
    used = entries(spark.read.parquet(f"{path}/recipes")).join(packs(spark, path), "key")
    parts = F.array_sort(F.collect_list(F.struct("no", "payload")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["payload"]))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(p, f"<u{width}").astype(np.int64) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    kind = used.schema["doc_id"].dataType
    return used.groupBy("doc_id", "start").agg(joined.alias("p")).mapInArrow(run, f"doc_id {kind.simpleString()}, start long, ids array<long>")
