"""Bulk-synchronous best-fit packing.

Pieces and gaps are tables, and all matching is done in rounds of distributed sweeps over range-sorted rows. Bands of lengths
come one after the other, longest first. In a band:

* A tight sweep sorts pieces and gaps together, largest first. Reading downwards, a gap opens a bracket and a piece closes the one
  opened last: its successor, the smallest gap at least as long that no longer piece, nor one of lower rank among equals, has
  taken. Every range matches its own brackets; what it leaves meets the other ranges' by nesting level, which running
  sums over the ranges give. So each piece gets one gap at most and each gap one piece, as if one task had swept all.
* Gaps that hold several pieces of the band take them by the running volume: pieces and gaps lie on one line, a piece goes to the gap on whose
  stretch it begins, and stretches are shorter than gaps by what the last piece may stick out.
* Where sweeps place little, as many sequences as the rest needs are opened, filled the same way, and swept again.

A placement is stored as one table of the pieces, the placed ones among them, and of the gaps after it: one shuffle by sequence, no
join. The driver keeps something of every job, so a round has few of them. Only a few numbers per range and round reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinade.llm.common import RANGE_ROWS, in_small_batches, lookup, store
from affinade.llm.word_codec import codec, slices

EVEN = 9  # so many bands hold exactly k pieces a sequence, capacity / k being their top; in the narrower ones below, pieces fill sequences by volume
NARROWER = (10, 32, 256)  # capacity / k of those
LITTLE = 4  # sweeps that place less than 1 of so many pieces are the last ones before sequences are opened


def bands(capacity: int) -> list[tuple[int, int]]:
    """(least, largest) length of each band, longest first."""
    tops = sorted({capacity // k for k in (*range(1, EVEN + 1), *NARROWER)} - {0} | {1}, reverse=True)
    return [(low + 1, top) for top, low in zip(tops, [*tops[1:], 0])]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32; only documents over ``capacity`` are cut."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        c = codec(tokenizer_path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            owner, piece, start, length, crc = [], [], [], [], []
            for a, b in slices([len(t or "") for t in texts]):
                for row, raw in enumerate(c.encode(texts[a:b]), a):
                    ids = np.concatenate([np.frombuffer(raw, c.dtype).astype("<u4"), end])
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        owner.append(row)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def swept(df: DataFrame, keys: list[Column], n: int, work: Callable[[int, pa.Table], pa.Table], schema: str, label: str) -> DataFrame:
    """``df`` sorted into ``n`` ranges and each worked on as a whole, in order; stored. A range has some RANGE_ROWS narrow rows."""

    def run(batches):
        rows = list(batches)
        if rows:
            yield from work(TaskContext.get().partitionId(), pa.Table.from_batches(rows)).to_batches()

    return store(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema), label)


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def before(rows: DataFrame, *sums: str) -> list[dict[int, int]]:
    """For each column, by range: its sum over all ranges before, and under -1 over all. A range's sums are in its row of id -1."""
    found = sorted(rows.where("id < 0").select("pid", *sums).collect(), key=lambda r: r["pid"])
    out = []
    for c in sums:
        offsets, total = {}, 0
        for r in found:
            offsets[r["pid"]] = total
            total += r[c]
        out.append(offsets | {-1: total})
    return out


def after(offsets: dict[int, int]) -> Column:
    return lookup({k: v for k, v in offsets.items() if k >= 0}, F.col("pid"))


def tight(pieces: DataFrame, gaps: DataFrame, n: int, others: bool = False) -> DataFrame:
    """One sweep of ``pieces`` (_row, length) over ``gaps`` (seq, gap): _row, length, seq, gap of those that got one; the ``others`` with null."""
    both = gaps.select(F.lit(1).alias("sign"), F.col("gap").alias("size"), F.col("seq").alias("id")).union(pieces.select(F.lit(-1), "length", "_row"))

    def match(pid: int, t: pa.Table) -> pa.Table:
        sign, size, own = (column(t, c) for c in ("sign", "size", "id"))
        depth = np.cumsum(sign, dtype=np.int64)
        level = np.where(sign > 0, depth, depth + 1)
        order = np.argsort(level, kind="stable")
        one, two = order[:-1], order[1:]
        hit = (level[one] == level[two]) & (sign[one] > 0) & (sign[two] < 0)
        gap, piece = one[hit], two[hit]
        free = np.ones(len(sign), bool)
        free[gap] = free[piece] = False
        loose = np.flatnonzero(free)
        nothing = np.full(len(loose), -1, np.int64)
        columns = [
            np.concatenate([np.zeros(len(piece), np.int64), sign[loose], depth[-1:]]), np.concatenate([own[piece], own[loose], [-1]]), np.concatenate([size[piece], size[loose], [0]]),
            np.concatenate([own[gap], nothing, [-1]]), np.concatenate([size[gap], nothing, [-1]]), np.concatenate([np.zeros(len(piece), np.int64), level[loose], [0]]),
        ]
        return pa.table([pa.array(np.full(len(columns[0]), pid, np.int32)), *(pa.array(c.astype(np.int64)) for c in columns)], names=["pid", "sign", "id", "size", "seq", "gap", "level"])

    keys = [F.desc("size"), F.desc("sign"), F.asc("id")]
    found = swept(both, keys, n, match, "pid int, sign long, id long, size long, seq long, gap long, level long", "tight")
    (net,) = before(found, "sign")  # matched pairs cancel out
    loose = found.where("id >= 0 and sign <> 0").withColumn("level", F.col("level") + after(net))
    line = Window.partitionBy("level").orderBy("pid", "sign")  # at a level a range leaves one piece and then one gap at most
    last = lambda c: F.lag(c).over(line)
    met = loose.withColumns({"seq": F.when(last("sign") > 0, last("id")), "gap": F.when(last("sign") > 0, last("size"))}).where("sign < 0")
    take = lambda d: d.select(F.col("id").alias("_row"), F.col("size").alias("length"), "seq", "gap")
    return take(found.where("id >= 0 and sign = 0")).union(take(met if others else met.where("seq is not null")))


def measured(pid: int, t: pa.Table) -> pa.Table:
    """A range's rows with the sums of ``measure`` and ``size`` over those before each; last a row of id -1 with its own sums."""
    own, size, measure = (column(t, c).astype(np.int64) for c in ("id", "size", "measure"))
    sums = [np.cumsum(v) - v for v in (measure, size)]
    columns = [np.append(v, last) for v, last in zip((own, size, measure, *sums), (-1, size.sum(), measure.sum(), 0, 0))]
    return pa.table([pa.array(np.full(len(columns[0]), pid, np.int32)), *map(pa.array, columns)], names=["pid", "id", "size", "measure", "at", "ahead"])


MEASURED = "pid int, id long, size long, measure long, at long, ahead long"


def piece_line(pieces: DataFrame, by_number: bool, n: int) -> tuple[DataFrame, Column, Column]:
    """Pieces, longest first, with their places in their range, and what to add to ``at`` and ``ahead`` for the whole line."""
    one = pieces.select(F.col("_row").alias("id"), F.col("length").alias("size"), (F.lit(1) if by_number else F.col("length")).cast("long").alias("measure"))
    one = swept(one, [F.desc("size"), F.asc("id")], n, measured, MEASURED, "piece-line")
    at, ahead = before(one, "measure", "size")
    return one.where("id >= 0"), F.col("at") + after(at), F.col("ahead") + after(ahead)


def fill_new(pieces: DataFrame, first: int, many: int, capacity: int, top: int, by_number: bool, n: int) -> DataFrame:
    """fill() for ``many`` new sequences from number ``first`` on: their stretches are alike, so a piece's place tells its sequence. Null for the other pieces."""
    one, at, ahead = piece_line(pieces, by_number, n)
    number = F.floor(at / (capacity // top if by_number else capacity - top + 1)).cast("long")
    rows = one.select(F.col("id").alias("_row"), F.col("size").alias("length"), number.alias("n"), ahead.alias("ahead"))
    return rows.select("_row", "length", F.when(F.col("n") < many, F.col("n") + first).alias("seq"), F.lit(capacity).cast("long").alias("gap"), "ahead")


def fill(pieces: DataFrame, gaps: DataFrame, top: int, by_number: bool, n: int) -> DataFrame:
    """Pieces (_row, length) of ``top`` at most into ``gaps`` (seq, gap), several to a gap: _row, length, seq, gap, ahead; seq and gap null of those for which there is no gap.

    Gaps, smallest first, and pieces, longest first, lie on one line; the measure is the number of pieces, or their length.
    """
    room = F.floor(F.col("gap") / top) if by_number else F.col("gap") - (top - 1)
    one, at, ahead = piece_line(pieces, by_number, n)
    two = gaps.select(F.col("seq").alias("id"), F.col("gap").alias("size"), room.cast("long").alias("measure"))
    two = swept(two, [F.asc("size"), F.asc("id")], n, measured, MEASURED, "gap-line")
    (at_two,) = before(two, "measure")
    on_line = one.select(F.lit(1).alias("kind"), at.alias("at"), "id", "size", ahead.alias("ahead"))
    placed, over = on_line.where(F.col("at") < at_two[-1]), on_line.where(F.col("at") >= at_two[-1])
    line = two.where("id >= 0").select(F.lit(0).alias("kind"), (F.col("at") + after(at_two)).alias("at"), "id", "size", F.lit(0).cast("long").alias("ahead")).union(placed)

    def met(pid: int, t: pa.Table) -> pa.Table:
        kind, own, size, ahead_ = (column(t, c) for c in ("kind", "id", "size", "ahead"))
        gap = np.maximum.accumulate(np.where(kind == 0, np.arange(len(kind)), -1))
        piece = np.flatnonzero(kind == 1)
        mine = gap[piece]
        seq, of = np.where(mine >= 0, own[mine], -1), np.where(mine >= 0, size[mine], -1)
        rows = [own[piece], size[piece], seq, of, ahead_[piece]]
        if gap[-1] >= 0:  # one more row tells the ranges that follow which gap they begin in
            rows = [np.append(r, v) for r, v in zip(rows, (-1, 0, own[gap[-1]], size[gap[-1]], 0))]
        return pa.table([pa.array(np.full(len(rows[0]), pid, np.int32)), *(pa.array(r.astype(np.int64)) for r in rows)], names=["pid", "_row", "length", "seq", "gap", "ahead"])

    found = swept(line, [F.asc("at"), F.asc("kind")], n, met, "pid int, _row long, length long, seq long, gap long, ahead long", "line")
    seqs, sizes, last = {}, {}, None
    tails = {r["pid"]: r for r in found.where("_row < 0").collect()}  # a row per range
    for pid in range(n):
        if last is not None:
            seqs[pid], sizes[pid] = last["seq"], last["gap"]
        last = tails.get(pid, last)
    own = lambda c, carried: F.when(F.col("seq") >= 0, F.col(c)).otherwise(lookup(carried, F.col("pid"))) if carried else F.col(c)
    nowhere = F.lit(None).cast("long")
    rows = found.where("_row >= 0").select("_row", "length", own("seq", seqs).alias("seq"), own("gap", sizes).alias("gap"), "ahead")
    return rows.union(over.select("id", "size", nowhere, nowhere, "ahead"))


def settled(pieces: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    """A placement as one stored table: kind 1, ``pieces`` with seq and offset, null if not placed; kind 0, ``gaps`` with what is left of them.

    ``ahead`` is a piece's place on a line on which the first piece of a sequence begins its gap.
    """
    none = F.lit(None).cast("long")
    rows = pieces.select(F.lit(1).alias("kind"), F.col("_row").alias("id"), F.col("length").alias("size"), "seq", "gap", "ahead")
    rows = rows.union(gaps.select(F.lit(0), "seq", "gap", "seq", none, none))
    rows = rows.withColumn("key", F.coalesce("seq", -1 - F.col("id")))  # pieces without a sequence are spread
    whole, piece = Window.partitionBy("key"), F.col("kind") == 1  # at most ``capacity`` pieces
    used = F.coalesce(F.sum(F.when(piece, F.col("size"))).over(whole), F.lit(0))
    offset = capacity - F.col("gap") + F.col("ahead") - F.min("ahead").over(whole)
    rows = rows.select("kind", "id", F.when(piece, F.col("size")).otherwise(F.col("size") - used).alias("size"), F.when(piece, F.col("seq")).alias("seq"), F.when(piece & F.col("seq").isNotNull(), offset).alias("offset"))
    return store(rows.where("size > 0"), "settled")


def pack(pieces: DataFrame, capacity: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Give every piece its ``sequence_id`` and ``offset``; ``pieces`` needs doc_id, piece and length.

    Which of equal pieces goes where follows the order of the stored table; repeated rows and null ids are packed like
    any other; an empty table gives an empty result. A length of null, below 1 or over ``capacity`` is an error. Further
    columns are kept, but for ``_row``, ``seq`` and the two results' names.
    """
    spark = pieces.sparkSession
    bad = F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity)
    checked = pieces.withColumn("length", F.when(~bad, F.col("length")).otherwise(F.raise_error(F.lit("a piece's length is out of bounds"))))
    checked = store(checked.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    every = checked.select("_row", F.col("length").cast("long").alias("length"))
    gaps = spark.createDataFrame([], "seq long, gap long")
    opened, done = 0, []
    every_band = bands(capacity)
    within = [F.col("length").between(low, top) for low, top in every_band]
    sizes = every.agg(*(f for w in within for f in (F.count_if(w), F.coalesce(F.sum(F.when(w, F.col("length"))), F.lit(0))))).first()
    used = [(*band, sizes[2 * k], sizes[2 * k + 1]) for k, band in enumerate(every_band) if sizes[2 * k]]

    def placed(rows: DataFrame, gaps: DataFrame, *of: tuple[int, int]) -> tuple[DataFrame, DataFrame, int, int, list[int]]:
        """Note where pieces went; the pieces and gaps after it, the former's number and volume, and for each band ``of`` how many gaps hold a piece, and two."""
        state = settled(rows, gaps, capacity)
        done.append(state.where("kind = 1 and seq is not null").select(F.col("id").alias("_row"), "seq", "offset"))
        loose, gap = (F.col("kind") == 1) & F.col("seq").isNull(), F.col("kind") == 0
        fit = [F.count_if(gap & (F.col("size") >= least)) for low, top in of for least in (low, 2 * top)]
        n_left, volume, *fits = state.agg(F.count_if(loose), F.coalesce(F.sum(F.when(loose, F.col("size"))), F.lit(0)), *fit).first()
        return state.where(loose).select(F.col("id").alias("_row"), F.col("size").alias("length")), state.where(gap).select(F.col("id").alias("seq"), F.col("size").alias("gap")), n_left, volume, fits

    fits = [0] * 4  # gaps that hold a piece of the band, and two; then the same of the next band
    for k, (low, top, n_left, volume) in enumerate(used):
        by_number, left, fits = top >= capacity // EVEN, every.where(F.col("length").between(low, top)), fits[2:]
        of = [(low, top), used[min(k + 1, len(used) - 1)][:2]]
        while n_left:
            n, n_before = 1 + (n_left + fits[0]) // range_rows, n_left
            if fits[1]:
                left, gaps, n_left, volume, fits = placed(fill(left, gaps.where(F.col("gap") >= 2 * top), top, by_number, n), gaps, *of)
            if n_left and fits[0]:
                rows = tight(left, gaps.where(F.col("gap") >= low), n, others=True).withColumn("ahead", F.lit(0).cast("long"))
                left, gaps, n_left, volume, fits = placed(rows, gaps, *of)
            if not n_left or n_before - n_left > n_before // LITTLE:
                continue
            need = -(-n_left // (capacity // top)) if by_number else -(-volume // capacity)
            fresh = spark.range(opened, opened + need).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))
            rows = fill_new(left, opened, need, capacity, top, by_number, 1 + n_left // range_rows)
            opened += need
            left, gaps, n_left, volume, fits = placed(rows, gaps.union(fresh), *of)
    if not done:
        return pieces.limit(0).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    where = done[0]
    for rows in done[1:]:
        where = where.union(rows)
    return checked.join(where, "_row").select(*pieces.columns, F.col("seq").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty (one piece with the end id only); very long texts are cut into pieces of ``capacity``; repeated
    rows and null ids are packed like any other; an empty table gives an empty result; other columns aren't read.
    """
    return pack(token_pieces(docs, tokenizer_path, end_id, capacity), capacity)
