"""Exact top-k search by inner product with pivot-table elimination.

The index keeps, beside each vector, its distances to fixed pivots. For a query, the triangle inequality gives from every
pivot a lower bound of the query's distance to a vector, |d(q, p) - d(x, p)|; the largest over all pivots is the vector's
bound. With both norms it bounds the inner product from above: <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2. Candidates are
evaluated in order of that bound, and the evaluation stops where the next bound lies under the k-th best score so far, so
the result is exact.

Queries and index rows are dealt into blocks of bounded size, and each pair of blocks meets in one task; tasks return
their k best of each query. No vector but the pivots' sample reaches the driver. Scores are whole numbers throughout: products that may leave the
whole numbers that floating point holds are taken in 64 bits, and those that may leave these, in integers without a limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinade.llm.common import store

PIVOTS, SAMPLE = 32, 2_000  # pivots are chosen among so many rows at most; every row is indexed
QUERY_BLOCK, INDEX_BLOCK = 4_096, 65_536  # rows of a block on average
BATCH = 8192  # rows of the index looked at together
FIRST_STEP = 256  # candidates evaluated before the first look at the stopping rule; doubled each time


def whole(batch_column: pa.Array, scale: float) -> list[np.ndarray | None]:
    """floor(scale x) of each vector, or None where it is null or has a null or non-finite component."""
    out: list[np.ndarray | None] = []
    lists = batch_column
    valid = lists.is_valid().to_pylist()
    for i, ok in enumerate(valid):
        if not ok:
            out.append(None)
            continue
        v = lists[i].values
        x = np.floor(scale * v.to_numpy(zero_copy_only=False).astype(np.float64)) if v.null_count == 0 else np.array([np.nan])
        out.append(x if np.isfinite(x).all() else None)
    return out


def matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Stored vectors (whole numbers, as doubles) as rows; shorter ones count as if zeros followed."""
    out = np.zeros((len(raw), dim))
    for i, b in enumerate(raw):
        v = np.frombuffer(b, "<f8")
        out[i, : len(v)] = v
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T), 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled row farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def products(x: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    """Integer inner products. Sums of products are at most the vectors' lengths' product, which says what arithmetic is exact."""
    most = np.sqrt(norms * q_norm) * 1.000001
    if most.max(initial=0) < 2**53:
        return (x @ q).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    some = most < 2**62
    for hit, kind in ((some, np.int64), (~some, object)):
        if hit.any():
            exact = [[int(v) for v in row] for row in x[hit]] if kind is object else x[hit].astype(np.int64)
            score = np.array(exact, kind) @ np.array([int(v) for v in q], kind)
            if kind is object and any(abs(int(v)) >= 2**63 for v in score):
                raise ValueError("a score doesn't fit a long")
            out[hit] = score.astype(np.int64)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search_batch(x: np.ndarray, ids: np.ndarray, table: np.ndarray, norms: np.ndarray, q: np.ndarray, q_id: int, q_table: np.ndarray, q_norm: float, least: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The batch's k best for one query among those that may reach ``least``: scores, ids, and how many were evaluated."""
    bound = np.zeros(len(x))
    for p in range(table.shape[1]):  # one pivot after the other raises the bound
        np.maximum(bound, np.abs(table[:, p] - q_table[p]), out=bound)
    slack = 1e-6 * (1 + np.sqrt(norms) + np.sqrt(q_norm)) + 1e-12 * q_table.max(initial=0)  # roundings of the distances never eliminate
    upper = (q_norm + norms - np.maximum(bound - slack, 0) ** 2) / 2 + 1e-6 * (1 + q_norm + norms)
    upper[np.isnan(upper)] = np.inf  # no bound where the norms overflow
    left = np.flatnonzero((upper >= least) & (ids != q_id))
    left = left[np.argsort(-upper[left], kind="stable")]
    scores, kept, step, at = np.zeros(0, np.int64), np.zeros(0, np.int64), FIRST_STEP, 0
    while at < len(left) and upper[left[at]] >= least:
        part = left[at : at + step]
        scores = np.concatenate([scores, products(x[part], norms[part], q, q_norm)])
        kept = np.concatenate([kept, ids[part]])
        top = best(scores, kept, k)
        scores, kept = scores[top], kept[top]
        if len(scores) == k:
            least = max(least, float(scores[-1]))
        at, step = at + step, step * 2
    ok = scores >= least
    return scores[ok], kept[ok], min(at, len(left))


def build_index(rows: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """The stored index: vec_id, vector, table (its distances to the pivots)."""

    def encode(batches):
        for batch in batches:
            keep, raw = [], []
            for i, v in enumerate(whole(batch.column(1), scale)):
                if v is not None:
                    keep.append(i)
                    raw.append(v.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(raw, pa.binary())], ["vec_id", "vector"])

    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null").mapInArrow(encode, "vec_id long, vector binary")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    width = max((len(r["vector"]) // 8 for r in sample), default=0)
    base = matrix([bytes(r["vector"]) for r in sample], width)
    pivots = choose_pivots(base, PIVOTS)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            dim = max([len(b) // 8 for b in raw] + [width])
            x, p = matrix(raw, dim), np.pad(shared.value, ((0, 0), (0, dim - width)))
            d = distances(x, p).astype("<f8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in d], pa.binary())], ["vec_id", "vector", "table"])

    return store(vectors.mapInArrow(measure, "vec_id long, vector binary, table binary"), "pivot-index")


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row where ``is_query`` (over ``vec_id``) holds, its k best others: query_id, rank, vec_id, score.

    Components count as floor(scale x). Rows with a null id, a null vector, or a null or non-finite component take no part;
    a score that doesn't fit a long is an error; shorter vectors count as if zeros followed, very long ones are taken whole; a
    query has no row of its own id among its results; repeated rows each count; an empty table gives an empty result; other
    columns aren't read, so their names don't matter.
    """
    found = searched(build_index(rows, scale, id_col, vector_col), is_query, k)
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc("vec_id"))
    best_ = found.where("vec_id is not null").withColumn("rank", F.row_number().over(order))
    return best_.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def evaluated_share(rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """What part of all pairs of a query and a candidate is evaluated; the pivots eliminate the rest."""
    index = build_index(rows, scale, id_col, vector_col)
    done = searched(index, is_query, k).where("vec_id is null").agg(F.sum("score")).first()[0] or 0
    pairs = index.count() * index.where(is_query).count()
    return done / pairs if pairs else 0.0


def searched(index: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``no`` (a query), query_id, vec_id, score: the k best of each pair of blocks, and how many it evaluated (vec_id null)."""
    queries = store(index.where(is_query).withColumn("no", F.monotonically_increasing_id()), "pivot-queries")
    n_blocks, n_parts = 1 + queries.count() // QUERY_BLOCK, 1 + index.count() // INDEX_BLOCK
    deal = lambda c, n: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # repeated ids and vectors are spread by their places
    left = index.withColumn("part", deal(["vec_id", F.monotonically_increasing_id()], n_parts)).withColumn("block", every(n_blocks))
    right = queries.withColumn("block", deal(["no"], n_blocks)).withColumn("part", every(n_parts))

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return result([], [], [], [])
        raw, asked = one.column("vector").to_pylist(), two.column("vector").to_pylist()
        dim = max(len(b) // 8 for b in raw + asked)
        q, q_ids, no = matrix(asked, dim), two.column("vec_id").to_numpy(), two.column("no").to_numpy()
        q_table, q_norm = tables(two), (q * q).sum(1)
        ids, table = one.column("vec_id").to_numpy(), tables(one)
        scores, kept = [np.zeros(0, np.int64)] * len(q), [np.zeros(0, np.int64)] * len(q)
        least, seen = np.full(len(q), -np.inf), np.zeros(len(q), np.int64)
        for at in range(0, len(raw), BATCH):
            part = slice(at, at + BATCH)
            x, of = matrix(raw[part], dim), np.asfortranarray(table[part])
            norms = (x * x).sum(1)
            for j in range(len(q)):
                s, i, n = search_batch(x, ids[part], of, norms, q[j], int(q_ids[j]), q_table[j], float(q_norm[j]), float(least[j]), k)
                seen[j] += n
                if len(s):
                    s, i = np.concatenate([scores[j], s]), np.concatenate([kept[j], i])
                    top = best(s, i, k)
                    scores[j], kept[j] = s[top], i[top]
                    if len(top) == k:
                        least[j] = scores[j][-1]
        who = np.repeat(np.arange(len(q)), [len(s) for s in scores])
        hits = pa.array(np.concatenate(kept)), pa.array(np.concatenate(scores))
        return pa.concat_tables([result(no[who], q_ids[who], *hits), result(no, q_ids, pa.nulls(len(q), pa.int64()), seen)])

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, "no long, query_id long, vec_id long, score long")


def tables(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("table").to_pylist()), "<f8").reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 0))


def result(*columns) -> pa.Table:
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=["no", "query_id", "vec_id", "score"])
