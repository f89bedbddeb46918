"""User neighbourhoods of every pair where nearly all users have a similarity: no row is made of a similarity or of a candidate.

A block of users meets all others, in order of their numbers and some at a time: their similarities come from matrix products, and of each pair (u, i) of the
block the nearest raters met so far are kept. So a task holds a block's lists and a tile of similarities, however many users there are, and what is shuffled
is the ratings, once a block. The work is that of all candidates, at a few nanoseconds each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinade.functions.columns import EPS

CANDIDATES = 20_000_000  # users times ratings from which blocks are used
SPARSE = 50  # cells a rating at most: in emptier tables few users have a similarity, and rows of those are less work
STATE = 4_000_000  # places of lists that a block holds
TILE = 2_000_000  # similarities that it looks through at once
PART = 250_000  # and of which it makes so many at once when lists are full, as fit a cache
STALE = 1.25  # how much longer than at the last merge the row of those met may be
DEN_EPS = 1e-10
HALF, PLACE = 1 << 30, (1 << 32) - 1  # keys: sign and rounded size above, the place in order of users below


@dataclass(frozen=True)
class Kind:
    """A similarity of users: its name (cosine or pearson), and what makes it reliable."""

    name: str
    min_support: int | None
    beta: float | None


def shape(train: DataFrame) -> tuple[int, int] | None:
    """Users and items of ratings whose neighbourhoods are to be made in blocks; None for few or sparse ones."""
    n, users, items = train.agg(F.count(F.lit(1)), F.count_distinct("u"), F.count_distinct("i")).first()
    return (users, items) if n * users > CANDIDATES and users * items <= SPARSE * n else None


class Block:
    """The ``most`` nearest raters of each pair of a block of users, kept while others are met."""

    def __init__(self, kind: Kind, most: int, n_items: int):
        self.kind, self.most, self.n_items = kind, most, n_items
        self.column: dict[int, int] = {}  # of an item
        self.rows: list[tuple] = []
        self.ids, self.means, self.met, self.ready = [], [], 0, False
        self.asked: list[tuple[int, int]] = []  # cells (user, item) of the block

    def dense(self, items: pa.ListArray, ratings: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Which items a user rated, and how."""
        at = np.repeat(np.arange(len(items)), items.value_lengths().to_numpy())
        found, place = np.unique(items.flatten().to_numpy(), return_inverse=True)
        of = np.array([self.column.setdefault(i, len(self.column)) for i in found.tolist()], dtype=np.int64)[place]
        known, values = np.zeros((2, len(items), self.n_items))
        known[at, of], values[at, of] = 1.0, ratings.flatten().to_numpy()
        return known, values

    def begin(self) -> None:
        users, known, values = (np.concatenate(part) for part in zip(*self.rows))  # in order of users
        self.users, self.known, self.values, self.rows, self.ready = users, known, values, [], True
        size = (self.n_items, len(users), self.most)
        self.key, self.sim, self.r = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        self.least, self.below, self.raters = np.zeros(size[:2], np.int64), np.zeros(size[:2]), np.zeros(self.n_items)
        self.waiting: dict[int, list[tuple]] = {}  # of items whose lists are full: what passed a bar since the last merge
        self.merged = 0  # how many were met then
        self.whole = self.narrow(values)

    def narrow(self, values: np.ndarray) -> bool:
        """Whether all that similarities take of them before a root or division are whole numbers that single precision holds."""
        return bool((values == np.floor(values)).all() and self.n_items * np.abs(values).max(initial=0.0) < 2**12)

    def own(self, users: np.ndarray, items: pa.ListArray, ratings: pa.ListArray) -> None:
        self.rows.append((users, *self.dense(items, ratings)))

    def meet(self, users: np.ndarray, items: pa.ListArray, ratings: pa.ListArray) -> None:
        if not self.ready:
            self.begin()
        step = max(1, TILE // max(len(self.users), self.n_items))
        for at in range(0, len(users), step):
            self.tile(users[at : at + step], *self.dense(items.slice(at, step), ratings.slice(at, step)))

    def sides(self, known: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
        """What similarities() takes of those met: known, values, their squares, and the values' sums of squares."""
        return [known, values, values * values, (values * values).sum(1)]

    def similarities(self, met: list[np.ndarray], own: list[np.ndarray]) -> np.ndarray:
        """A row for each of those met, a column for each of the block; both as sides() gives them."""
        (known, values, squares, size), (has, rated, squared, length) = met, own
        common, dot = known @ has.T, values @ rated.T
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.kind.name == "pearson":
                sx, sy = values @ has.T, known @ rated.T
                vx = np.maximum(common * (squares @ has.T) - sx * sx, 0.0).astype(np.float64)
                vy = np.maximum(common * (known @ squared.T) - sy * sy, 0.0)
                den = np.sqrt(vx * vy)
                sim = np.where(den > EPS, np.clip((common * dot - sx * sy) / den, -1.0, 1.0), 0.0)
            else:
                den = np.sqrt(size.astype(np.float64))[:, None] * np.sqrt(length.astype(np.float64))[None, :]
                sim = np.where(den > EPS, dot / den, 0.0)
        if self.kind.min_support:
            sim[common < self.kind.min_support] = 0.0
        return sim * np.minimum(common, self.kind.beta).astype(np.float64) / self.kind.beta if self.kind.beta else sim

    def tile(self, users: np.ndarray, known: np.ndarray, values: np.ndarray) -> None:
        """Those met beside the block's users. Items whose lists are all full are looked at together: few similarities are over the lowest bar of their user's
        lists, which one comparison for all these items shows; only of these keys are made."""
        kind = np.float32 if self.whole and self.narrow(values) else np.float64
        own = [x.astype(kind) for x in self.sides(self.known, self.values)]
        met = [x.astype(kind) for x in self.sides(known, values)]
        filled = self.least.all(axis=1)
        full, rest = np.flatnonzero(filled), np.flatnonzero(~filled & known.any(0))
        floor = self.least[full].min(0) if len(full) else None
        least = None if floor is None else np.where(floor >> 32 > HALF, ((floor >> 32) - HALF - 1) / 1e9, -np.inf)
        step, passed = max(1, PART // len(self.users)) if len(full) else len(users), []
        for at in range(0, len(users), step):
            part = slice(at, at + step)
            sim = self.similarities([x[part] for x in met], own)
            sim[users[part, None] == self.users[None, :]] = 0.0
            if (negative := sim < 0).any():
                self.below += (negative.astype(kind).T @ met[0][part]).T
            if len(rest):
                key = self.keys(sim, self.met + at + np.arange(len(sim), dtype=np.int64)[:, None])
                for c in rest:
                    rated = np.flatnonzero(known[part, c])
                    if len(rated):
                        self.keep(c, key[rated], sim, rated, values[part][rated, c])
            if least is not None:
                v, a = np.nonzero(sim >= least)
                s = sim[v, a]
                key = self.keys(s, self.met + at + v)
                over = key > floor[a]
                passed.append((at + v[over], a[over], key[over], s[over]))
        self.raters += known.sum(0)
        self.ids.append(users)
        self.means.append(values.sum(1) / known.sum(1))
        self.met += len(users)
        if passed:
            self.pass_bars(full, *(np.concatenate(x) for x in zip(*passed)), known, values)

    def keys(self, sim: np.ndarray, met: np.ndarray) -> np.ndarray:
        """By which a nearer one is larger; 0 without a similarity."""
        size = np.minimum(np.floor(np.abs(sim) * 1e9 + 0.5), HALF - 1).astype(np.int64)
        key = np.where(sim > 0, HALF + size, HALF - 1 - size) << 32 | (PLACE - met)
        key[sim == 0] = 0
        return key

    def pass_bars(self, full: np.ndarray, v: np.ndarray, a: np.ndarray, key: np.ndarray, sim: np.ndarray, known: np.ndarray, values: np.ndarray) -> None:
        """Similarities of those met (v) and the block's (a) wait for the lists whose bar they pass. Lists are merged when the bars are out of date."""
        for c in full:
            some = np.flatnonzero((known[:, c] > 0)[v] & (key > self.least[c][a]))
            if len(some):
                self.waiting.setdefault(c, []).append((a[some], key[some], sim[some], values[v[some], c]))
        if self.met >= STALE * self.merged:
            self.merge()

    def merge(self) -> None:
        for c, found in self.waiting.items():
            a, *rest = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(a.astype(np.uint16) if len(self.users) <= 1 << 16 else a, kind="stable")  # of two bytes: by counting
            self.put(c, a[order], *(x[order] for x in rest))
        self.waiting, self.merged = {}, self.met

    def keep(self, c: int, key: np.ndarray, sim: np.ndarray, rated: np.ndarray, r: np.ndarray) -> None:
        """Of item ``c`` those met and those kept: the nearest stay."""
        bar = self.least[c]
        if len(rated) > 4 * self.most and not bar.all():  # most of them pass: only the nearest of these can stay
            bar = np.maximum(bar, np.partition(key, len(rated) - self.most, axis=0)[len(rated) - self.most] - 1)
        v, a = np.nonzero(key > bar)
        if len(v):
            order = np.argsort(a, kind="stable")
            v, a = v[order], a[order]
            self.put(c, a, key[v, a], sim[rated[v], a], r[v])

    def put(self, c: int, a: np.ndarray, key: np.ndarray, sim: np.ndarray, r: np.ndarray) -> None:
        """New raters of item ``c`` for the users ``a`` (in order) beside those kept: the nearest stay."""
        who, n = np.unique(a, return_counts=True)
        more = int(n.max())
        row, at = np.repeat(np.arange(len(who)), n), self.most + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        shape = (len(who), self.most + more)
        keys, sims, ratings = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape)
        for all_, kept, new in ((keys, self.key, key), (sims, self.sim, sim), (ratings, self.r, r)):
            all_[:, : self.most], all_[row, at] = kept[c][who], new
        best = np.argpartition(keys, more, axis=1)[:, more:]
        self.key[c][who], self.sim[c][who], self.r[c][who] = (np.take_along_axis(x, best, 1) for x in (keys, sims, ratings))
        self.least[c][who] = self.key[c][who].min(1)

    def near(self) -> Iterator[tuple]:
        """Of each item: users with a neighbour in a slot, and their neighbours' ids, means, similarities, ratings and slots, which are 0 where there is none."""
        if not self.ready:
            return
        self.merge()
        ids, means = np.concatenate(self.ids), np.concatenate(self.means)
        others = self.raters[:, None] - self.known.T
        for item, c in self.column.items():
            order = np.argsort(-self.key[c], axis=1)
            key, sim, r = (np.take_along_axis(x[c], order, 1) for x in (self.key, self.sim, self.r))
            up = (sim > 0).sum(1)
            slot = np.arange(1, self.most + 1)[None, :] + np.where(sim < 0, (others[c] - self.below[c] - up)[:, None], 0).astype(np.int64)
            slot = np.where((key > 0) & (slot <= self.most), slot, 0)
            some = np.flatnonzero(slot.any(1))
            if len(some):
                of = PLACE - (key[some] & PLACE)
                of[slot[some] == 0] = 0
                yield item, self.users[some], ids[of], means[of], sim[some], r[some], slot[some]


def blocks(train: DataFrame, kind: Kind, most: int, users: int, items: int, made, schema: str, asked: DataFrame | None = None) -> DataFrame:
    """``made`` (of a Block when all are met: record batches) of every block of users; ``asked`` (u, i): cells that go with their user's block."""
    fair = -(-users // (2 * train.sparkSession.sparkContext.defaultParallelism))
    n = -(-users // max(1, min(STATE // (items * most), fair)))
    lists = train.groupBy("u").agg(F.collect_list(F.struct("i", "r")).alias("l")).select("u", F.col("l.i").alias("i"), F.col("l.r").alias("r"))
    none = F.array().cast("array<long>")
    asked = lists.withColumn("h", none) if asked is None else lists.join(asked.groupBy("u").agg(F.collect_set("i").alias("h")), "u", "left")
    own = asked.select(F.pmod(F.xxhash64("u"), F.lit(n)).cast("int").alias("_a"), F.lit(False).alias("_met"), "u", "i", "r", F.coalesce("h", none).alias("h"))
    met = lists.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_a"), F.lit(True).alias("_met"), "u", "i", "r", none.alias("h"))

    def run(batches):
        block, of = None, None
        for batch in batches:
            a, is_met, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_met", "u"))
            begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (is_met[1:] != is_met[:-1])]) if len(a) else []
            for lo, hi in zip(begin, [*begin[1:], len(a)]):
                if a[lo] != of:
                    if block is not None:
                        yield from made(block)
                    block, of = Block(kind, most, items), a[lo]
                if is_met[lo] and not (block.ready or block.rows):
                    continue  # no user fell into this block
                items_of, ratings, h = (batch.column(c).slice(lo, hi - lo) for c in ("i", "r", "h"))
                (block.meet if is_met[lo] else block.own)(u[lo:hi], items_of, ratings)
                block.asked += zip(np.repeat(u[lo:hi], h.value_lengths().to_numpy()).tolist(), h.flatten().to_pylist())
        if block is not None:
            yield from made(block)

    dealt = own.unionByName(met).repartitionById(n, "_a").sortWithinPartitions("_a", "_met", "u")
    return dealt.mapInArrow(run, schema)


def head_sums(train: DataFrame, kind: Kind, ks: list[int], centrings: list[tuple[bool, float]], users: int, items: int) -> DataFrame:
    """Of every pair with evidence among its largest k: u, i, _s (its first slot), and of each k den_k and of each centring c (whether by the neighbour's mean, liked from)
    num_c_k and aff_c_k."""
    names = [f"{x}_{k}" for k in ks for x in ("den", *(f"{p}_{c}" for c in range(len(centrings)) for p in ("num", "aff")))]

    def made(block: Block):
        for item, own, _, means, sim, r, slot in block.near():
            columns = [own, np.full(len(own), item), np.where(slot > 0, slot, PLACE).min(1)]
            for k in ks:
                s = np.where((slot > 0) & (slot <= k), sim, 0.0)
                columns.append(np.abs(s).sum(1))
                for centre, liked_from in centrings:
                    columns += [(s * (r - means if centre else r)).sum(1), (np.maximum(s, 0.0) * (r >= liked_from)).sum(1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "i", "_s", *names])

    return blocks(train, kind, max(ks), users, items, made, "u long, i long, _s long, " + ", ".join(f"{n} double" for n in names))


def listed(train: DataFrame, kind: Kind, settings: list[tuple[int, bool, float, str]], held: DataFrame, catalogue: DataFrame, n: int, users: int, items: int) -> DataFrame:
    """Lists and predictions of many settings (k, whether centred, liked from, head) at once: setting, u, i, rank, score; rank 0 are predictions of ``held``.

    All users have training rows. Whoever has a block's lists has its users' every cell, so lists are made there, over all items: those without evidence
    score the user's mean (head rating) or 0, and so do items that nobody rated, of which the first ``n`` can matter.
    """
    cold = [r["i"] for r in catalogue.select("i").distinct().join(train.select("i"), "i", "left_anti").orderBy("i").limit(n).collect()]
    most = max(k for k, *_ in settings)

    def made(block: Block):
        if not block.ready:
            return
        where = {u: a for a, u in enumerate(block.users.tolist())}
        base = (block.values.sum(1) / block.known.sum(1))[:, None]
        names = np.array([*block.column, *cold], dtype=np.int64)
        order = np.argsort(names)
        seen = np.hstack([block.known > 0, np.zeros((len(base), len(cold)), bool)])[:, order]
        asked = [(where[u], block.column.get(i, -1), i) for u, i in block.asked]
        a, c, i = np.array(asked, dtype=np.int64).reshape(-1, 3).T
        near = [(block.column[item], np.searchsorted(block.users, own), *rest) for item, own, *rest in block.near()]
        sums: dict[tuple, tuple] = {}
        for k, centre, liked_from, _ in settings:
            if (k, centre, liked_from) in sums:
                continue
            num, den, aff = np.zeros((3, len(base), len(names) + 1))  # the last column: items without a rating
            for at, own, _, means, sim, r, slot in near:
                s = np.where((slot > 0) & (slot <= k), sim, 0.0)
                num[own, at], den[own, at] = (s * (r - means if centre else r)).sum(1), np.abs(s).sum(1)
                aff[own, at] = (np.maximum(s, 0.0) * (r >= liked_from)).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pred = np.where(den > DEN_EPS, num / den + (base if centre else 0.0), base)
            sums[k, centre, liked_from] = pred, num, aff
        for at, (k, centre, liked_from, mode) in enumerate(settings):
            pred, num, aff = sums[k, centre, liked_from]
            score = {"rating": pred, "affinity": aff, "score": num}[mode][:, :-1][:, order]
            score = np.sign(score) * np.floor(np.abs(score) * 1e9 + 0.5) / 1e9
            score[seen] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :n]
            score = np.take_along_axis(score, best, 1)
            u, rank = np.nonzero(score > -np.inf)
            parts = (block.users[u], names[order][best[u, rank]], rank + 1, score[u, rank]), (block.users[a], i, np.zeros(len(a), np.int64), pred[a, c])
            for columns in parts:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(columns[0]), at), *columns)], ["setting", "u", "i", "rank", "score"])

    return blocks(train, kind, most, users, items, made, "setting long, u long, i long, rank long, score double", held)


def near(train: DataFrame, kind: Kind, most: int, users: int, items: int, asked: DataFrame | None = None) -> DataFrame:
    """u, i, nbr, sim, r, slot: the rows of neighbourhood.slots(); of the cells ``asked`` (u, i) only, if given."""
    every = asked is None

    def made(block: Block):
        cells: dict[int, list[int]] = {}
        for u, i in block.asked:
            cells.setdefault(i, []).append(u)
        for item, own, nbr, _, sim, r, slot in block.near():
            at, place = np.nonzero(slot)
            if not every:
                wanted = np.isin(own, cells.get(item, []))[at]
                at, place = at[wanted], place[wanted]
            columns = own[at], np.full(len(at), item), nbr[at, place], sim[at, place], r[at, place], slot[at, place].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "i", "nbr", "sim", "r", "slot"])

    return blocks(train, kind, most, users, items, made, "u long, i long, nbr long, sim double, r double, slot int", asked)


def used(train: DataFrame, kind: Kind, most: int, users: int, items: int) -> DataFrame:
    """The similarities that take part in any pair's neighbourhood (a, b, sim), once for all items (i and slot null); a negative one takes its slot by all candidates'
    signs, so it is given for each pair by itself (i, slot)."""

    def made(block: Block):
        found: list[tuple] = []
        for item, own, nbr, _, sim, _, slot in block.near():
            at, place = np.nonzero((slot > 0) & (sim > 0))
            found.append((own[at], nbr[at, place], sim[at, place]))
            at, place = np.nonzero((slot > 0) & (sim < 0))
            if len(at):
                yield batch(own[at], nbr[at, place], sim[at, place], pa.array(np.full(len(at), item)), pa.array(slot[at, place].astype(np.int32)))
        if found:
            a, b, sim = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((b, a))
            a, b, sim = a[order], b[order], sim[order]
            first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
            n = int(first.sum())
            yield batch(a[first], b[first], sim[first], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()))

    def batch(a, b, sim, i, slot) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim), i, slot], ["a", "b", "sim", "i", "slot"])

    return blocks(train, kind, most, users, items, made, "a long, b long, sim double, i long, slot int")
