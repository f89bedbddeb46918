"""Filter interaction audit: what each order of five filters removes, by first-failure lookup.

A document fails some of the filters, which is a number of 5 bits. For each such number and each of the 120 orders a table holds the
step at which the document is removed, so one look-up of a row of the table says what happens to it in all orders.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinade.llm.common import in_small_batches, store

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
KEPT = STEPS  # step of a document that no filter removes
PARTS = 256  # in a task's memory; its sums go out when there are more
SLICE = 4096  # documents looked up at once
WORDS = r"[\x20\x09-\x0D]+"


def first_failures() -> np.ndarray:
    """table[failing filters as bits, order]: the step (from 0) that removes the document, or KEPT."""
    letter = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    fails = (np.arange(1 << STEPS)[:, None, None] >> letter[None]) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), KEPT)


def text_failures(text: Column) -> Column:
    """Bits of the filters that the text alone decides: A (few words), B (repeated words), C (capitals), D (symbols)."""
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 100, distinct * 100 < n * 80, capitals * 100 > F.length(text) * 10, text.rlike(r"[#$%&*|]")]
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``fails`` (5 bits), ``good``, ``toxic`` of every row.

    Nulls: a null text is empty, a null language the empty string. A row without an id has no label, fails E never and makes no other
    row fail it; rows of one id and text don't make each other fail E. Of several label rows of an id any 1 counts, labels other than 1 don't.
    Empty tables give no rows (of documents) or no labels; columns besides doc_id, text and lang are not looked at. Texts are read whole and
    stay where they are: what is shuffled is an id and a SHA-256. The join back is by id and digest together, so a text that a third
    of all rows hold is spread.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = store(rows.select("doc_id", "part", text_failures(F.col("text")).alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest")), "filter-bits")
    known, unknown = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    known = known.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    never = F.lit(False)
    fails = F.col("bits") + F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    known = known.select("doc_id", "part", fails.alias("fails"), F.coalesce("good", never).alias("good"), F.coalesce("toxic", never).alias("toxic"))
    return known.union(unknown.select("doc_id", "part", F.col("bits").alias("fails"), never.alias("good"), never.alias("toxic")))


class Sums:
    """A task's sums by part: removed documents by label class, order and step, and documents by failing filters."""

    CLASSES = ("removed", "good_lost", "toxic_lost")
    WIDTH = len(ORDERS) * (STEPS + 1)

    def __init__(self, table: np.ndarray):
        self.places = table + np.arange(len(ORDERS)) * (STEPS + 1)
        self.lost: dict[str, np.ndarray] = {}
        self.masks: dict[str, np.ndarray] = {}

    def add(self, part: np.ndarray, names: list[str], fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> None:
        for lo in range(0, len(fails), SLICE):
            cut = slice(lo, lo + SLICE)
            at = self.places[fails[cut]] + part[cut, None] * self.WIDTH
            size = len(names) * self.WIDTH
            found = [np.bincount(at[rows].ravel(), minlength=size).reshape(len(names), -1) for rows in (slice(None), good[cut], toxic[cut])]
            masks = np.bincount(part[cut] << STEPS | fails[cut], minlength=len(names) << STEPS).reshape(len(names), -1)
            for k, name in enumerate(names):
                lost = np.stack([f[k] for f in found])
                self.lost[name] = self.lost.get(name, 0) + lost
                self.masks[name] = self.masks.get(name, 0) + masks[k]

    def taken(self) -> pa.RecordBatch:
        """The sums as one row a part, which are then forgotten."""
        names = list(self.lost)
        arrays = [pa.array(names, pa.string()), pa.array([self.lost[n].ravel() for n in names], pa.list_(pa.int64())), pa.array([self.masks[n] for n in names], pa.list_(pa.int64()))]
        self.lost, self.masks = {}, {}
        return pa.RecordBatch.from_arrays(arrays, ["part", "lost", "masks"])


def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = Sums(first_failures())
    for batch in batches:
        part = batch.column("part").dictionary_encode()
        codes, names = part.indices.to_numpy(zero_copy_only=False).astype(np.int64), part.dictionary.to_pylist()
        fails = batch.column("fails").to_numpy(zero_copy_only=False).astype(np.int64)
        good, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "toxic"))
        if len(names) <= PARTS:
            sums.add(codes, names, fails, good, toxic)
        else:  # a batch of very many parts: some of them at a time
            for lo in range(0, len(names), PARTS):
                rows = (codes >= lo) & (codes < lo + PARTS)
                sums.add(codes[rows] - lo, names[lo : lo + PARTS], fails[rows], good[rows], toxic[rows])
                yield sums.taken()
        if len(sums.lost) > PARTS:
            yield sums.taken()
    if sums.lost:
        yield sums.taken()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step; see failures() for odd rows.

    kept (after the step), removed (by it), redundant (failing its filter, removed before), unique_fails (failing its filter only), good_lost and
    toxic_lost (removed by it, of that label), shapley (removed by its filter in all orders). Tasks sum what they read by part and
    Spark sums their places, so no part, however large, is gathered. No documents, no parts, no rows.
    """
    rows = in_small_batches(failures(docs, labels)).select("part", "fails", "good", "toxic")
    sums = rows.mapInArrow(partial_sums, "part string, lost array<bigint>, masks array<bigint>")
    return report(sums.select("part", F.posexplode(F.concat("lost", "masks")).alias("place", "n")).groupBy("part", "place").agg(F.sum("n").alias("n")))


def report(sums: DataFrame) -> DataFrame:
    """audit()'s rows from the sums by ``part`` and ``place``; as many rows a part whatever the documents are."""
    width, masks_at = Sums.WIDTH, Sums.WIDTH * len(Sums.CLASSES)
    mask, n = F.col("place") - masks_at, F.col("n")
    failing = F.array(*(F.sum(F.when(mask.bitwiseAND(F.lit(1 << k)) != 0, n).otherwise(0)) for k in range(STEPS)))
    alone = F.array(*(F.sum(F.when(mask == 1 << k, n).otherwise(0)) for k in range(STEPS)))
    parts = sums.where(F.col("place") >= masks_at).groupBy("part").agg(F.sum("n").alias("total"), failing.alias("failing"), alone.alias("alone"))
    at = sums.where(F.col("place") < masks_at).select("part", "n", F.expr(f"place div {width}").alias("kind"), F.expr(f"place % {width}").alias("at"))
    at = at.select("part", "n", "kind", F.expr(f"CAST(at div {STEPS + 1} AS INT)").alias("order"), F.expr(f"CAST(at % {STEPS + 1} AS INT) + 1").alias("step")).where(F.col("step") <= STEPS)
    by_class = [F.sum(F.when(F.col("kind") == k, n).otherwise(0)).alias(name) for k, name in enumerate(Sums.CLASSES)]
    rows = at.groupBy("part", "order", "step").agg(*by_class)
    rows = rows.withColumn("filter_order", F.element_at(F.split(F.lit(",".join(ORDERS)), ","), F.col("order") + 1))
    rows = rows.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    so_far = F.sum("removed").over(Window.partitionBy("part", "order").orderBy("step"))
    rows = rows.withColumns({"so_far": so_far, "shapley": F.sum("removed").over(Window.partitionBy("part", "letter"))}).join(parts, "part")
    of_letter = lambda c: F.element_at(c, F.expr(f"instr('{FILTERS}', letter)"))
    out = {"kept": F.col("total") - F.col("so_far"), "redundant": of_letter("failing") - F.col("removed"), "unique_fails": of_letter("alone")}
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return rows.withColumns(out).select(*names)
