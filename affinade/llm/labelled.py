"""Bounded samples of labelled rows, for the operators that learn from them."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinade.llm.common import in_small_batches

PIECE = 512  # letters of a piece of a long labelled text
CUT = re.compile(r"^\S+(?=\s)|(?<=\s)\S+$")  # words that a piece's ends may have cut


def learnt_part(text: str | None, letters: int) -> str:
    """What is learned from a labelled text: all of it, or, of one over ``letters``, evenly spaced pieces, ``letters`` in all at most.

    A piece's first and last word may be cut, so they are left out where it has blanks.
    """
    if text is None or len(text) <= letters:
        return text or ""
    starts = np.linspace(0, len(text) - PIECE, max(1, letters // (PIECE + 1))).astype(int).tolist()
    return "\n".join(CUT.sub("", text[at : at + PIECE]) for at in starts)


def order_hash(column: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(column).cast("string"))


def sample_by_label(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, seed: int = 7) -> DataFrame:
    """``doc_id``, ``text``, ``label`` of at most ``per_class`` labelled documents of each class 0 and 1.

    Which ones: the lowest hashes of the ids among label rows where ``train`` holds, so the choice doesn't depend on
    partitions. Null ids and labels other than 0 and 1 take no part; where an id has several label rows, the largest label counts; where
    several documents share an id, the least text. The sampled ids are at most 2 x ``per_class`` rows, so they
    are broadcast, and only the sampled documents are shuffled.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & train)
    parts = [known.where(F.col("label") == k).distinct().orderBy(order_hash("doc_id", seed), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = reduce(DataFrame.union, parts).groupBy("doc_id").agg(F.max("label").alias("label"))
    found = in_small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
