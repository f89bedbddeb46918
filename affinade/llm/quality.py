"""Quality classifier on supervised subword embeddings.

Every word, every character n-gram of a word and every pair of neighbouring words has a vector in a hashed table; a document is the
average of the vectors of all it holds; a softmax over it gives the classes. Table and softmax are trained together by
stochastic gradient descent in numpy. To score, only the difference of the two logits matters, which is linear in the
vectors, so each word is worth one number (and one count), found once a process and then looked up.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinade.llm.common import in_small_batches
from affinade.llm.labelled import learnt_part, sample_by_label
from affinade.llm.word_codec import slices

BITS, DIM = 18, 16  # hashed table: 2**BITS vectors of DIM numbers
NGRAMS = (3, 4, 5)
PAIR = 16  # features that a pair of neighbouring words counts as (see pair_weights)
LETTERS = 8_192  # of a labelled text that are learned from at most; scores read whole texts
CACHE = 400_000  # words kept in a process; when full they start anew
STEP = np.uint32(0x9E3779B1)  # odd multiplier of the rolling n-gram hash


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all features of each word, in a row, and where each word's begin."""
    marked = "\n".join(f"<{w}>" for w in words)  # words come from a split at white space: none holds a newline
    points = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
    edge = points == 10
    owner = np.cumsum(edge)
    rows, owners = [np.array([zlib.crc32(w.encode()) >> (32 - BITS) for w in words], np.int64)], [np.arange(len(words))]
    h = points * STEP
    inside = ~edge
    for n in range(2, max(NGRAMS) + 1):
        if n > len(points):
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * STEP + points[n - 1 :] * np.uint32(0x85EBCA6B)
        inside = inside[:-1] & ~edge[n - 1 :]
        if n in NGRAMS:
            rows.append(((h[inside] ^ (h[inside] >> np.uint32(13))) * STEP >> np.uint32(32 - BITS)).astype(np.int64))
            owners.append(owner[: len(inside)][inside])
    at = np.concatenate(owners)
    by = np.argsort(at, kind="stable")
    return np.concatenate(rows)[by], np.searchsorted(at[by], np.arange(len(words)))


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words))


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Table rows of neighbouring words, by the words' hashes."""
    h = (hashes[:-1] ^ (hashes[:-1] >> np.uint32(15))) * STEP + hashes[1:] * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(13))) * STEP >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class QualityModel:
    value: np.ndarray  # per table row: how far it moves the logit of class 1 over class 0
    bias: float


class Scorer:
    """A model and the words met so far: each one's sum of values, count of features, and hash."""

    def __init__(self, model: QualityModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.total, self.count, self.hash = np.zeros(0), np.zeros(0), np.zeros(0, np.uint32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.number))
        if len(self.number) + len(new) > CACHE:
            self._clear()
            new = list(set(words))
        if new:
            rows, begin = buckets(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.total = np.append(self.total, np.add.reduceat(self.model.value[rows].astype(np.float64), begin))
            self.count = np.append(self.count, np.diff([*begin, len(rows)]))
            self.hash = np.append(self.hash, hashes(new))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str | None]) -> list[float]:
        """Probability of class 1."""
        each = [(t or "").split() for t in texts]
        size = np.array([len(w) for w in each])
        at = self._numbers([w for words in each for w in words])
        owner = np.repeat(np.arange(len(each)), size)
        total, count = np.bincount(owner, self.total[at], len(each)), np.bincount(owner, self.count[at], len(each))
        if len(at) > 1:
            inside = owner[1:] == owner[:-1]
            value = np.where(inside, self.model.value[pairs(self.hash[at])], 0)
            total += PAIR * np.bincount(owner[1:], value, len(each))
            count += PAIR * np.maximum(size - 1, 0)
        out = self.model.bias + np.divide(total, count, out=np.zeros(len(each)), where=count > 0)
        return (1 / (1 + np.exp(-np.clip(out, -30, 30)))).tolist()


def features(text: str | None, pair: int = PAIR) -> tuple[np.ndarray, np.ndarray]:
    """A document's table rows and their weights (sum 1)."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    rows, n = np.unique(np.concatenate([buckets(words)[0], np.repeat(pairs(hashes(words)), pair)]), return_counts=True)
    return rows, n / n.sum()


def examples(sample: DataFrame, letters: int = LETTERS, pair: int = PAIR) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Each sampled document's table rows with their weights, made on the executors."""

    def run(batches):
        for batch in batches:
            made = [features(learnt_part(text, letters), pair) for text in batch.column(1).to_pylist()]
            ids, weights = ([m[k].astype(t).tobytes() for m in made] for k, t in ((0, "<i4"), (1, "<f4")))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], ["doc_id", "label", "ids", "weights"])

    rows = sample.mapInArrow(run, "doc_id string, label int, ids binary, weights binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(r["doc_id"].encode()), bytes(r["ids"])))  # mixed, and the same each time
    return [(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["weights"], "<f4"), r["label"]) for r in rows]


def fit(data: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, rate: float = 0.5, seed: int = 0) -> QualityModel:
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    top, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount([y for *_, y in data], minlength=2) / max(1, len(data))
    weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0).clip(max=20)  # classes count alike
    steps = max(1, epochs * len(data))
    for epoch in range(epochs):
        for k, i in enumerate(rng.permutation(len(data)).tolist()):
            ids, w, y = data[i]
            eta = rate * (1 - (epoch * len(data) + k) / steps) * weight[y]
            v = w @ table[ids]
            logit = v @ top + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            back = top @ p
            top -= eta * np.outer(v, p)
            bias -= eta * p
            table[ids] -= (eta * np.sqrt(len(ids) + 1)) * w[:, None] * back  # averages of many vectors move slowly
    return QualityModel(table @ (top[:, 1] - top[:, 0]), float(bias[1] - bias[0]))


def pair_weights(sample: DataFrame, candidates: tuple[int, ...] = (1, 4, 16, 32)) -> dict[int, float]:
    """By weight of a pair of neighbouring words: area under the curve on each third training row, fitted on the other two thirds.

    ``sample`` is sample_by_label()'s, so only rows that may be learned from take part in choosing PAIR.
    """
    out = {}
    for pair in candidates:
        data = examples(sample, pair=pair)
        model = fit([d for i, d in enumerate(data) if i % 3])
        tried = [(float(w @ value[ids]), y) for value in [model.value] for ids, w, y in data[::3]]
        good, bad = (np.array([s for s, y in tried if y == k]) for k in (1, 0))
        out[pair] = float(((good[:, None] > bad) + 0.5 * (good[:, None] == bad)).mean())
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", per_class: int = 1500, letters: int = LETTERS) -> DataFrame:
    """``doc_id``, ``score`` (probability of class 1), ``predicted`` for every document.

    Learns from at most ``per_class`` labelled documents of each class where ``train`` holds, and from at most ``letters`` letters of each, in evenly spaced
    pieces, which bounds the driver's memory in bytes. Empty and null texts get
    the score of the bias alone; without any labelled row all scores are 0.5. Texts of any length are scored whole; repeated
    rows and null ids are scored like any other; an empty table gives an empty result. Only doc_id and text are read, so other columns may have any names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(examples(sample_by_label(docs, labels, label, train, per_class), letters)))
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for a, b in slices([len(t or "") for t in texts]):
                out += scorer.scores(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    out = in_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
