"""Language ID by a byte convolutional network.

A text's UTF-8 bytes, folded to 64 classes, are cut into windows of fixed length that overlap by the widest filter less
one. Filters of several widths run over a window, the largest value of each is kept, and a softmax over these gives
the languages; a document gets its windows' average. Everything is trained in numpy. Folding makes a filter
bank of width 2 or 3 a table over all pairs or triples of classes, so applying it is one lookup a byte; a bank of width 4
is two lookups of pairs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinade.llm.common import in_small_batches
from affinade.llm.labelled import order_hash
from affinade.llm.word_codec import slices

CLASSES, EMBED, FILTERS, WIDTHS = 64, 8, 16, (2, 3, 4)
LENGTH = 256  # bytes of a window
SLOTS = 1 << 12  # of the hash by which documents are sampled
STRIDE = LENGTH - max(WIDTHS) + 1
LETTER = re.compile("[A-Za-z]")


def _fold() -> np.ndarray:
    """A byte's class: 0 for what is no letter or digit, 1 to 26 letters in either case, 27 digits, from 32 the rest."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        out[b] = 32 + (b & 31) if b >= 128 else ord(c.lower()) - 96 if c.isalpha() else 27 if c.isdigit() else 0
    return out


FOLD = _fold()


def windows(text: str) -> np.ndarray:
    """All windows of a text, as classes; the last is filled up with class 0."""
    raw = FOLD[np.frombuffer(text.encode(), np.uint8)]
    n = max(1, -(-(len(raw) - LENGTH) // STRIDE) + 1)
    whole = np.zeros((n - 1) * STRIDE + LENGTH, np.uint8)
    whole[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(whole, LENGTH)[::STRIDE]


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray  # classes x EMBED
    banks: dict[int, np.ndarray]  # width -> width x EMBED x FILTERS
    shift: dict[int, np.ndarray]  # width -> FILTERS
    top: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * np.sqrt(2 / s[-2])).astype(np.float32)
        return cls(languages, draw(CLASSES, EMBED), {w: draw(w, EMBED, FILTERS) for w in WIDTHS}, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, draw(FILTERS * len(WIDTHS), len(languages)), np.zeros(len(languages), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.banks.values(), *self.shift.values(), self.top, self.bias]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Gradients of the mean cross entropy over windows ``x``; they pass through each filter's best place only."""
        n, pooled, places, parts = len(x), [], {}, {}
        for w in WIDTHS:
            parts[w] = np.einsum("ce,wef->wcf", self.embed, self.banks[w])
            span = LENGTH - w + 1
            out = parts[w][0][x[:, :span]]
            for j in range(1, w):
                out += parts[w][j][x[:, j : j + span]]
            places[w] = out.argmax(1)
            pooled.append(np.take_along_axis(out, places[w][:, None], 1)[:, 0] + self.shift[w])
        h = np.concatenate(pooled, 1)
        a = np.maximum(h, 0)
        logit = a @ self.top + self.bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
        p[np.arange(n), y] -= 1
        p /= n
        d_top, d_bias, back = a.T @ p, p.sum(0), (p @ self.top.T) * (h > 0)
        d_embed, d_banks, d_shift = np.zeros_like(self.embed), [], []
        which = np.broadcast_to(np.arange(FILTERS), (n, FILTERS))
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            d_bank = np.empty_like(self.banks[w])
            for j in range(w):
                seen = np.take_along_axis(x, places[w] + j, 1).astype(np.int64)
                d_part = np.bincount((seen * FILTERS + which).ravel(), g.ravel(), CLASSES * FILTERS).reshape(CLASSES, FILTERS).astype(np.float32)
                d_bank[j] = self.embed.T @ d_part
                d_embed += d_part @ self.banks[w][j].T
            d_banks.append(d_bank)
            d_shift.append(g.sum(0))
        return [d_embed, *d_banks, *d_shift, d_top, d_bias], loss

    def tables(self) -> list[np.ndarray]:
        """Filter banks as tables over pairs, triples, and the two pairs of four classes."""
        part = {w: np.einsum("ce,wef->wcf", self.embed, self.banks[w]).astype(np.float32) for w in WIDTHS}
        pair = lambda p, q: (p[:, None] + q[None]).reshape(-1, FILTERS)
        three = (pair(part[3][0], part[3][1])[:, None] + part[3][2][None]).reshape(-1, FILTERS)
        return [pair(*part[2]), three, pair(part[4][0], part[4][1]), pair(part[4][2], part[4][3])]

    def apply(self, x: np.ndarray, tables: list[np.ndarray], batch: int = 256) -> np.ndarray:
        """Probabilities of each window."""
        out = []
        two, three, left, right = tables
        for at in range(0, len(x), batch):
            c = x[at : at + batch].astype(np.int32)
            pairs = c[:, :-1] * CLASSES + c[:, 1:]
            h = [two[pairs].max(1), three[pairs[:, :-1] * CLASSES + c[:, 2:]].max(1)]
            four = left[pairs[:, :-2]]
            four += right[pairs[:, 2:]]
            h.append(four.max(1))
            a = np.concatenate([np.maximum(v + self.shift[w], 0) for v, w in zip(h, WIDTHS)], 1)
            logit = a @ self.top + self.bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            out.append(p / p.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)


def fit(x: np.ndarray, labels: list[str], steps: int = 500, batch: int = 128, rate: float = 0.01, seed: int = 0) -> ByteNet | None:
    """Adam on equal shares of the languages; None without any labelled window."""
    if not labels:
        return None
    languages = sorted(set(labels))
    net = ByteNet.fresh(languages, seed)
    y = np.array([languages.index(v) for v in labels])
    by = [np.flatnonzero(y == k) for k in range(len(languages))]
    rng, weights = np.random.default_rng(seed), net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, steps + 1):
        take = np.array([rng.choice(by[k]) for k in rng.integers(0, len(languages), batch)])
        grads, _ = net.step(x[take], y[take])
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def labelled_windows(docs: DataFrame, train: Column, per_language: int, most: int, per_doc: int) -> tuple[np.ndarray, list[str]]:
    """Up to ``per_doc`` windows of up to ``per_language`` documents of each language, ``most`` documents in all.

    Where several documents share an id, the least text counts, so the sample doesn't depend on partitions.
    """
    known = in_small_batches(docs).select("doc_id", "text", "lang").where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = known.select("lang", "doc_id").withColumn("_h", order_hash("doc_id", 5)).withColumn("_slot", F.pmod(F.col("_h"), F.lit(SLOTS)))
    # counts by slots of the hash say up to which slot a language's sample reaches, so no task ranks all of a language
    upward = Window.partitionBy("lang").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = hashed.groupBy("lang", "_slot").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(upward), F.lit(0)))
    reach = slots.where(F.col("_before") < per_language).groupBy("lang").agg(F.max("_slot").alias("_last"))
    reach = F.broadcast(reach.orderBy("lang").limit(most))  # a sample of ``most`` documents has no more languages
    by_hash = Window.partitionBy("lang").orderBy("_slot", "_h", "doc_id")
    sample = hashed.join(reach, "lang").where("_slot <= _last").distinct().withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= per_language)
    sample = sample.orderBy("_n", "lang").limit(most)
    ids = sample.select("doc_id").distinct()  # at most ``most`` rows
    texts = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "t.text", "t.lang")

    def run(batches):
        for batch in batches:
            raw, lang = [], []
            for doc_id, text, code in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not any(map(str.isalpha, text)):
                    continue
                w = windows(text)
                rng = np.random.default_rng(len(text))
                for i in rng.permutation(len(w))[:per_doc].tolist():
                    raw.append(w[i].tobytes())
                    lang.append(code)
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(lang, pa.string())], ["x", "lang"])

    rows = sorted((bytes(r["x"]), r["lang"]) for r in texts.select("doc_id", "text", F.col("lang").cast("string")).mapInArrow(run, "x binary, lang string").collect())
    x = np.array([np.frombuffer(r[0], np.uint8) for r in rows]) if rows else np.zeros((0, LENGTH), np.uint8)
    return x, [r[1] for r in rows]


def has_letter(text: str | None) -> bool:
    return bool(text) and (LETTER.search(text) is not None or any(map(str.isalpha, text)))


def predict(net: ByteNet, tables: list[np.ndarray], texts: list[str | None]) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    rows, cut = [], []
    for i, text in enumerate(texts):
        if has_letter(text):
            rows.append(i)
            cut.append(windows(text))
    if not rows:
        return out
    p = net.apply(np.concatenate(cut), tables)
    begin = np.cumsum([0, *(len(w) for w in cut)])
    mean = np.add.reduceat(p, begin[:-1]) / np.diff(begin)[:, None]
    for i, k, s in zip(rows, mean.argmax(1).tolist(), mean.max(1).tolist()):
        out[i] = net.languages[k], min(1.0, s)
    return out


def identify(docs: DataFrame, train: Column, per_language: int = 800, most: int = 50_000, per_doc: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` for every document, and the columns of ``keep`` as they were.

    Learns from rows where ``train`` holds and lang is known: at most ``per_language`` documents a language, ``most`` in
    all. A null text or one without any letter is ``und`` with score 0, as is all when nothing is labelled. Texts of any length are
    read whole, in windows. Repeated rows and null ids are predicted like any other; an empty table gives an empty result. Columns other than
    doc_id, text, lang and ``keep`` aren't read, so they may have any names; ``keep`` must not name results.
    """
    net = fit(*labelled_windows(docs, train, per_language, most, per_doc))
    shared = docs.sparkSession.sparkContext.broadcast((net, net.tables() if net else []))
    names = ["doc_id", "text", *(c for c in keep if c not in ("doc_id", "text"))]
    kept = [i for i, c in enumerate(names) if c == "doc_id" or c in keep]

    def run(batches):
        own, tables = shared.value
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for a, b in slices([len(t or "") for t in texts]):
                out += predict(own, tables, texts[a:b]) if own else [("und", 0.0)] * (b - a)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], [*(names[i] for i in kept), "lang_pred", "score"])

    schema = ", ".join(f"`{names[i]}` {docs.schema[names[i]].dataType.simpleString()}" for i in kept)
    return in_small_batches(docs).select(*names).mapInArrow(run, f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, train: Column, languages: tuple[str, ...] | None = None, sure: float = 0.5) -> DataFrame:
    """The input's rows and columns without the documents that are rejected.

    Rejected is what no language gets (null texts and those without a letter; everything, if nothing is labelled) and, with ``languages``, what the
    network gives another language with a score of ``sure`` or more: short and mixed texts it isn't sure of stay. Repeated
    rows and null ids are judged like any other; columns may have any names; an empty table gives an empty result.
    """
    own = {c: c if c in ("doc_id", "text", "lang") else f"_own{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    found = identify(renamed, train, keep=tuple(own.values()))
    kept = F.col("lang_pred") != "und"
    if languages is not None:
        kept &= F.col("lang_pred").isin(*languages) | (F.col("score") < sure)
    return found.where(kept).select(*(F.col(n).alias(c) for c, n in own.items()))
