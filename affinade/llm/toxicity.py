"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two words sums over all subsequences of ORDER characters that both hold within SPAN places, gaps allowed,
each occurrence weighing DECAY to its length (word ends count as characters); each word's side is divided by the root of its
occurrences' squared weights. A word with a character put in, left out or changed keeps most of its
subsequences, so it stays near the plain word. Nyström: the kernel against a few landmark words, made white, gives
features (the clean words that score highest join the landmarks now and then); a linear SVM on them is trained on sentences, as a multiple-instance problem, since a toxic document's
labels don't say which sentence is toxic: its highest one stands for it, chosen anew each round.

A word's margin is the machine's; a document's probability is a logistic function of its TOP highest different margins,
since one near word may be chance where several are not. As the SVM is linear in the kernel
and the kernel in the subsequences, the machine collapses into one weight a subsequence, and each distinct word is
scored once a process. Letters that stand apart ("i d i o t", "i.d.i.o.t") are put together before.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinade.llm.common import in_small_batches
from affinade.llm.labelled import learnt_part, sample_by_label
from affinade.llm.word_codec import slices

ORDER, SPAN, DECAY = 4, 7, 0.7
TOP = 3
OTHERS = 13
ALPHABET = 27 + OTHERS  # 0: a word's edge; 1 to 26: a to z; from 27: other letters, dealt out by code point
CACHE = 400_000  # words kept in a process; when full they start anew
PART = 10_000  # rows of the learning problem in memory together as doubles
AT_ONCE = 20_000  # words whose subsequences are in memory together
LEARNT = 16_384  # letters of a labelled text that are learned from at most; scores read whole texts
VOCABULARY = 120_000  # distinct words of a fit at most: a kernel row of some 160 numbers each
TELLING = 8.0  # log-likelihood ratio from which a word tells of toxicity by itself
TAILS = list(combinations(range(1, SPAN), ORDER - 1))  # places of the characters after the first
# Both read a text once: a run of signs or blanks is taken whole and never tried in parts.
SENTENCE = re.compile(r"(?<![.!?\n])[.!?\n]++(?:\s|$)|\n")
APART = re.compile(r"(?<!\S)[^\W\d_][^\w\s]*+(?!\S)(?:(?:\s++[^\w\s]++(?!\S))*+\s++[^\W\d_][^\w\s]*+(?!\S)){2,}+")


def _letters() -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % OTHERS
    return out


LETTERS = _letters()


def _norms() -> np.ndarray:
    """By a word's number of characters, edges included: the root of its occurrences' squared weights."""
    each = np.zeros(SPAN + 1)
    for t in TAILS:
        each[t[-1] + 1] += DECAY ** (2 * (t[-1] + 1))
    total = [sum(each[s] * max(0, n - s + 1) for s in range(SPAN + 1)) for n in range(4096)]
    return np.sqrt(np.maximum(total, 1e-9))


NORMS = _norms()


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s and not s.isspace()]


def words_of(text: str) -> list[str]:
    """The words of a text, lower case; runs of lone letters also as one word."""
    lower = text.lower()
    words = lower.split()
    for m in APART.finditer(lower):
        words.append("".join(c for c in m[0] if c.isalpha()))
    return words


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' character classes, each word between two edges, and where each begins; what is no letter is left out."""
    points = np.frombuffer("".join(f"\n{w}\n" for w in words).encode("utf-32-le"), np.uint32)
    code = LETTERS[np.minimum(points, 0xFFFF)]
    edge = points == 10
    keep = edge | (code > 0)
    begins = np.flatnonzero(edge[keep])[::2]
    return code[keep].astype(np.int64), begins


def occurrences(code: np.ndarray, begins: np.ndarray):
    """For each tail: subsequence numbers and weights at every first place, and which places have it whole inside a word."""
    lengths = np.diff([*begins, len(code)])
    left = np.repeat(begins + lengths, lengths) - np.arange(len(code))
    for tail in TAILS:
        span = tail[-1] + 1
        at = np.flatnonzero(left >= span)
        u = code[at]
        for t in tail:
            u = u * ALPHABET + code[at + t]
        yield at, u, DECAY**span


def totals(words: list[str], weight: np.ndarray) -> np.ndarray:
    """Sum over each word's occurrences of their subsequences' weights, divided by the word's norm."""
    if len(words) > AT_ONCE:
        return np.concatenate([totals(words[i : i + AT_ONCE], weight) for i in range(0, len(words), AT_ONCE)])
    if not words:
        return np.zeros(0)
    code, begins = coded(words)
    by_place = np.zeros(len(code))
    for at, u, w in occurrences(code, begins):
        by_place[at] += w * weight[u]
    lengths = np.diff([*begins, len(code)])
    norm = np.where(lengths < len(NORMS), NORMS[np.minimum(lengths, len(NORMS) - 1)], NORMS[-1] * np.sqrt(lengths / len(NORMS)))
    return np.add.reduceat(by_place, begins) / norm


def spread(word: str) -> tuple[np.ndarray, np.ndarray]:
    """One word's subsequences and their summed weights, divided by its norm."""
    code, begins = coded([word])
    parts = [(u, np.full(len(u), w)) for _, u, w in occurrences(code, begins)]
    u, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return u, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(u)) / NORMS[min(len(code), len(NORMS) - 1)]


def kernel(words: list[str], landmarks: list[str], batch: int = 500) -> np.ndarray:
    """Words against landmarks, over the subsequences that landmarks have."""
    if not landmarks:
        return np.zeros((len(words), 0), np.float32)
    sides = [spread(m) for m in landmarks]
    held = np.unique(np.concatenate([u for u, _ in sides]))
    row = np.full(ALPHABET**ORDER, -1, np.int32)
    row[held] = np.arange(len(held))
    table = np.zeros((len(held), len(landmarks)), np.float32)
    for j, (u, v) in enumerate(sides):
        table[row[u], j] = v
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for begin in range(0, len(words), batch):
        code, begins = coded(words[begin : begin + batch])
        lengths = np.diff([*begins, len(code)])
        owner = np.repeat(np.arange(len(begins)), lengths)
        found = [(owner[at], row[u], np.full(len(u), w, np.float32)) for at, u, w in occurrences(code, begins)]
        who, r, w = (np.concatenate([f[k][f[1] >= 0] for f in found]) for k in range(3))
        by = np.argsort(who, kind="stable")
        who, r, w = who[by], r[by], w[by]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        if len(first):
            norm = NORMS[np.minimum(lengths[who[first]], len(NORMS) - 1)]
            out[begin + who[first]] = np.add.reduceat(table[r] * w[:, None], first) / norm[:, None]
    return out


def highest(margins) -> list[float]:
    """The TOP highest different margins, at least -1 each, so that any text has them."""
    best = sorted(set(margins), reverse=True)[:TOP]
    return [max(-1.0, m) for m in best] + [-1.0] * (TOP - len(best))


@dataclass
class ToxicModel:
    weight: np.ndarray  # per subsequence
    bias: float
    slope: np.ndarray  # of a document's TOP highest margins
    shift: float

    def score_words(self, words: list[str]) -> np.ndarray:
        return totals(words, self.weight) + self.bias

    def scores(self, texts: list[str | None], known: dict[str, float]) -> list[float]:
        """Probability that a text is toxic; ``known`` keeps the words' margins."""
        lists = [words_of(t) if t else [] for t in texts]
        unseen = set()
        unseen.update(*lists)
        new = list(unseen.difference(known))
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list(unseen)
        known.update(zip(new, self.score_words(new).tolist()))
        get = known.__getitem__
        top = np.array([highest(map(get, w)) for w in lists]).reshape(-1, TOP)
        return (1 / (1 + np.exp(-np.clip(top @ self.slope + self.shift, -30, 30)))).tolist()


def svm(blocks: list[np.ndarray], white: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 3e-4, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Linear SVM with squared hinge by Newton steps over the rows inside the margin: the machine, bias last, and all margins.

    A row's features are its kernel values, which lie in column blocks, times ``white``; they are made for PART rows at a time.
    """
    cost, v = weight / weight.sum(), np.zeros(white.shape[1] + 1)
    ridge = np.full(len(v), reg)
    ridge[-1] = 1e-9
    margin = np.zeros(len(blocks[0]))
    for _ in range(steps):
        active = np.flatnonzero(y * margin[rows] < 1)
        left, right = np.diag(ridge), np.zeros(len(v))
        for at in range(0, len(active), PART):
            part = active[at : at + PART]
            x1 = np.ones((len(part), len(v)), np.float32)
            x1[:, :-1] = np.concatenate([b[rows[part]] for b in blocks], 1) @ white.astype(np.float32)
            xa = x1 * cost[part, None].astype(np.float32)
            left += xa.T @ x1
            right += xa.T @ y[part]
        new = np.linalg.solve(left, right)
        done, v = np.allclose(new, v, atol=1e-4), new
        w, margin = white @ v[:-1], np.full(len(margin), v[-1])
        for b in blocks:
            margin += b @ w[: b.shape[1]].astype(np.float32)
            w = w[b.shape[1] :]
        if done:
            break
    return v, margin


def fit(documents: list[tuple[list[str], int]], landmarks: int = 96, rounds: int = 6, harder: int = 32, words: int = VOCABULARY) -> ToxicModel:
    """``documents``: the distinct words of each, and its label."""
    flat = ToxicModel(np.zeros(ALPHABET**ORDER), 0.0, np.zeros(TOP), -30.0)
    n = Counter(y for _, y in documents)
    if not n[0] or not n[1]:
        return flat
    df = {0: Counter(), 1: Counter()}
    for own, y in documents:
        df[y].update(w for w in own if len(w) > 2)

    def gain(w: str) -> float:
        """Log-likelihood ratio of a word's share in toxic documents against the others, if above."""
        a, c = df[1][w], df[0][w]
        p, q, r = a / n[1], c / n[0], (a + c) / (n[0] + n[1])
        if p <= q:
            return 0.0
        h = lambda k, m, s: k * np.log(s) + (m - k) * np.log(1 - s) if 0 < s < 1 else 0.0
        return h(a, n[1], p) + h(c, n[0], q) - h(a, n[1], r) - h(c, n[0], r)

    gains = {w: gain(w) for w in df[1]}
    telling = sorted((w for w in gains if gains[w] > TELLING), key=lambda w: (-gains[w], w))[: landmarks * 2 // 3]
    plain = sorted((w for w in df[0] if gains.get(w, 0) < 1), key=lambda w: (-df[0][w], w))[: landmarks // 3]
    if not telling:
        return flat

    vocabulary = sorted(df[0].keys() | df[1].keys())
    if len(vocabulary) > words:
        vocabulary = sorted({*telling, *plain, *sorted(vocabulary, key=lambda w: (zlib.crc32(w.encode()), w))[:words]})
    number = {w: i for i, w in enumerate(vocabulary)}
    many = np.array([df[0][w] for w in vocabulary], np.float64)
    bags = [(np.array([number[w] for w in own if w in number], np.int32), y) for own, y in documents]
    gained = np.array([gains.get(w, 0.0) for w in vocabulary])
    margin = gained  # for the first witnesses
    clean = np.flatnonzero(many > 0)
    blocks: list[np.ndarray] = []
    for turn in range(rounds):
        if turn % 2 == 0:  # the clean words that score highest become landmarks too
            new = list(plain) if not turn else [vocabulary[i] for i in clean[np.argsort(-margin[clean], kind="stable")].tolist() if vocabulary[i] not in marks][:harder]
            marks = marks + new if turn else telling + new
            blocks.append(kernel(vocabulary, marks if not turn else new))
            gram = kernel(marks, marks).astype(np.float64)
            values, vectors = np.linalg.eigh((gram + gram.T) / 2)
            white = vectors / np.sqrt(np.maximum(values, 1e-2))
        # positives: each toxic document's highest word, unless even that is unlikely (a wrong label), and its telling words
        least = TELLING if not turn else -0.25
        witness = [b[np.argmax(margin[b])] for b, y in bags if y == 1 and len(b)]
        told = [b[gained[b] > TELLING] for b, y in bags if y == 1]
        likely = np.bincount([i for i in witness if margin[i] > least], minlength=len(margin))
        positive = np.maximum(likely, np.bincount(np.concatenate(told), minlength=len(margin)))
        up = np.flatnonzero(positive)
        rows = np.concatenate([up, clean])
        y = np.concatenate([np.ones(len(up)), -np.ones(len(clean))])
        weight = np.concatenate([positive[up] / n[1], many[clean] / n[0]])  # a word costs as many documents as have it
        v, margin = svm(blocks, white, rows, y, weight)
    top = np.array([highest(margin[b].tolist()) for b, _ in bags])
    slope, shift = logistic(top, np.array([y for _, y in bags]))
    weight = np.zeros(ALPHABET**ORDER)
    for mark, a in zip(marks, white @ v[:-1]):
        u, s = spread(mark)
        weight[u] += a * s
    return ToxicModel(weight.astype(np.float32), float(v[-1]), slope, shift)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[np.ndarray, float]:
    """Logistic regression by damped Newton steps."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
    a = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ a, -30, 30)))
        grad = x1.T @ (p - y) / len(y) + 1e-4 * a
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 / len(y) + 1e-4 * np.eye(len(a))
        a -= 0.5 * np.linalg.solve(hess, grad)
    return a[:-1], float(a[-1])


def labelled_words(sample: DataFrame, letters: int = LEARNT) -> list[tuple[list[str], int]]:
    """Each sampled document's distinct words, sentence by sentence, as the executors find them."""

    def run(batches):
        for batch in batches:
            out = [list(dict.fromkeys(w for s in sentences(learnt_part(text, letters)) for w in words_of(s))) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(out, pa.list_(pa.string()))], ["doc_id", "label", "words"])

    one: dict[str, str] = {}  # a word is in memory once
    rows = sample.mapInArrow(run, "doc_id string, label int, words array<string>").toLocalIterator()
    found = [(r["doc_id"], [one.setdefault(w, w) for w in r["words"]], r["label"]) for r in rows]
    found.sort(key=lambda r: (zlib.crc32(r[0].encode()), r[0]))
    return [(words, y) for _, words, y in found]


def toxicity_scores(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", per_class: int = 2500, letters: int = LEARNT, words: int = VOCABULARY) -> DataFrame:
    """``doc_id``, ``score`` (probability of class 1), ``predicted`` for every document.

    Learns from at most ``per_class`` labelled documents of each class where ``train`` holds, from at most ``letters`` letters of each, in
    evenly spaced pieces, and ``words`` distinct words in all (those of lowest checksum, and all that become landmarks), which bounds the driver's memory in bytes. Texts of any
    length are scored whole. Empty and null texts get the score of the bias; without two classes or telling words
    all scores are 0. Repeated rows and null ids are scored like any other; an empty table gives an empty result. Reads doc_id and text only, so other
    columns may have any names.
    """
    fitted = fit(labelled_words(sample_by_label(docs, labels, label, train, per_class), letters), words=words)
    model = docs.sparkSession.sparkContext.broadcast(fitted)  # one weight a subsequence: 10 MB
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for a, b in slices([len(t or "") for t in texts]):
                out += model.value.scores(texts[a:b], known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    out = in_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
