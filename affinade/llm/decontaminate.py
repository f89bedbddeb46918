"""Benchmark decontamination with one Aho-Corasick automaton over normalised test windows.

Texts are read as UTF-8 bytes: A-Z become a-z, every other ASCII byte that is no letter or digit becomes a space,
the rest stays, so each byte keeps its offset. The automaton reads words by their numbers among the benchmark's windows, two
letters each, so a window of ten words is twenty nodes at most. A text's words are
scanned once; a hit ends at a known word, and the words' offsets give the passage in the original.
"""

from __future__ import annotations

import math
import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinade.llm.common import in_small_batches, store

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if WORD.match(bytes([b])) else 32 for b in range(256))
WINDOW_ROWS = 10_000  # of a batch of windows
_built: dict[str, Matcher] = {}


def windows(text: bytes | None, size: int) -> set[bytes]:
    """Distinct windows of ``size`` words; a shorter text is one window, a text without words none."""
    words = (text or b"").translate(NORMAL).split()
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class Matcher:
    """The automaton of a set of windows and its words' numbers.

    A word is two letters, the root of the number of words each, since a node's children are searched one by one. Only runs of words
    that the windows have are scanned: any other word would take the automaton back to its root.
    """

    def __init__(self, patterns: list[tuple[bytes, list]]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        coded = [[self.number.setdefault(w, len(self.number)) for w in pattern.split(b" ")] for pattern, _ in patterns]
        self.base = 1 + math.isqrt(len(self.number))
        self.least = min(map(len, coded), default=0)
        self.automaton = ahocorasick.Automaton()
        for codes, (_, items) in zip(coded, patterns):
            self.automaton.add_word(self.letters(np.array(codes)), (len(codes), items))
        if patterns:
            self.automaton.make_automaton()

    def letters(self, codes: np.ndarray) -> str:
        """First and second letters have different alphabets, so that a match begins at a word."""
        both = np.stack([codes // self.base, codes % self.base + self.base], 1).astype("<u4") + 1
        return "".join(map(chr, both.ravel().tolist())) if len(codes) < 32 else both.tobytes().decode("utf-32-le", "surrogatepass")

    def hits(self, words: list[bytes]):
        """Word span and item ids of every window that occurs."""
        if not self.number:
            return
        codes = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff((codes >= 0).astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        for begin, end in edges[edges[:, 1] - edges[:, 0] >= self.least].tolist():
            for at, (k, items) in self.automaton.iter(self.letters(codes[begin:end])):
                last = begin + at // 2 + 1
                yield last - k, last, items


def matcher(key: str, patterns: list[tuple[bytes, list]]) -> Matcher:
    """Built once a process and set of patterns; the last one is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(patterns)
    return _built[key]


def listed(ids: set) -> list:
    return sorted(ids, key=lambda v: (v is None, v if v is not None else 0))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original of word spans (end exclusive)."""
    at = [m.span() for m in WORD.finditer(text.translate(NORMAL))]
    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [(int(points[at[a][0]]) - 1, int(points[at[b - 1][1] - 1])) for a, b in spans]


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _scan(docs: DataFrame, patterns: list[tuple[bytes, list]], item_type: pa.DataType, item_sql: str, keep_text: bool, kept: tuple[str, ...]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(patterns)  # bounded by block_windows and block_bytes
    key = uuid.uuid4().hex

    def run(batches):
        found_by = matcher(key, shared.value)
        for batch in batches:
            n_words, hits, found, spans = [], [], [], []
            for text, had, items in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words = (text or b"").translate(NORMAL).split()
                n_words.append(len(words))
                got, ids = [(h["start"], h["end"]) for h in had or ()], set(items or ())
                for begin, end, whose in found_by.hits(words):
                    got.append((begin, end))
                    ids.update(whose)
                got = merged(got)
                hits.append([{"start": x, "end": y} for x, y in got])
                spans.append([{"start": x, "end": y} for x, y in original(text, got)] if got else [])
                found.append(listed(ids))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[4:], batch.column(0), batch.column(1) if keep_text else pa.nulls(len(n_words), pa.binary()), pa.array(hits, pa.list_(SPAN)), pa.array(found, pa.list_(item_type)), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(SPAN))],
                [*kept, "doc_id", "text", "hit_words", "items", "n_words", "spans"],
            )

    span = "array<struct<start:bigint,end:bigint>>"
    more = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return in_small_batches(docs).select("doc_id", "text", "hit_words", "items", *kept).mapInArrow(run, f"{more}doc_id {docs.schema['doc_id'].dataType.simpleString()}, text binary, hit_words {span}, items array<{item_sql}>, n_words long, spans {span}")


def item_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct ``item_id``, ``window``, made on the executors."""
    kind = benchmark.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = list(windows(text, window))
                for at in range(0, len(own), WINDOW_ROWS):
                    part = own[at : at + WINDOW_ROWS]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(part), pa.int64())), pa.array(part, pa.binary())], ["item_id", "window"])

    items = in_small_batches(benchmark).select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    return items.mapInArrow(run, f"item_id {kind.simpleString()}, window binary").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = 500_000, block_bytes: int = 64_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, hit_words (word spans), items (matched ids), spans (code points of the original).

    Null and empty texts have no words and no hits, on either side; items of fewer words than a window match
    as a whole; repeated rows and ids, null ids and empty tables are kept as they are; null item ids count as one item,
    listed last as null; very long texts are scanned whole. Windows are made on the executors. A benchmark of more than ``block_windows``
    pairs of a window and an item, or whose windows have more than ``block_bytes``, is taken in blocks of about that size, one pass over the documents each, so that an
    automaton has at most 2 x ``window`` x ``block_windows`` nodes and a window that very many items hold is dealt out by item. ``keep`` names columns to carry
    along (none of this function's own names), ``keep_text`` the text, as bytes.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    item_kind = benchmark.schema[item_col].dataType
    made = store(item_windows(benchmark, window, item_col, text_col), "decontaminate-windows")
    n, size = made.agg(F.count("*"), F.sum(F.octet_length("window"))).first()
    blocks = max(1, math.ceil(n / block_windows), math.ceil((size or 0) / block_bytes))
    span = "array<struct<start:bigint,end:bigint>>"
    state = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.lit(None).cast(span).alias("hit_words"), F.lit(None).cast(f"array<{item_kind.simpleString()}>").alias("items"), *keep)
    for k in range(blocks):
        whose: dict[bytes, set] = {}
        for item_id, w in made.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)) == k).toLocalIterator():
            whose.setdefault(bytes(w), set()).add(item_id)
        patterns = [(w, listed(ids)) for w, ids in sorted(whose.items())]
        last = k == blocks - 1
        state = _scan(state, patterns, to_arrow_type(item_kind), item_kind.simpleString(), keep_text or not last, keep)
        if not last:
            state = store(state, "decontaminate")
    return state if keep_text else state.drop("text")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The input's rows and columns without the documents that hold a window of the benchmark.

    Null, empty and blank texts hold none and stay, as do repeated rows, null ids and all columns, whatever their
    names; texts of any length are searched whole; with an empty benchmark every row stays; an empty table gives an empty result.
    """
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    del own["doc_id"], own["text"]
    renamed = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    found = decontaminate(renamed, benchmark, window, keep=tuple(own.values()), keep_text=True)
    return found.where(F.size("hit_words") == 0).select(*(F.col(own.get(c, c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from decontaminate()'s rows."""
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    ids = F.array_sort(F.transform(F.filter("items", lambda x: x.isNotNull()), lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))
