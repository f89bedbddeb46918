"""Token counts by the whole-token shortcut.

A sentencepiece BPE model never merges over the start of a new word when none of its pieces has the
word-start mark after another character, nor over a newline when no piece holds one; both are proved from
the vocabulary when the model is loaded. So a text's count is the sum over its words. Words that the vocabulary
holds and that, also proved by encoding each once, come out as one token count 1 without any merging; all
other words are merged by the library once a process and then looked up.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinade.llm.common import in_small_batches
from affinade.llm.word_codec import slices

MARK = "▁"
CACHE = 400_000  # learned words kept in a process beside the proved ones; when full they start anew


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = self.sp
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())
                  if not (kinds.is_control(i) or kinds.is_unknown(i) or kinds.is_byte(i) or kinds.is_unused(i))]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in pieces) and self._plain()
        whole = [p[1:] for p in pieces if len(p) > 1 and p[0] == MARK and MARK not in p[1:]]
        self.whole = {w: 1 for w, ids in zip(whole, self._encode(whole)) if len(ids) == 1} if self.splits else {}
        self.after_space = dict(self.whole)
        self.after_line: dict[str, int] = {}
        self.newline = len(self.sp.encode("a\n")) - len(self.sp.encode("a"))

    def _plain(self) -> bool:
        """The normaliser keeps texts as they are, but for one word mark put in front."""
        probe = "a  \tééÅﬁ \n b "
        return self.sp.normalize(probe) == (MARK + probe).replace(" ", MARK)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)

    def _learn(self, words: set[str], lines: set[str]) -> None:
        new = list(words.difference(self.after_space))
        if len(self.after_space) + len(new) > CACHE + len(self.whole):
            self.after_space = dict(self.whole)
            new = list(words.difference(self.after_space))
        self.after_space.update(zip(new, map(len, self._encode(new))))
        new = list(lines.difference(self.after_line))
        if len(self.after_line) + len(new) > CACHE:
            self.after_line.clear()
            new = list(lines)
        before = len(self.sp.encode("\n"))
        self.after_line.update((w, len(x) - before) for w, x in zip(new, self._encode(["\n" + w for w in new])))

    def count(self, texts: list[str | None]) -> list[int]:
        out, todo = [0] * len(texts), []
        words, lines = set(), set()
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.splits or MARK in text or "  " in text or text[0] == " " or text[-1] == " " or "\x00" in text or " \n" in text or "\n " in text:
                out[i] = len(self.sp.encode(text))
                continue
            first, *rest = text.split("\n")
            run = first.split(" ") if first else []
            heads = []
            for line in rest:
                if line:
                    head, *tail = line.split(" ")
                    heads.append(head)
                    run += tail
            # an empty first line still gets the word mark
            todo.append((i, run, heads, self.newline * len(rest) + (0 if first else 1)))
            words.update(run)
            lines.update(heads)
        self._learn(words, lines)
        one, two = self.after_space.__getitem__, self.after_line.__getitem__
        for i, run, heads, more in todo:
            out[i] = sum(map(one, run)) + sum(map(two, heads)) + more
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Null and empty texts count 0 bytes and 0 tokens; texts of any length are counted whole; repeated rows and null ids are kept; an empty table
    gives an empty result; other columns are not read, so clashing names don't matter.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        c = counter(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts: list[int] = []
            for a, b in slices([len(t or "") for t in texts]):
                counts += c.count(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = in_small_batches(rows).mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
