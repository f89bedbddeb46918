"""Exact, fast ids of a word-level BPE tokenizer file: the library encodes each distinct pre-token once.

The tokenizer lower-cases, collapses white space, splits with a fixed pattern and runs BPE inside each
pre-token, so a text's ids are its pre-tokens' ids in a row. That holds where this module can repeat the
normaliser without doubt: texts of printable ASCII and Latin letters up to U+017F, without special-token
strings. Any other text goes to the library whole. Pre-tokens are found in numpy and looked up by a 64-bit hash, and what
is found is compared with the pre-token itself, letter by letter, so a hash that two words share can't give wrong ids:
a text with such a word goes to the library whole as well. Long texts are cut at white space, so memory stays bounded.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from affinade.llm.hashing import WIDE, of_runs

# The tokenizer file's own split pattern is 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
LETTER = "a-zªµºß-öø-ÿĀ-ſ"
DIGIT = "0-9²³¹¼½¾"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ſ]")
WHITE = re.compile("[\t\n\r ]")
JOINED = 500  # unseen pre-tokens encoded in one call
SLOTS = 1 << 20  # of the table of known pre-tokens; it starts anew when half full
LETTERS = 1 << 23  # letters of known pre-tokens kept at most; then the table starts anew, too
PART = 200_000  # characters looked at together; longer texts are cut at white space
SPACE, WORD, NUMBER, OTHER = range(4)


@functools.cache
def kinds() -> np.ndarray:
    """Each code point's kind, up to U+017F."""
    out = np.full(0x180, OTHER, np.uint8)
    letter, digit = re.compile(f"[{LETTER}]"), re.compile(f"[{DIGIT}]")
    for c in range(0x180):
        out[c] = WORD if letter.match(chr(c)) else NUMBER if digit.match(chr(c)) else SPACE if chr(c) in "\t\n\r " else OTHER
    return out


@functools.cache
def numbers() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, 0x180, dtype=np.uint64) * WIDE(2) + WIDE(1)


def pretokens(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all pre-tokens of a lower-case text that ends in white space."""
    kind = kinds()[codes]
    start = kind != SPACE
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    # an apostrophe that no other sign precedes or follows takes an ending along, and the letters after it stand alone
    quote = np.flatnonzero((codes == 39) & start)
    quote = quote[kind[quote + 1] == WORD]
    for ending in ENDINGS:
        n, at = len(ending), quote[quote + len(ending) < len(codes)]
        for k, letter in enumerate(ending):
            at = at[codes[at + 1 + k] == ord(letter)]
        start[at + 1] = False
        start[at + 1 + n] |= kind[at + 1 + n] == WORD
    edges = np.flatnonzero(start | (kind == SPACE))
    mine = np.flatnonzero(start[edges])
    return edges[mine], edges[mine + 1]


class WordCodec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(1 << 16 if self.dtype.itemsize == 2 else self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(False).items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)  # hash of a known pre-token, 0: free
        self.at, self.size = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)  # its ids in the pool
        self.pool, self.used, self.known = np.zeros(1 << 18, self.dtype), 0, 0
        self.word_at, self.word_size = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)  # its letters
        self.letters, self.lettered = np.zeros(1 << 18, np.uint16), 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens in a row, and how many each has: many to a text, as each one's last id, and no other, ends a word."""
        parts, sizes = [], []
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            ids = np.frombuffer(self._whole(" ".join(part)), self.dtype)
            n = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(n) != len(part) or n.sum() != len(ids):
                each = [np.frombuffer(self._whole(w), self.dtype) for w in part]
                ids, n = np.concatenate(each), np.array([len(e) for e in each])
            parts.append(ids)
            sizes.append(n)
        return np.concatenate(parts), np.concatenate(sizes)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's slot, or the free one where it would go."""
        slot = (hashes & WIDE(SLOTS - 1)).astype(np.int64)
        open_ = np.arange(len(slot))
        while len(open_):
            key = self.keys[slot[open_]]
            open_ = open_[(key != hashes[open_]) & (key != 0)]
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
        return slot

    def _learn(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        words = [codes[a:b].tobytes().decode("utf-16-le") for a, b in zip(starts.tolist(), ends.tolist())]
        ids, n = self._ids(words)
        self.pool = room(self.pool, self.used, len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(n) - n
        self.used += len(ids)
        size = ends - starts
        letters = codes[runs(starts, size)]
        self.letters = room(self.letters, self.lettered, len(letters))
        self.letters[self.lettered : self.lettered + len(letters)] = letters
        word_begin = self.lettered + np.cumsum(size) - size
        self.lettered += len(letters)
        self.known += len(words)
        left = np.arange(len(hashes))
        while len(left):  # of those that want the same free slot one gets it
            slot = self._slots(hashes[left])
            slot, first = np.unique(slot, return_index=True)
            won = left[first]
            self.keys[slot], self.at[slot], self.size[slot] = hashes[won], begin[won], n[won]
            self.word_at[slot], self.word_size[slot] = word_begin[won], size[won]
            left = np.delete(left, first)

    def _same(self, codes: np.ndarray, starts: np.ndarray, size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether each pre-token is the word its slot holds, letter by letter."""
        same = self.word_size[slot] == size
        known = np.where(same, self.word_at[slot], 0)
        size = np.where(same, size, 0)
        differ = codes[runs(starts, size)] != self.letters[runs(known, size)]
        if differ.any():
            same[np.repeat(np.arange(len(size)), size)[differ]] = False
        return same

    def _plain(self, texts: list[str]) -> list[bytes | None]:
        """Each text's ids; None for a text with a word whose hash another one has, or more words than the table takes."""
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-16-le"), np.uint16)
        starts, ends = pretokens(codes)
        if not len(starts):
            return [b""] * len(texts)
        hashes = of_runs(codes, numbers(), starts, ends)
        hashes[hashes == 0] = 1
        slot = self._slots(hashes)
        new = np.flatnonzero(self.keys[slot] == 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            letters = int((ends - starts)[new[first]].sum())
            if self.known + len(fresh) > SLOTS // 2 or self.lettered + letters > LETTERS:
                self._clear()
                new = np.arange(len(hashes))
                fresh, first = np.unique(hashes, return_index=True)
                if len(fresh) > SLOTS // 2:
                    return [None] * len(texts)
            which = new[first]
            self._learn(fresh, codes, starts[which], ends[which])
            slot[new] = self._slots(hashes[new])
        borders = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        n = self.size[slot]
        last = np.cumsum(n, dtype=np.int64)
        raw = self.pool[runs(self.at[slot], n)].tobytes()
        cut = np.concatenate([[0], last])[borders] * self.dtype.itemsize
        out: list[bytes | None] = [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        same = self._same(codes, starts, ends - starts, slot)
        if not same.all():
            for i in np.unique(np.searchsorted(borders, np.flatnonzero(~same), side="right") - 1).tolist():
                out[i] = None
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian bytes of ``dtype``; null counts as empty."""
        out, plain, where = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            if text and (ODD.search(text) or ("<|" in text and any(s in text for s in self.specials))):
                out[i] = self._whole(text)
            elif text:
                for part in at_white_space(text.lower(), PART):
                    plain.append(part)
                    where.append(i)
        made: dict[int, list[bytes]] = {}
        for a, b in slices([len(p) for p in plain], PART):
            for part, i, raw in zip(plain[a:b], where[a:b], self._plain(plain[a:b])):
                made.setdefault(i, []).append(self._whole(part) if raw is None else raw)
        for i, parts in made.items():
            out[i] = b"".join(parts)
        return out


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    last = np.cumsum(sizes, dtype=np.int64)
    return np.arange(last[-1] if len(last) else 0) + np.repeat(starts - (last - sizes), sizes)


def room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, or a larger copy if ``more`` items don't fit behind those used."""
    if used + more <= len(array):
        return array
    return np.concatenate([array[:used], np.zeros(max(len(array), more), array.dtype)])


def at_white_space(text: str, size: int) -> list[str]:
    """The text in parts of about ``size`` characters, each but the last ending before white space (no pre-token spans any)."""
    out, begin = [], 0
    while len(text) - begin > size:
        stop = WHITE.search(text, begin + size)
        if stop is None:
            break
        out.append(text[begin : stop.start()])
        begin = stop.start()
    out.append(text[begin:])
    return out


@functools.lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def slices(n_chars: list[int], chars: int = 500_000) -> list[tuple[int, int]]:
    """Cut a batch so that each slice has about ``chars`` characters (one longer text may stand alone)."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(n_chars):
        if total and total + n > chars:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if begin < len(n_chars):
        out.append((begin, len(n_chars)))
    return out
