"""Byte-level BPE ids of many texts at once.

Texts are cut into the tokenizer's own words (runs of letters, digits, other
signs or white space) with numpy over code points, each distinct word of a
batch is encoded once by the ``tokenizers`` library, and the ids are spread
back. Words never influence each other in byte-level BPE, so the ids are those
of encoding the whole text; texts with anything the cutter does not cover
(contractions, special tokens, code points beyond Latin) go to the library
whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

from churnlens.llm.common import cut_text

LIMIT = 0x250  # code points the cutter covers
SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)
CONTRACTION = re.compile(r"'(?:[stmd]|re|ve|ll)")
CACHED_WORDS = 1_000_000  # distinct words kept by one worker, about 35 bytes each
LONGEST_WORD = 64  # longer ones are encoded on their own, by their text
BATCH_CHARS = 400_000  # about 60 bytes of arrays per code point
BETWEEN = re.compile(r"(?<=[^\s])(?= [^\s])")  # before a blank that joins the next word: words end there


def _class(code: int) -> int:
    if code in (9, 10, 13, 32):
        return SPACE
    kind = unicodedata.category(chr(code))
    if code in (11, 12, 0x85, 0xA0) or kind in ("Cc", "Zs", "Zl", "Zp"):
        return UNKNOWN
    return LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else OTHER


@lru_cache(maxsize=None)
def _tables():
    classes = np.array([_class(c) for c in range(LIMIT)], dtype=np.uint8)
    values = np.random.default_rng(7).integers(1, 2 ** 63, LIMIT, dtype=np.uint64) | np.uint64(1)
    return classes, values


BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64


@lru_cache(maxsize=2)
def _powers(n: int):
    def run(b):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)
    return run(BASE), run(pow(BASE, -1, 1 << 64))


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each segment (a polynomial, its sums cumulated once)."""
    n = 1 << max(10, int(len(values)).bit_length())
    powers, inverse = _powers(n)
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * powers[:len(values)], dtype=np.uint64)])
    out = (total[ends] - total[starts]) * inverse[starts]
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts).astype(np.uint64)


class Encoder:
    """Ids of texts by one tokenizer file (its path is a parameter)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([CONTRACTION.pattern, *map(re.escape, specials)]))
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.clear()

    def clear(self):
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # of the words kept, by hash
        self.flat, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; long texts are encoded in pieces that part between words."""
        if all(len(t) <= BATCH_CHARS for t in texts):
            return self._encode(texts)
        out = []
        for t in texts:
            pieces = [self._encode([p])[0] for p in cut_text(t, BATCH_CHARS, BETWEEN)]
            out.append(np.concatenate(pieces))
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain, whole, size = [], [], 0
        for i, t in enumerate(texts):
            (whole if self.whole.search(t) else plain).append(i)
        run: list[int] = []
        for i in plain:
            run.append(i)
            size += len(texts[i])
            if size >= BATCH_CHARS:
                self._plain(texts, run, out, whole)
                run, size = [], 0
        self._plain(texts, run, out, whole)
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out

    def _plain(self, texts, run, out, whole) -> None:
        if not run:
            return
        classes, values = _tables()
        joined = "".join(texts[i] for i in run)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(texts[i]) for i in run])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        kind = classes[np.minimum(codes, 0)] if not len(codes) else np.where(
            codes < LIMIT, classes[np.minimum(codes, LIMIT - 1)], UNKNOWN)
        if (kind == UNKNOWN).any():
            bad = np.add.reduceat(np.append(kind == UNKNOWN, False), np.minimum(bounds[:-1], len(kind))) > 0
            bad &= lengths > 0
            whole.extend(i for i, b in zip(run, bad) if b)
            self._plain(texts, [i for i, b in zip(run, bad) if not b], out, whole)
            return
        if not len(codes):
            for i in run:
                out[i] = np.zeros(0, np.uint32)
            return
        edge = np.zeros(len(codes) + 1, dtype=bool)
        edge[bounds] = True
        first = edge[:-1].copy()
        first[1:] |= kind[1:] != kind[:-1]
        # after white space: a blank joins the word it precedes, any other last sign stands alone
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~edge[1:-1]) + 1
        first[after - 1] = True
        first[after[codes[after - 1] == 32]] = False
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(codes))
        hashes = segment_hashes(values[codes], starts, ends)
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.offsets) > CACHED_WORDS:
            self.clear()
        place = np.searchsorted(self.hashes, distinct)
        slots = np.full(len(distinct), -1, np.int64)
        held = np.flatnonzero(place < len(self.hashes))
        held = held[self.hashes[place[held]] == distinct[held]]
        slots[held] = self.slots[place[held]]
        long = (ends - starts)[at] > LONGEST_WORD
        slots[long] = -1
        new = np.flatnonzero(slots < 0)
        if len(new):
            words = [joined[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())]
            slots[new] = self._add(words)
            kept = new[~long[new]]
            self.hashes = np.insert(self.hashes, place[kept], distinct[kept])
            self.slots = np.insert(self.slots, place[kept], slots[kept])
        slot = slots[inverse]
        counts = self.offsets[slot + 1] - self.offsets[slot]
        places = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.offsets[slot] - places[:-1], counts) + np.arange(places[-1])]
        cuts = places[np.searchsorted(starts, bounds)]
        for j, i in enumerate(run):
            out[i] = ids[cuts[j]:cuts[j + 1]]

    def _add(self, words: list[str]) -> np.ndarray:
        """Encode words, append their ids to the cache arrays and return their slots."""
        lone = [i for i, w in enumerate(words) if w.isspace()]
        rest = [i for i, w in enumerate(words) if not w.isspace()]
        flat, counts = [], []
        groups = [rest[k:k + 1000] for k in range(0, len(rest), 1000)]
        # words parted by line ends stay words of their own
        joined = ["\n".join([words[i] for i in g]) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            got = np.array(e.ids, dtype=np.uint32)
            parted = got == self.line_end
            ends = np.flatnonzero(parted)
            if len(ends) == len(g) - 1:
                flat.append(got[~parted])
                counts.append(np.diff(ends, prepend=-1, append=len(got)) - 1)
            else:
                alone = [self.tokenizer.encode(words[i], add_special_tokens=False).ids for i in g]
                flat += [np.array(x, dtype=np.uint32) for x in alone]
                counts.append(np.array([len(x) for x in alone]))
        alone = [x.ids for x in self.tokenizer.encode_batch_fast([words[i] for i in lone], add_special_tokens=False)]
        flat += [np.array(x, dtype=np.uint32) for x in alone]
        counts.append(np.array([len(x) for x in alone], dtype=np.int64))
        slots = np.empty(len(words), np.int64)
        slots[rest + lone] = len(self.offsets) - 1 + np.arange(len(words))
        self.flat = np.concatenate([self.flat, *flat])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(counts))])
        return slots


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file, with the words it has met. A task has one core, so
    the library is told to start no threads of its own, which also keep memory each."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
