"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

Each word of a text is a row of symbols. The leaves of a segment tree hold the
merge rank of every adjacent pair, inner nodes the least (rank, place) below
them, so the root yields the leftmost pair of lowest rank; a merge changes
three leaves and their paths to the root. Merging ends when the root holds no
rank. Short words share one array of trees and merge side by side, one merge
per word and round; longer words have a tree of their own, so a run of n signs
takes n log n steps.

The tokenizer file (``tokenizers`` JSON) is read for its vocabulary, merges
and added tokens; its path is a parameter. Files of one family are covered:
BPE over byte-level signs, an optional word end, NFC and lower case, words cut
by a pattern that drops white space. Others raise ``ValueError``. Text beyond
Latin letters passes through the file's own normaliser and word cutter.

Defined results: null and empty texts have no ids (an empty binary, decoded
to the empty string); repeated rows and null ids stay rows of their own; other
columns may have any name, ``encode`` returns its own columns only; no rows
give no rows. Texts are read whole, in slices that end at white space. Ids the
file does not know are left out when decoding, as the library does.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import cut_text, runs, text_sizes

ENCODED = "doc_id long, n_tokens long, ids binary"
LATIN = 0x180  # below, NFC changes nothing and lower case stays where letters are listed
SLICE = 1 << 18  # code points cut into words at once
BLANK = re.compile("[ \t\r\n](?=[\x00-\u02ff])")  # white space that no mark follows: words and marks end there
CACHED = 300_000  # distinct words a worker keeps
SHORT = 32  # symbols of a word that merges in the shared trees
NONE = np.iinfo(np.int64).max  # no pair
PLACES = 1 << 32  # a key is rank * PLACES + place

#: The word pattern, normaliser and word cutter of the covered files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUTTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
NORMALISER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}


def byte_signs() -> list[str]:
    """The printable sign of each byte: itself where visible, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    signs = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [signs[b] for b in range(256)]


def latin_words() -> re.Pattern:
    """PATTERN for lower-cased text that began below LATIN."""
    def listed(kind):
        return "".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind)
    letters, digits, blanks = listed("L"), listed("N"), "\\x09-\\x0d\\x20\\x85\\xa0"
    return re.compile(f"'(?:[stmd]|re|ve|ll)|[{letters}]+|[{digits}]|[^{blanks}{letters}{digits}]+")


class Merges:
    """Merge ranks by pair of symbols, for one pair and for many."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.width = max(vocab.values(), default=0) + 1
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        self.rank = dict(zip(reversed(keys.tolist()), range(len(keys) - 1, -1, -1)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.order = np.append(keys[order], NONE), np.append(order, 0)

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """rank * PLACES + place of each pair; NONE where there is none (a symbol below 0 pairs with nothing)."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at] * PLACES + place, NONE)


def merge_long(symbols: list[int], merges: Merges) -> list[int]:
    """All merges of one word by a segment tree of its own."""
    n, rank, width, made = len(symbols), merges.rank, merges.width, merges.made
    size = 1 << max(0, n - 2).bit_length()
    tree = [NONE] * (2 * size)

    def leaf(i, j):
        r = rank.get(symbols[i] * width + symbols[j])
        return NONE if r is None else r * PLACES + i

    def put(i, value):
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
            i >>= 1

    for i in range(n - 1):
        tree[size + i] = leaf(i, i + 1)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    while tree[1] != NONE:
        r, i = divmod(tree[1], PLACES)
        j = after[i]
        k = after[i] = after[j]
        symbols[i], symbols[j] = int(made[r]), -1
        if k >= 0:
            before[k] = i
        put(i, leaf(i, k) if k >= 0 else NONE)
        if j < n - 1:
            put(j, NONE)
        if before[i] >= 0:
            put(before[i], leaf(before[i], i))
    return [s for s in symbols if s >= 0]


def merge_short(symbols: np.ndarray, merges: Merges) -> None:
    """All merges of many words at once, in place: a row of symbols per word, -1 after its end and where merged away."""
    m, n = symbols.shape
    size = 1 << (n - 1).bit_length()
    place = np.arange(n)
    wide = n + 1  # column n: nothing; so is column -1, the place before the first
    padded = np.concatenate([symbols, np.full((m, 1), -1)], axis=1).ravel()
    after = np.full((m, wide), n)
    after[:, :n - 1][symbols[:, 1:] >= 0] = np.broadcast_to(place[1:], (m, n - 1))[symbols[:, 1:] >= 0]
    after, before = after.ravel(), np.tile(np.arange(-1, n), m)
    tree = np.full((m, 2 * size), NONE)
    tree[:, size:size + n - 1] = merges.leaves(symbols[:, :-1], symbols[:, 1:], place[:-1])
    lo = size
    while lo > 1:
        np.minimum(tree[:, lo:2 * lo:2], tree[:, lo + 1:2 * lo:2], out=tree[:, lo // 2:lo])
        lo //= 2
    tree = tree.ravel()
    top = np.arange(m) * (2 * size)  # where each tree begins
    row = np.arange(m) * wide
    some = np.flatnonzero(tree[top + 1] != NONE)
    top, row = top[some], row[some]
    while len(row):
        r, i = np.divmod(tree[top + 1], PLACES)
        at = row + i
        j = after[at]
        k = after[row + j]
        p = before[at]
        new = merges.made[r]
        padded[at], padded[row + j] = new, -1
        after[at] = k
        before[row + k] = i  # of column n nothing is read
        left, right = padded[row + p], padded[row + k]
        left[p < 0] = -1
        here = size + i
        tree[top + size + j] = NONE
        tree[top + here] = merges.leaves(new, right, i)
        leaf = merges.leaves(left, new, p)
        has = p >= 0
        tree[(top + size + p)[has]] = leaf[has]
        at = np.concatenate([here, size + j, np.where(has, size + p, here)])
        base = np.concatenate([top, top, top])
        lo = size
        while lo > 1:
            at >>= 1
            lo >>= 1
            pair = base + 2 * at
            tree[base + at] = np.minimum(tree[pair], tree[pair + 1])
        some = tree[top + 1] != NONE
        top, row = top[some], row[some]
    symbols[:] = padded.reshape(m, wide)[:, :n]


class Codec:
    """Encodes and decodes by one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        plain = not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        if (model["type"] != "BPE" or spec["normalizer"] != NORMALISER or spec["pre_tokenizer"] != CUTTER or not plain
                or spec["decoder"] or model["unk_token"] or model["dropout"] or model["continuing_subword_prefix"]
                or model["byte_fallback"] or model["ignore_merges"]):
            raise ValueError(f"not a tokenizer file of the covered family: {path}")
        library = Tokenizer.from_file(path)
        self.normaliser, self.cutter = library.normalizer, library.pre_tokenizer
        vocab = model["vocab"]
        self.merges = Merges(vocab, model["merges"])
        end = model["end_of_word_suffix"] or ""
        signs = byte_signs()
        self.byte_of = {s: b for b, s in enumerate(signs)}
        self.inner = np.array([vocab.get(s, -1) for s in signs])
        self.last = np.array([vocab.get(s + end, -1) for s in signs])
        self.tokens = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in added}
        self.fixed = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        longest_first = sorted(self.fixed, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.latin, self.beyond = latin_words(), re.compile(f"[^\x00-{chr(LATIN - 1)}]")
        self.known = dict(self.fixed)  # ids by word; an added token's text is never a word

    def words(self, text: str) -> list[str]:
        """Words of a text in order; an added token stands as its own text."""
        out, start = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += self._cut(text[start:m.start()])
            out.append(m.group())
            start = m.end()
        return out + self._cut(text[start:])

    def _cut(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.latin.findall(text.lower())
        normal = self.normaliser.normalize_str(text)
        byte_of = self.byte_of
        return [bytes([byte_of[c] for c in w]).decode("utf-8", "surrogateescape")
                for w, _ in self.cutter.pre_tokenize_str(normal)]

    def _learn(self, words: list[str]) -> None:
        """Put the ids of new words among the known ones."""
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        by_size: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            n = len(b)
            if n > SHORT:
                ids = self.inner[np.frombuffer(b, np.uint8)]
                ids[-1] = self.last[b[-1]]
                ids = merge_long(ids[ids >= 0].tolist(), self.merges)
                self.known[words[k]] = np.array(ids, "<u4").tobytes()
            else:
                by_size.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(k)
        for size, at in by_size.items():
            table = np.full((len(at), size), -1, dtype=np.int64)
            lengths = np.array([len(raw[k]) for k in at])
            flat = np.frombuffer(b"".join([raw[k] for k in at]), np.uint8)
            table[np.arange(size) < lengths[:, None]] = self.inner[flat]
            table[np.arange(len(at)), lengths - 1] = self.last[flat[np.cumsum(lengths) - 1]]
            gaps = (table < 0) & (np.arange(size) < lengths[:, None])
            if gaps.any():  # bytes the file has no sign for are left out
                table = np.take_along_axis(table, np.argsort(table < 0, axis=1, kind="stable"), axis=1)
            merge_short(table, self.merges)
            alive = table >= 0
            ids = table[alive].astype("<u4").tobytes()
            ends = np.cumsum(alive.sum(axis=1)) * 4
            self.known.update((words[k], ids[a:b]) for k, a, b in zip(at, [0, *ends[:-1].tolist()], ends.tolist()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush():
            met = set().union(*(words for _, words in held))
            new = met.difference(self.known)
            if len(self.known) + len(new) > CACHED:  # the worker forgets what it knows
                self.known = dict(self.fixed)
                new = met.difference(self.known)
            if new:
                self._learn(list(new))
            ids_of = self.known.__getitem__
            for i, words in held:
                out[i].append(b"".join(map(ids_of, words)))
            held.clear()

        for i, text in enumerate(texts):
            for piece in cut_text(text, SLICE, BLANK):
                held.append((i, self.words(piece)))
                size += len(piece)
                if size >= SLICE:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, joined by blanks (the file names no decoder)."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i in tokens])


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """The worker's codec of a tokenizer file."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row."""
    names = [f.split()[0] for f in ENCODED.split(", ")]

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = b.column(1)
            for lo, hi in runs(text_sizes(texts), 2 * SLICE):
                got = c.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(g) // 4 for g in got], pa.int64()),
                                                  pa.array(got, pa.binary())], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with the column ``decoded``."""
    names = [f.split()[0] for f in ENCODED.split(", ")] + ["decoded"]

    def run(batches):
        c = codec(path)
        for b in batches:
            ids = b.column(2)
            for lo, hi in runs(text_sizes(ids), 2 * SLICE):
                part = b.slice(lo, hi - lo)
                texts = [None if x is None else c.decode(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    return encoded.select(*names[:-1]).mapInArrow(run, ENCODED + ", decoded string")
