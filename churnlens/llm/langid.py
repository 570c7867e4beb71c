"""Language ID by nearest centroid over normalised TF-IDF character n-grams.

A text becomes counts of its character 1- to 3-grams (lower case; everything
that is no letter is a word boundary), hashed into a fixed number of buckets,
weighted by 1 + log count and inverse document frequency and scaled to length
1. Each language is represented by several centroids (spherical k-means of its
sample), a text takes the language of the centroid with the largest cosine,
and it is rejected when that cosine is far below what the language's own
sample shows.

The model is fitted on a bounded sample of labelled rows: ``FIT_ROWS`` per
language, chosen by hash of the id so that it does not depend on the order or
number of files. Prediction reads whole texts, long ones slice by slice.

Defined results: null texts and texts without a letter are ``und`` with score
0 and rejected; an empty training set predicts ``und`` for all; ties go to the
alphabetically first language; other columns are untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import stage, worker_holds

PREDICTED = 100  # texts whose count and weight rows one worker holds at a time
BITS = 12  # buckets of hashed n-grams: 2**BITS
FIT_ROWS = 1000  # sample rows per language
CENTROIDS = 4  # per language
ROUNDS = 12
MARGIN = 0.35  # a text may be this fraction as near as the furthest sample row of its language
SLICE = 400_000  # characters handled at once
UND = "und"
#: Odd multipliers of the positions in an n-gram, and one offset per n.
WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
OFFSETS = np.array([0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def held_out(id_col: str):
    """crc32 of the id as text is divisible by 5; rows without an id are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_counts(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(texts x 2**bits counts, whether the text has a letter)."""
    size = 1 << bits
    out = np.zeros((len(texts), size), dtype=np.float32)
    lettered = np.zeros(len(texts), dtype=bool)
    run: list[tuple[int, str]] = []
    held = 0

    def flush():
        joined = "\n".join(t for _, t in run)
        rows = np.repeat([i for i, _ in run], [len(t) + 1 for _, t in run])[:len(joined)]
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[np.minimum(codes, 0x10FFFF)]
        lettered[np.unique(rows[letter])] = True
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one boundary after each word
        codes = np.where(letter, codes, 32)[keep].astype(np.uint64) + np.uint64(1)
        rows, letter = rows[keep], letter[keep]
        for n in (1, 2, 3):
            m = len(codes) - n + 1
            if m <= 0:
                break
            h = np.full(m, OFFSETS[n - 1], dtype=np.uint64)
            for k in range(n):
                h += codes[k:k + m] * WEIGHTS[k]
                h ^= h >> np.uint64(29)
            h *= WEIGHTS[0]
            ok = rows[:m] == rows[n - 1:]
            ok &= letter[:m] if n == 1 else (letter[:m] | letter[1:m + 1])
            at = rows[:m][ok] * size + (h[ok] >> np.uint64(64 - bits)).astype(np.int64)
            low, high = run[0][0], run[-1][0] + 1
            got = np.bincount(at - low * size, minlength=(high - low) * size)
            out[low:high] += got.reshape(high - low, size)

    for i, t in enumerate(texts):
        t = t.lower()
        for lo in range(0, max(1, len(t)), SLICE):
            part = t[lo:lo + SLICE]
            if run and (held + len(part) > SLICE or len(run) >= 500):
                flush()
                run, held = [], 0
            run.append((i, part))
            held += len(part)
    if run:
        flush()
    return out, lettered


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1 (rows without a gram stay 0)."""
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(v: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """At most k unit centroids of unit rows; starts are the rows furthest from those chosen."""
    mean = v.mean(axis=0)
    start = [int(np.argmax(v @ mean))]
    near = v @ v[start[0]]
    while len(start) < min(k, len(v)):
        start.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[start[-1]])
    c = v[start]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == j].sum(axis=0) for j in np.unique(own)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Model:
    """Centroids (one row each), their languages, the least cosine accepted per centroid, and IDF weights."""
    langs: list[str]
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray
    bits: int = BITS

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        lang, score, rejected = [], [], []
        for lo in range(0, len(texts), PREDICTED):
            counts, lettered = gram_counts([t or "" for t in texts[lo:lo + PREDICTED]], self.bits)
            if not self.langs:
                lang += [UND] * len(lettered)
                score += [0.0] * len(lettered)
                rejected += [True] * len(lettered)
                continue
            cos = unit(counts, self.idf) @ self.centroids.T
            best = np.argmax(cos, axis=1)
            top = np.clip(cos[np.arange(len(best)), best], 0.0, 1.0)
            lang += [self.langs[b] if ok else UND for b, ok in zip(best.tolist(), lettered.tolist())]
            score += np.where(lettered, top, 0.0).tolist()
            rejected += (~lettered | (top < self.least[best])).tolist()
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})


def sample(docs: DataFrame, rows: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """At most ``rows`` labelled texts per language, by hash of the id (copies of one text have many hashes)."""
    slim = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    sizes = {r["lang"]: r["n"] for r in docs.where(F.col(lang_col).isNotNull()).groupBy(
        F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return slim.limit(0)
    # a hash threshold first (about twice the bound), so that the exact cut ranks bounded groups
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * rows / n)))])
    slim = slim.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    w = Window.partitionBy("lang").orderBy("h", F.col("text"))
    return slim.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows).select("lang", "text")


def fit(docs: DataFrame, rows: int = FIT_ROWS, centroids: int = CENTROIDS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> Model:
    """Centroids from at most ``rows`` labelled documents per language.

    Only sparse gram counts of the sample leave the first job; the driver gets
    one weight per bucket and the centroids.
    """
    size = 1 << bits

    def sparse(batches):
        for pdf in batches:
            counts, lettered = gram_counts(pdf["text"].tolist(), bits)
            at = [np.flatnonzero(c) for c in counts]
            yield pd.DataFrame({"lang": pdf["lang"], "at": at, "n": [c[i] for c, i in zip(counts, at)]})[lettered]

    grams = stage(sample(docs, rows, id_col, text_col, lang_col).mapInPandas(sparse, "lang string, at array<int>, n array<float>"),
                  "grams")
    total = grams.count()
    idf = np.full(size, np.log(1.0 + total) + 0.1)
    for r in grams.select(F.explode("at").alias("b")).groupBy("b").count().collect():  # at most 2**bits rows
        idf[r["b"]] = np.log((1.0 + total) / (1.0 + r["count"])) + 0.1

    def cluster(pdf):
        counts = np.zeros((len(pdf), size), dtype=np.float32)
        for i, (at, n) in enumerate(zip(pdf["at"], pdf["n"])):
            counts[i, at] = n
        v = unit(counts, idf)
        c = spherical_kmeans(v, centroids, ROUNDS)
        least = float((v @ c.T).max(axis=1).min())
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "c": [x.tobytes() for x in c.astype(np.float64)],
                             "least": least})

    got = sorted(grams.groupBy("lang").applyInPandas(cluster, "lang string, c binary, least double").collect(),
                 key=lambda r: (r["lang"], bytes(r["c"])))
    return Model([r["lang"] for r in got],
                 np.array([np.frombuffer(r["c"], dtype=np.float64) for r in got]).reshape(len(got), size),
                 np.array([MARGIN * r["least"] for r in got]), idf, bits)


def identify(docs: DataFrame, model: Model, into: str, text_col: str = "text") -> DataFrame:
    """Adds column ``into``: struct of lang, score (cosine, 0 to 1) and rejected; no shuffle."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        worker_holds("languages", _letters.cache_clear)
        return model.predict(text.tolist())

    return docs.withColumn(into, predict(F.col(text_col)))
