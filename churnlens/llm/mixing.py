"""Mixing sources to target weights by blocks drawn per output shard.

The words of a source, in a fixed order of its documents, are cut into blocks
of a fixed length. Output shards of a fixed number of slots draw how many
slots each source gets (multinomial, seeded by the shard); the slots of a
source are numbered across shards and its n-th slot reads the block that a
pseudorandom permutation of the source's block numbers assigns to it, so
shards need no shuffle buffer and every pass over a source reads each block
once. Slots and blocks meet in one join by (source, block). Draws above a
source's quota (a few, by chance) are dealt to sources that drew too little,
so each source's taken words differ from its target by less than two blocks.

Targets: weights 5, 2, 1, repeating over the sources by code point (null
last), share the words of all sources; a source is read at most three times,
and what it cannot give is shared again by weight.

Only one number per source goes through the driver (a mixture names its
sources). Defined results: null or empty texts have size 0 and take nothing;
rows without a source form a source of their own; repeated rows are separate
documents; no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import prefix_sums, stage, word_count, worker_holds

WEIGHTS = (5, 2, 1)
MOST = 3  # passes over a source
BLOCK = 64  # words
SLOTS = 4096  # blocks of an output shard
SEED = 20240607


def targets(sizes: list[int], weights=WEIGHTS, most: int = MOST) -> list[float]:
    """Words each source gives: weights share all words, capped at ``most`` times a source's size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out: dict[int, float] = {}
    total = float(sum(sizes))
    while True:
        free = [i for i in range(len(sizes)) if i not in out]
        rest = total - sum(out.values())
        parts = sum(weight[i] for i in free)
        share = {i: rest * weight[i] / parts for i in free}
        over = [i for i in free if share[i] > most * sizes[i]]
        if not over:
            out.update(share)
            return [out[i] for i in range(len(sizes))]
        out.update((i, float(most * sizes[i])) for i in over)


def quotas(sizes: list[int], wanted: list[float], block: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, slots) of each source: whole passes plus the blocks nearest to the rest."""
    blocks = np.array([-(-n // block) for n in sizes], dtype=np.int64)
    slots = []
    for n, b, t in zip(sizes, blocks.tolist(), wanted):
        passes = min(MOST, int(t // n)) if n else 0
        slots.append(passes * b + min(b, round((t - passes * n) / block)) if passes < MOST else MOST * b)
    return blocks, np.array(slots, dtype=np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of ``index`` (values below n) under a pseudorandom permutation of 0..n-1.

    A four-round Feistel network on the smallest even number of bits that holds
    n, applied again to images that fall outside.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = _mixed(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class Mix:
    """A planned mix: documents placed in their source's word stream, and what each source gives."""
    rows: DataFrame  # doc_id, source, source_no, size, text_hash, at (first word in the source's stream)
    sources: list
    sizes: list[int]
    targets: list[float]
    block: int
    per_shard: int
    seed: int

    def slots(self) -> DataFrame:
        """(shard, source_no, epoch, block) of every slot of the mix."""
        spark = self.rows.sparkSession
        blocks, quota = quotas(self.sizes, self.targets, self.block)
        total, per_shard, seed = int(quota.sum()), self.per_shard, self.seed
        shards = -(-total // per_shard)
        if not total:
            return spark.createDataFrame([], "shard long, source_no int, epoch long, block long")

        def draw(batches):
            for pdf in batches:
                for shard in pdf["id"]:
                    n = min(per_shard, total - shard * per_shard)
                    got = np.random.default_rng([seed, int(shard)]).multinomial(n, quota / total)
                    yield pd.DataFrame({"shard": shard, "source_no": np.flatnonzero(got).astype(np.int32),
                                        "n": got[got > 0]})

        drawn = stage(spark.range(shards).mapInPandas(draw, "shard long, source_no int, n long"), "drawn")
        numbered = prefix_sums(drawn, "source_no", ["shard"], "n", "before", rows=shards)
        got = np.zeros(len(quota), np.int64)
        for r in drawn.groupBy("source_no").agg(F.sum("n").alias("n")).collect():  # one row per source
            got[r["source_no"]] = r["n"]
        # slots beyond a quota are numbered through all sources and go to sources that lack as many
        extra = np.concatenate([[0], np.cumsum(np.maximum(got - quota, 0))])
        lacking = np.concatenate([[0], np.cumsum(np.maximum(quota - got, 0))])

        def read(batches):
            for pdf in batches:
                for shard, s, n, before in pdf[["shard", "source_no", "n", "before"]].itertuples(index=False):
                    slot = before + np.arange(n)
                    source = np.full(n, s)
                    over = slot >= quota[s]
                    place = extra[s] + slot[over] - quota[s]
                    source[over] = np.searchsorted(lacking, place, side="right") - 1
                    slot[over] = got[source[over]] + place - lacking[source[over]]
                    for t in np.unique(source):
                        own = slot[source == t]
                        epoch, index = own // blocks[t], own % blocks[t]
                        yield pd.DataFrame({"shard": shard, "source_no": np.int32(t), "epoch": epoch,
                                            "block": permuted(index, int(blocks[t]), seed + 7919 * int(t))})

        return numbered.select("shard", "source_no", "n", "before").mapInPandas(
            read, "shard long, source_no int, epoch long, block long")

    def pieces(self) -> DataFrame:
        """What each slot reads: (shard, source_no, epoch, block, doc_id, text_hash, at, start, words), start within the document."""
        b = self.block
        held = self.rows.where("size > 0").withColumn("block", F.explode(
            F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))))
        first = F.greatest(F.col("at"), F.col("block") * b)
        end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b)
        held = held.select("source_no", "block", "doc_id", "text_hash", "at", (first - F.col("at")).alias("start"),
                           (end - first).alias("words"))
        return held.join(self.slots(), ["source_no", "block"])


def plan_mix(docs: DataFrame, block: int = BLOCK, per_shard: int = SLOTS, seed: int = SEED, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source") -> Mix:
    slim = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
                             word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash")),
                 "sizes")
    found = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sources, sizes = [r["source"] for r in found], [r["size"] for r in found]
    numbers = slim.sparkSession.createDataFrame([(s, i) for i, s in enumerate(sources)],
                                                f"_source {slim.schema['source'].dataType.simpleString()}, source_no int")
    slim = slim.join(F.broadcast(numbers), slim["source"].eqNullSafe(numbers["_source"])).drop("_source")
    rows = prefix_sums(slim, "source_no", ["doc_id", "text_hash", "size"], "size", "at", rows=sum(r["n"] for r in found))
    return Mix(stage(rows, "placed"), sources, sizes, targets(sizes) if sizes else [], block, per_shard, seed)


def taken_words(mix: Mix) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken."""
    spark = mix.rows.sparkSession
    # a document with words is known by its source and first word
    used = mix.pieces().groupBy("source_no", "at").agg(F.sum("words").alias("taken"))
    rows = mix.rows.where("size > 0").join(used, ["source_no", "at"], "left")
    rows = rows.unionByName(mix.rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    facts = spark.createDataFrame([(i, int(n), float(t)) for i, (n, t) in enumerate(zip(mix.sizes, mix.targets))],
                                  "source_no int, source_size long, target double")
    return rows.join(F.broadcast(facts), "source_no").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def cut_text(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words of the ranges (first word, number) of a text, with the white space inside a run of ranges."""
    runs: list[list[int]] = []
    for start, n in sorted(ranges):
        if runs and runs[-1][1] == start:
            runs[-1][1] += n
        else:
            runs.append([start, start + n])
    words, at, parts = WORDS.finditer(text), 0, []  # one pass; only the ends of runs are looked at
    for a, b in runs:
        first = last = next(islice(words, a - at, None))
        if b - a > 1:
            last = next(islice(words, b - a - 2, None))
        parts.append(text[first.start():last.end()])
        at = b
    if [a for a, _ in runs] == [0] and next(words, None) is None:
        return text
    return "\n".join(parts)


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix as documents: one row per document and pass over its source, with the words that pass takes.

    Documents meet their pieces by id and text, so rows equal in both should
    have been deduplicated before.
    """
    parts = mix.pieces().groupBy("doc_id", "text_hash", "at", "epoch").agg(
        F.collect_list(F.struct("start", "words")).alias("_ranges"))
    parts = stage(parts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_ranges"), "parts")

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, words: pd.Series) -> pd.Series:
        worker_holds("mixing")
        return pd.Series([cut_text(t, list(zip(a.tolist(), n.tolist()))) for t, a, n in zip(text, starts, words)], dtype=object)

    met = docs.join(parts, docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_hash")))
    return met.select(*[cut(docs[c], F.col("_ranges.start"), F.col("_ranges.words")).alias(c) if c == text_col else docs[c] for c in docs.columns])
