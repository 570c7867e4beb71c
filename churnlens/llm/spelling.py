"""Spelling variants: words that differ by one code point, by pairs of trie nodes.

The words stand in a trie and, read backwards, in a second one, whose nodes are
numbered. A word without its i-th code point is the integer pair (node of what
stands before it, node of what stands after it); a word with a gap at place i
is the pair of the nodes on both sides. Equal pairs are exact neighbours: two
words that skip a place differ by one replaced code point, a skip that meets a
gap is one deletion. Of equal code points in a row only the first is skipped to
delete, so every neighbour is met once. A pair holds at most one word per
letter and one gap (not more than 91 rows), so it is gathered whole, and no
list of word pairs is formed: each word learns from a pair its number of
neighbours there and the commonest of them.

Numbering: words are dealt by range and sorted, and a task numbers the nodes a
word adds to the one before it; nodes that reach over the border of two ranges
are prefixes of the first word of a range and are numbered beforehand (one
word per range goes to the driver). No prefix is ever written out, so a word of
length L costs L numbers, however long.

Defined results: null texts hold no words, a null id is written as an empty
string where ids are hashed; repeated rows count again; equal counts go to the
smallest word in code-point order; no rows give no words. Other columns are
ignored and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.llm.common import stage

RUN = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 5, 3
MISSPELT = 97  # one run of so many loses a code point
TIMES = 2  # a form is at least so many times as common
NODES = 1 << 40  # nodes one range may add


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT, misspelt: int | None = MISSPELT) -> DataFrame:
    """(word, n): letter runs in lower case, counted over all texts; every ``misspelt``-th run by hash loses a code point."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    word = F.col("_run")
    if misspelt:
        h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
        at = (h % F.char_length("_run")).cast("int")
        word = F.when(h % misspelt == 0, F.concat(F.substring("_run", F.lit(1), at), F.substr("_run", at + 2))).otherwise(word)
    counted = words.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(
        F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def common_length(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is common, a[:hi] is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def border_nodes(borders: dict[int, str]) -> dict[int, tuple[str, np.ndarray]]:
    """Node numbers (below zero) of all prefixes of the first word of each range."""
    out, fresh, last = {}, -1, ("", np.array([-1]))
    for part in sorted(borders):
        word = borders[part]
        same = common_length(last[0], word)
        new = len(word) - same
        last = (word, np.concatenate([last[1][:same + 1], fresh - 1 - np.arange(new)]))
        fresh -= new
        out[part] = last
    return out


def trie_nodes(words: DataFrame, key: str) -> DataFrame:
    """``words`` with ``place``, numbers in order of ``key``, and ``nodes``, the trie node of each prefix of ``key``
    (of length 0, 1, ...)."""
    dealt = stage(words.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "range")
    borders = border_nodes({r["_part"]: r["_first"] for r in dealt.groupBy("_part").agg(F.min(key).alias("_first")).collect()})
    following = dict(zip(sorted(borders), sorted(borders)[1:]))
    columns = list(words.columns)
    schema = T.StructType([*words.schema.fields, T.StructField("place", T.LongType()),
                           T.StructField("nodes", T.ArrayType(T.LongType()))])

    def run(batches):
        part, word, nodes, added, met, fixed = None, "", None, 0, 0, ()
        for b in batches:
            flat, sizes, places = [], [0], []
            for p, w in zip(b.column("_part").to_pylist(), b.column(key).to_pylist()):
                if p != part:
                    part, added, met = p, 0, 0
                    fixed = [borders[q] for q in (p, following.get(p)) if q is not None]
                    word, nodes = "", np.array([-1])
                same = common_length(word, w)
                new = np.arange(added, added + len(w) - same) + p * NODES
                added += len(w) - same
                nodes = np.concatenate([nodes[:same + 1], new])
                for first, numbers in fixed:  # prefixes shared with a border word bear its numbers
                    both = common_length(first, w)
                    nodes[:both + 1] = numbers[:both + 1]
                word = w
                places.append(p * NODES + met)
                met += 1
                flat.append(nodes)
                sizes.append(sizes[-1] + len(nodes))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(places, pa.int64()), lists],
                                             [*columns, "place", "nodes"])

    return dealt.repartition("_part").sortWithinPartitions("_part", key).mapInArrow(run, schema)


def pairs(words: DataFrame) -> DataFrame:
    """A row per word (place, n) and pair (left, right): its skips, and its gaps (``skip`` false).

    ``words`` has word, place, n and before, after: its nodes in both tries.
    ``deletes`` marks skips of a code point unlike the one before it.
    """
    letters = F.split("word", "")
    length = F.size("before") - 1

    def pair(left, right, skip, deletes):
        return F.struct(left.alias("left"), right.alias("right"), F.lit(skip).alias("skip"), deletes.alias("deletes"))

    skips = F.transform(letters, lambda c, i: pair(F.get("before", i), F.get("after", length - 1 - i), True, F.coalesce(
        c != F.get(letters, i - 1), F.lit(True))))
    gaps = F.transform("before", lambda b, i: pair(b, F.get("after", length - i), False, F.lit(False)))
    return words.select("place", "n", F.explode(F.concat(skips, gaps)).alias("_k")).select("place", "n", "_k.*")


def neighbours(keys: DataFrame) -> DataFrame:
    """(place, n_near, best) of every word with a near word; best is (minus n, place), so the least is the commonest
    and then the smallest word."""
    member = F.struct((-F.col("n")).alias("minus"), "place", "skip", "deletes")
    met = keys.groupBy("left", "right").agg(F.array_sort(F.collect_list(member)).alias("all")).where(F.size("all") > 1)

    def ranked(condition):
        return F.transform(F.slice(F.filter("all", condition), 1, 2), lambda x: F.struct(x["minus"], x["place"]))

    def number(condition):
        return F.size(F.filter("all", condition))

    met = met.select(
        "all", ranked(lambda x: x["skip"]).alias("skips"), ranked(lambda x: x["deletes"]).alias("longer"),
        ranked(lambda x: ~x["skip"]).alias("gaps"), number(lambda x: x["skip"]).alias("n_skips"),
        number(lambda x: x["deletes"]).alias("n_longer"))
    each = met.select("skips", "longer", "gaps", "n_skips", "n_longer", F.explode("all").alias("me"))
    skip, deletes, gap = F.col("me.skip"), F.col("me.deletes"), F.get("gaps", F.lit(0))
    first = F.get("skips", F.lit(0))  # the commonest that is not the word itself
    other = F.when(first["place"] == F.col("me.place"), F.get("skips", F.lit(1))).otherwise(first)
    near = F.when(skip, F.col("n_skips") - 1 + F.when(deletes, F.size("gaps")).otherwise(0)).otherwise(F.col("n_longer"))
    best = F.when(skip & deletes, F.least(other, gap)).when(skip, other).otherwise(F.get("longer", F.lit(0)))
    found = each.select(F.col("me.place").alias("place"), near.cast("long").alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("place").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last; the way doubles each round, and counts at least double
    per step, so rounds are few."""
    ways = stage(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ways = stage(ways.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                          F.col("_next").isNotNull().alias("_moved")), "ways")
        if ways.where("_moved").isEmpty():
            return ways.drop("_moved")
        ways = ways.drop("_moved")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of a vocabulary (word, n) of distinct words."""
    words = stage(words.select("word", "n"), "words")
    forward = stage(trie_nodes(words, "word").withColumnRenamed("nodes", "before"), "forward")
    backward = trie_nodes(words.select(F.reverse("word").alias("drow")), "drow")
    backward = backward.select(F.reverse("drow").alias("word"), F.col("nodes").alias("after"))
    near = neighbours(pairs(forward.join(backward, "word")))
    numbered = forward.select("place", "word", "n")
    common = -F.col("best.minus") >= times * F.col("n")
    out = numbered.join(near, "place", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("best.place")).alias("_form"), F.when(common, -F.col("best.minus")).alias("form_n"))
    named = numbered.select(F.col("place").alias("_form"), F.col("word").alias("form"))
    out = stage(out.join(named, "_form", "left").drop("_form"), "forms")
    roots = follow(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
