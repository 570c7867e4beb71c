"""Approximate nearest neighbours with learned partitions.

A bounded sample is joined into a neighbour graph, the graph is cut into parts
of equal size so that few neighbours are parted, and a softmax classifier
learns which part a vector belongs to. Every row is indexed in its most
probable part; a query goes to its several most probable parts, and all rows of
those are compared with it exactly.

Only the sample (``SAMPLE`` vectors) is handled by the driver. Parts are split
into blocks of a bounded number of rows and queries of a part into groups, so a
task compares one block with one group whatever the size of a part; each sends
on its best few rows per query only.

Defined results: vectors that are null, of another length than the first
valid one of the sample's most common length, zero, or with a null or
non-finite component take no part (as query or candidate); a query's own row
is no candidate, other rows with its id neither; ties go to the smaller id;
fewer candidates than wanted give fewer rows; no valid vector gives no row.
Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import stage

SAMPLE = 8192  # vectors the partitions are learned from
PARTS = 32
NEIGHBOURS = 10  # in the graph
PROBES = 16  # parts a query is sent to
BLOCK = 2048  # rows of a part compared by one task
GROUP = 512  # queries compared with a block at once
TOP = 5
PRECISE = 1e-6  # candidates this close to the last kept one are kept for the exact order


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows with a usable vector."""
    v = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null")
    return out.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k most similar rows of each unit row (blocks of rows at a time)."""
    out = np.empty((len(x), k), dtype=np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo:lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo:lo + len(s)] = np.argpartition(-s, min(k, s.shape[1] - 1) - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each row: equal sizes, most neighbours in one part.

    Starts from balanced cuts along principal directions (recursive halving);
    then rows move to the part most of their neighbours are in, those with the
    largest gain first, as far as sizes stay within 5 %.
    """
    part = np.zeros(len(x), dtype=np.int64)
    made = 1
    while made < parts:
        for p in range(made):
            own = np.flatnonzero(part == p)
            y = x[own] - x[own].mean(axis=0)
            direction = np.linalg.svd(y, full_matrices=False)[2][0] if len(own) > 1 else np.zeros(x.shape[1])
            part[own[np.argsort(y @ direction, kind="stable")[len(own) // 2:]]] = p + made
        made *= 2
    most, least = int(np.ceil(1.05 * len(x) / made)), int(0.95 * len(x) / made)
    for _ in range(rounds):
        votes = np.zeros((len(x), made), dtype=np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        size = np.bincount(part, minlength=made)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most and size[part[i]] > least:
                size[best[i]] += 1
                size[part[i]] -= 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def train_router(x: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression (weights, bias) towards ``target`` rows (distributions), by full-batch Adam."""
    rng = np.random.default_rng(5)
    w = 0.01 * rng.standard_normal((x.shape[1], target.shape[1]))
    b = np.zeros(target.shape[1])
    m = [np.zeros_like(w), np.zeros_like(b)]
    s = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        z = x @ w + b
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        g = (e / e.sum(axis=1, keepdims=True) - target) / len(x)
        for i, (theta, grad) in enumerate(((w, x.T @ g + 1e-5 * w), (b, g.sum(axis=0)))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            s[i] = 0.999 * s[i] + 0.001 * grad ** 2
            theta -= rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(s[i] / (1 - 0.999 ** t)) + 1e-8)
    return w, b


@dataclass
class Router:
    weights: np.ndarray
    bias: np.ndarray
    length: int

    def order(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each unit row, the most probable first."""
        z = x @ self.weights + self.bias
        return np.argsort(-z, axis=1, kind="stable")[:, :n]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: cosines stay the same to the last bit,
    and squares of huge or tiny components neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(vectors: DataFrame, sample: int = SAMPLE, parts: int = PARTS, neighbours: int = NEIGHBOURS) -> Router | None:
    """Fit on at most ``sample`` rows, those with the smallest hashes of their id."""
    lengths = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return None
    length, rows = lengths["n"], lengths["count"]
    same = vectors.where(F.size("v") == length)
    share = min(1.0, 1.2 * sample / rows)
    same = same.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share * (1 << 30))
    got = same.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().column("v")
    x = unit(np.array(got.to_pylist(), dtype=np.float64).reshape(-1, length))
    parts = 1 << max(0, min(parts, len(x) // 64).bit_length() - 1)
    if parts == 1:
        return Router(np.zeros((length, 1)), np.zeros(1), length)
    graph = neighbour_graph(x, min(neighbours, len(x) - 1))
    part = balanced_parts(x, graph, parts)
    # a vector's target is where its neighbours are, its own part counting like all neighbours together
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    target[np.arange(len(x)), part] += graph.shape[1]
    return Router(*train_router(x, target / target.sum(axis=1, keepdims=True)), length)


def routed(rows: DataFrame, router: Router, probes: int) -> DataFrame:
    """(vec_id, v, part) for each of the row's ``probes`` most probable parts."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = unit(np.stack(pdf["v"].to_numpy()))
                order = router.order(x, probes)
                out = pdf.loc[pdf.index.repeat(order.shape[1])].reset_index(drop=True)
                out["part"] = order.ravel()
                yield out

    return rows.mapInPandas(run, "vec_id long, v array<double>, part int")


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision."""
    q, x = scaled(q), scaled(x)
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def search(vectors: DataFrame, is_query, top: int = TOP, probes: int = PROBES, id_col: str = "vec_id",
           vec_col: str = "embedding", sample: int = SAMPLE, parts: int = PARTS, block: int = BLOCK,
           group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found of every query row.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = stage(valid(vectors, id_col, vec_col), "vectors")
    router = learn(rows, sample, parts)
    if router is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == router.length)
    index = stage(routed(rows, router, 1), "index")
    queries = stage(routed(rows.where(is_query), router, probes), "queries")
    # each part has as many blocks as its size asks for, and its queries as many groups
    blocks = {r["part"]: -(-r["count"] // block) for r in index.groupBy("part").count().collect()}  # one row per part
    groups = {r["part"]: -(-r["count"] // group) for r in queries.groupBy("part").count().collect()}
    cells = index.sparkSession.createDataFrame(
        [(p, b, g) for p, b in blocks.items() for g in [groups.get(p, 0)] if g], "part int, blocks long, groups long")
    at = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = index.join(F.broadcast(cells), "part").withColumn("b", at("blocks")).withColumn("g", span("groups"))
    right = queries.join(F.broadcast(cells), "part").withColumn("g", at("groups")).withColumn("b", span("blocks"))
    both = left.select("part", "b", "g", "vec_id", "v", F.lit(False).alias("asks")).unionByName(
        right.select("part", "b", "g", "vec_id", "v", F.lit(True).alias("asks")))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        out = []
        if len(q) and len(c):
            ids = c["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")  # equal scores stay in the order of ids
            ids, raw = ids[order], np.stack(c["v"].to_numpy()[order])
            near = unit(np.stack(q["v"].to_numpy())) @ unit(raw).T
            for i, (qid, qv) in enumerate(zip(q["vec_id"].tolist(), q["v"])):
                s = np.where(ids == qid, -np.inf, near[i])
                keep = min(top, len(s))
                least = np.partition(s, len(s) - keep)[len(s) - keep]
                got = np.flatnonzero((s >= least - PRECISE) & (s > -np.inf))
                exact = cosine(np.broadcast_to(qv, (len(got), len(qv))), raw[got])
                best = np.lexsort((ids[got], -exact))[:top]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[got][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = both.groupBy("part", "b", "g").applyInPandas(compare, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
