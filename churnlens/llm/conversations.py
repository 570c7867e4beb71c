"""Conversation structure repair by secondary-sorted streaming.

A repaired conversation has roles whose initials read ``(s?(ua)+)?``: it may
begin with a system turn, then user and assistant alternate. Edits are Keep
(free), Rerole to user or assistant (3), Delete (4) and Insert of an empty
user or assistant turn (3); blank and repeated turns must be deleted, and a
truncated turn that stays costs 3 more. The cheapest edits win, then the
ASCII-least string of their initials.

Turns are first counted by (conversation, turn, role, text), so repeats travel
once. Slim rows (no texts) are dealt by conversation and sorted by turn, last
turn first; a task streams over them and carries, across Arrow batches, what
the rest of the conversation costs from each of four states. For every turn it
yields the best edit per state, two bits each: these back pointers leave the
task as rows of a table in the shared folder, so a giant conversation needs no
memory. A second stream, first turn first, follows the pointers and yields the
edits; texts meet them again in a plain join.

Defined results: null roles and texts count as one blank, null conversations
are one conversation, null turns come first. Rows of one turn are ordered by
role, then by the SHA-256 of the text (copies of a row stand together). An
empty role has no initial and no legal neighbour. A conversation without rows
has no summary row. Other columns are ignored and may have any name; no rows
give no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import stage

NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDS_OPEN = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"  # the last sign that is not white space ends no sentence
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 60  # cost of what cannot be
START, SYSTEM, USER, ASSISTANT = range(4)  # state: the initial that came last
LETTERS = "DIKR"  # edits in ASCII order, numbered by two bits
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what Insert and Rerole lead to
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
KEY = ["conv", "has_turn", "turn", "role", "digest"]

POINTERS = ("conv string, has_turn boolean, turn long, role string, digest binary, n long, fresh boolean, "
            "pointers int, blank long, duplicate long, truncated long, illegal long, gaps long, cost long")
EDITS = ("conv string, has_turn boolean, turn long, role string, digest binary, place long, edit string, "
         "new_role string, audit string")


def run_lengths(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per distinct (conversation, turn, role, text) with its count n and the flags of its text."""
    flat = rows.select(
        # a name that no null shares; conversations may have any type that can be cast
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("conv"),
        F.col(turn).isNotNull().alias("has_turn"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    counted = flat.groupBy(*flat.columns).agg(F.count("*").alias("n"))
    return counted.withColumns({
        "digest": F.unhex(F.sha2("text", 256)), "blank": ~F.col("text").rlike(NOT_BLANK),
        "open": F.col("text").rlike(ENDS_OPEN)})


def first_seen(runs: DataFrame) -> DataFrame:
    """``fresh`` marks the run in which a (role, text) of a conversation comes first."""
    same = ["conv", "role", "digest"]
    first = runs.groupBy(*same).agg(F.min(F.struct("has_turn", "turn")).alias("_first"))
    return (runs.join(first, same).withColumn("fresh", F.struct("has_turn", "turn") == F.col("_first")).drop("_first"))


def best_edits(after: list[int], initial: str, extra: int) -> tuple[list[int], int]:
    """Costs from each state before a turn that may stay, and the pointers: the least letter of a cheapest edit."""
    kept = {"u": USER, "a": ASSISTANT}.get(initial)
    costs, pointers = [FAR] * 4, 0
    # an Insert leads to another state before the same turn: two in a row end at ASSISTANT, so that state goes first
    for _ in range(3):
        pointers = 0
        for s in range(4):
            to = NEXT[s]
            keep = after[to] if kept == to else after[SYSTEM] if initial == "s" and s == START else FAR
            options = (after[s] + DELETE, costs[to] + INSERT, keep + extra, after[to] + REROLE + extra)
            costs[s] = min(options)
            pointers |= options.index(costs[s]) << (2 * s)
    return costs, pointers


def at_end() -> list[int]:
    """Costs after the last turn: what is open is closed by Inserts."""
    return [0, 2 * INSERT, INSERT, 0]


class Backward:
    """What one conversation has gathered, last turn first."""

    def __init__(self, conv):
        self.conv, self.costs, self.later = conv, at_end(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last = self.first = self.seen = None

    def take(self, has_turn, turn, role, n, fresh, blank, is_open):
        """Pointers of a run of n equal turns: the first may stay, unless the run is blank or seen earlier."""
        stays = fresh and not blank
        gone = n - stays
        self.costs = [c + DELETE * gone for c in self.costs]
        initial = role[:1]
        pointers = 0  # Delete in every state
        if stays:
            self.costs, pointers = best_edits(self.costs, initial, TRUNCATED if is_open else 0)
            self.truncated += bool(is_open)
        if blank:
            self.blank += n
        else:
            self.duplicate += gone
        self.illegal += n - 1
        if self.later is not None:
            self.illegal += (initial + self.later) not in LEGAL
        self.later = initial
        if has_turn and turn != self.seen:
            self.turns += 1
            self.first = self.seen = turn
            self.last = turn if self.last is None else self.last
        return pointers

    def summary(self):
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        return [self.blank, self.duplicate, self.truncated, self.illegal, gaps, self.costs[START]]


def _backward(batches):
    """Pointers of every run, and after each conversation a row with its summary (its digest is null)."""
    names = [f.split()[0] for f in POINTERS.split(", ")]
    state = None
    for pdf in batches:
        out = []
        for conv, has, turn, role, digest, n, fresh, blank, is_open in pdf.itertuples(index=False, name=None):
            if state is None or conv != state.conv:
                if state is not None:
                    out.append([state.conv, None, None, None, None, None, None, None, *state.summary()])
                state = Backward(conv)
            out.append([conv, has, turn, role, digest, n, fresh and not blank,
                        state.take(has, turn, role, n, fresh, blank, is_open), *[None] * 6])
        yield pd.DataFrame(out, columns=names, dtype=object)
    if state is not None:
        yield pd.DataFrame([[state.conv, *[None] * 7, *state.summary()]], columns=names, dtype=object)


class Forward:
    """Follows the pointers of one conversation, first turn first."""

    def __init__(self, conv):
        self.conv, self.state, self.place, self.audit = conv, START, 0, bytearray()

    def _edit(self, key, letter, role, out):
        out.append([self.conv, *key, self.place, letter, role, None])
        self.audit += letter.encode()
        self.place += 1

    def _insert(self, out):
        self.state = NEXT[self.state]
        self._edit((None, None, None, None), "I", ROLES[self.state], out)

    def take(self, key, role, n, stays, pointers, out):
        if stays:
            while (letter := LETTERS[pointers >> (2 * self.state) & 3]) == "I":
                self._insert(out)
            if letter == "D":
                self.audit += b"D"
            elif letter == "K":
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                self._edit(key, "K", role, out)
            else:
                self.state = NEXT[self.state]
                self._edit(key, "R", ROLES[self.state], out)
        self.audit += b"D" * (n - stays)

    def end(self, out):
        while self.state in (SYSTEM, USER):
            self._insert(out)
        out.append([self.conv, *[None] * 7, self.audit.decode()])


def _forward(batches):
    """A row per turn that stays or is put in, and after each conversation a row with its audit."""
    names = [f.split()[0] for f in EDITS.split(", ")]
    state = None
    for pdf in batches:
        out: list = []
        for conv, has, turn, role, digest, n, stays, pointers in pdf.itertuples(index=False, name=None):
            if state is None or conv != state.conv:
                if state is not None:
                    state.end(out)
                state = Forward(conv)
            state.take((has, turn, role, digest), role, int(n), bool(stays), int(pointers), out)
        yield pd.DataFrame(out, columns=names, dtype=object)
    if state is not None:
        out = []
        state.end(out)
        yield pd.DataFrame(out, columns=names, dtype=object)


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda x, y: x & y, [a[k] == b[k] for k in keys])


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(summary, turns): counts, cost and audit per conversation, and its repaired turns in order of ``place``."""
    kind = rows.schema[conv].dataType
    runs = stage(run_lengths(rows, conv, turn, role, text), "runs")
    slim = first_seen(runs.drop("text")).select(*KEY, "n", "fresh", "blank", "open")
    last_first = [F.col("conv"), *[F.col(k).desc() for k in KEY[1:]]]
    back = stage(slim.repartition("conv").sortWithinPartitions(*last_first).mapInPandas(_backward, POINTERS), "pointers")
    turns = back.where("digest is not null").select(*KEY, "n", "fresh", "pointers")
    edits = stage(turns.repartition("conv").sortWithinPartitions(*KEY).mapInPandas(_forward, EDITS), "edits")

    def named(df):
        return F.when(df["conv"] != "", F.substr(df["conv"], F.lit(2))).cast(kind).alias(conv)

    counts = back.where("digest is null").select("conv", "blank", "duplicate", "truncated", "illegal", "gaps", "cost")
    audits = edits.where("place is null").select("conv", "audit")
    summary = counts.join(audits, "conv")
    summary = summary.select(named(summary), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    placed = edits.where("place is not null").drop("audit")
    put_in = placed.where("digest is null").select(
        named(placed), "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    stay = placed.where("digest is not null")
    stay = stay.join(runs, _same(stay, runs, KEY)).select(
        named(stay), stay["place"], stay["edit"], stay["new_role"].alias("role"), runs["text"])
    return summary, stay.unionByName(put_in)


def digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """sha256 of each conversation's ``role:text`` lines, streamed in order of ``place``."""
    kind = turns.schema[conv].dataType

    def run(batches):
        name, found = None, None
        for pdf in batches:
            out = []
            for c, line in pdf.itertuples(index=False, name=None):
                raw = line.encode("utf-8", "surrogatepass")
                if found is None or c != name:
                    if found is not None:
                        out.append((name, found.hexdigest()))
                    name, found = c, hashlib.sha256(raw)
                else:
                    found.update(b"\n" + raw)
            yield pd.DataFrame(out, columns=["conv", "sha"])
        if found is not None:
            yield pd.DataFrame([(name, found.hexdigest())], columns=["conv", "sha"])

    lines = turns.select(F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("conv"),
                         "place", F.concat_ws(":", "role", "text").alias("line"))
    got = lines.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "line").mapInPandas(
        run, "conv string, sha string")
    return got.select(F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).cast(kind).alias(conv),
                      F.col("sha").alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """The fixed damage of the query: rows dropped, emptied, stripped of sentence ends, repeated or given to the user."""
    def text_of(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), case.alias("_case"))
    out = out.where("_case <> 0").withColumns({
        "text": F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("_case") == 4, "user").otherwise(F.col("role"))})
    copies = F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("_copy", F.explode(copies)).drop("_case", "_copy")


def report(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """One row per original conversation: its summary and the digest of its repaired turns."""
    summary, turns = repair(rows)
    sha = digests(turns)
    every = originals.select("conv_id").distinct()
    got = every.join(summary, every["conv_id"].eqNullSafe(summary["conv_id"]), "left").drop(summary["conv_id"])
    got = got.join(sha, got["conv_id"].eqNullSafe(sha["conv_id"]), "left").drop(sha["conv_id"])
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return got.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
