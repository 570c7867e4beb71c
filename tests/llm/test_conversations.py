"""Conversation repair against brute force over all edit strings."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from churnlens.llm import conversations, queries

from .conftest import SF

BLANK = re.compile(r"[^\x20\x09-\x0D]")
RIGHT = re.compile(r"(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def faults(turns):
    """blank, duplicate, truncated or None for each (role, text)."""
    seen, out = set(), []
    for role, text in turns:
        kept = [c for c in text if BLANK.match(c)]
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit, repaired) by keeping the least (cost, audit) per initials that came last."""
    best = {"": (0, "", ())}  # the initial that came last -> what led there; "" is the start
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        for _ in range(3):
            for s, (cost, audit, done) in list(states.items()):
                to = follow[s]
                new = (cost + 3, audit + "I", done + ((NAMES[to], ""),))
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states

    for (role, text), fault in zip(turns, faults(turns)):
        after = {}

        def offer(s, new):
            if s not in after or new[:2] < after[s][:2]:
                after[s] = new

        extra = 3 if fault == "truncated" else 0
        for s, (cost, audit, done) in inserted(dict(best)).items():
            offer(s, (cost + 4, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            to, initial = follow[s], role[:1]
            if initial == to or (initial == "s" and s == ""):
                offer(initial, (cost + extra, audit + "K", done + ((role, text),)))
            offer(to, (cost + 3 + extra, audit + "R", done + ((NAMES[to], text),)))
        best = after
    best = inserted(dict(best))
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def exhaustive(turns, most=3):
    """The least (cost, audit) over all edit strings with at most ``most`` Inserts in all."""
    found, bad = [], faults(turns)
    for edits in itertools.product("DKR", repeat=len(turns)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, bad)):
            continue
        for gaps in itertools.product(range(most + 1), repeat=len(turns) + 1):
            if sum(gaps) > most:
                continue
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
            fixed, state, cost = "", "", 0
            rest = iter(zip(turns, bad))
            for e in audit:
                wanted = "a" if state == "u" else "u"
                if e == "I":
                    cost, state = cost + 3, wanted
                    fixed += wanted
                    continue
                (role, _), fault = next(rest)
                if e == "D":
                    cost += 4
                    continue
                cost += (3 if e == "R" else 0) + (3 if fault == "truncated" else 0)
                state = wanted if e == "R" else role[:1] or "?"
                fixed += state
            if RIGHT.fullmatch(fixed):
                found.append((cost, audit))
    return min(found)


def expected(rows):
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of damaged rows in order."""
    out = {}
    for conv, turns in rows.items():
        pairs = [(role, text) for _, role, text in turns]
        bad, numbers = faults(pairs), [t for t, _, _ in turns if t is not None]
        cost, audit, done = cheapest(pairs)
        starts = [r[:1] for r, _ in pairs]
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, bad.count("blank"),
                     bad.count("duplicate"), bad.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())
    return out


def damage(rows):
    """The contract's damage, row by row; rows of a conversation in order of turn (nulls first), role, text digest."""
    out = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        out[conv] += [(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    for turns in out.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
    return out


def as_dict(df):
    got = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert len(out) == len(got)
    return out


def random_rows(rng, convs, longest):
    texts = ["Yes.", "No?", "open", " ", "", "a.b ", "x!\n", "Yes.", "é…", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for conv in range(convs):
        turns = rng.sample(range(-3, 3 * longest), rng.randint(1, longest))
        rows += [(conv, t, rng.choice(roles), rng.choice(texts)) for t in turns]
    return rows


def test_brute_forces_agree():
    rng = random.Random(3)
    for _ in range(150):
        turns = [(rng.choice(["user", "assistant", "system", "x", ""]), rng.choice(["A.", "b", "", "C!"])) for _ in range(rng.randint(0, 4))]
        assert cheapest(turns)[:2] == exhaustive(turns)


def test_random_conversations(llm):
    rng = random.Random(4)
    rows = random_rows(rng, 300, 9) + [(None, None, "user", "Hi."), (None, 2, "assistant", "Ho."), (500, None, "user", None),
                                      (500, None, "assistant", "B."), (501, 3, "user", "same."), (501, 3, "user", "same.")]
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = expected(damage(rows))
    assert as_dict(conversations.report(conversations.damaged(df), df)) == want


def test_state_is_carried_over_batches_and_giant_conversations(llm):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["A.", "B"]) + str(t % 700) + rng.choice([".", ""]))
            for t in range(3000)] + random_rows(rng, 40, 5)[:120]
    rows = [(c + 100 if c != 7 or k >= 3000 else c, t, r, x) for k, (c, t, r, x) in enumerate(rows)]
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = llm.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = as_dict(conversations.report(conversations.damaged(df), df))
    finally:
        llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == expected(damage(rows))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_brute_force(llm, sf):
    rows = [tuple(r) for r in llm.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op12_conversation_repair"](llm, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert as_dict(got) == expected(damage(rows))


def test_repaired_turns(llm):
    rows = [("c", 1, "user", "Hi.", 9), ("c", 2, "assistant", " ", 9), ("c", 3, "assistant", "Yes.", 9), ("c", 4, "system", "Go on.", 9),
            ("d", None, None, None, 9)]
    df = llm.createDataFrame(rows, "who string, nr long, role string, said string, place long")
    summary, turns = conversations.repair(df, conv="who", turn="nr", text="said")
    assert {r.who: r.audit for r in summary.collect()} == {"c": "KDKD", "d": "D"}
    assert [(r.who, r.role, r.text) for r in turns.orderBy("who", "place").collect()] == [("c", "user", "Hi."), ("c", "assistant", "Yes.")]


def test_no_rows(llm):
    none = llm.createDataFrame([], "conv_id long, turn long, role string, text string, audit string")
    assert conversations.report(conversations.damaged(none), none).count() == 0
    lost = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    one = llm.createDataFrame([(1, lost, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    row = conversations.report(conversations.damaged(one), one).first()
    assert (row.gaps, row.blank, row.cost, row.audit, row.repaired_sha256) == (0, 0, 0, "", hashlib.sha256(b"").hexdigest())
