"""Language ID, exact dedup, personal data, secrets and licenses against plain Python."""
import base64
import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import pytest

from churnlens.llm import exact_dedup, langid, licenses, pii, queries, secrets
from pyspark.sql import functions as F

from .conftest import EDGES, SF


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, x) for x in r])


# --- language ID ---------------------------------------------------------------------------------------

def test_langid_predicts_held_out_documents(llm, docs):
    got = queries.QUERIES["op1_language_id"](llm, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in llm.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert not any(r.rejected for r in got)


def test_langid_defined_results(llm, edges, docs, nothing):
    model = langid.fit(docs.where(~langid.held_out("doc_id")), rows=40)
    got = langid.identify(edges, model, "lid").select("text", "lid.*").collect()
    assert len(got) == len(EDGES)
    for r in got:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang == "und") == (not lettered)
        if not lettered:
            assert r.score == 0 and r.rejected
    other = langid.identify(llm.createDataFrame([("日本語の文章です。これは拒否されるべきです。",)], "text string"), model, "lid")
    assert other.select("lid.rejected").first()[0]
    empty = langid.fit(nothing)
    assert langid.identify(edges, empty, "lid").select("lid.lang").distinct().collect() == [("und",)]
    assert langid.identify(nothing, model, "lid").count() == 0


def test_langid_long_texts_are_read_whole(monkeypatch):
    text = "der die das und " * 500 + "le la les et " * 500
    whole, _ = langid.gram_counts([text])
    monkeypatch.setattr(langid, "SLICE", 1000)
    sliced, _ = langid.gram_counts([text])
    assert abs(whole.sum() - sliced.sum()) < 0.01 * whole.sum()


# --- exact dedup ---------------------------------------------------------------------------------------

def brute_exact(data):
    groups = defaultdict(list)
    for i, t in data:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        first = min(range(len(members)), key=lambda k: (-len(members[k][1]), members[k][0] is None, members[k][0] or 0))
        out += [(i, members[first][0], len(members), k == first, hashlib.sha256(norm.encode()).hexdigest(), False)
                for k, (i, _) in enumerate(members)]
    return sorted(out, key=lambda r: [(x is None, x) for x in r])


def test_exact_dedup_against_brute_force(llm, edges, nothing):
    got = exact_dedup.exact_dedup(edges, exact_dedup.DigestIndex(llm))
    assert rows(got) == brute_exact([(r[0], r[1]) for r in EDGES])
    kept = exact_dedup.kept_documents(edges, got)
    assert kept.columns == edges.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "6", "7", "8", "9", "None"]
    assert exact_dedup.exact_dedup(nothing, exact_dedup.DigestIndex(llm)).count() == 0


def test_digest_index_keeps_batches_apart(llm):
    index = exact_dedup.DigestIndex(llm, buckets=4)
    one = llm.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    two = llm.createDataFrame([(4, "a  b"), (5, "d"), (6, "d")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.exact_dedup(one, index).where("kept").collect()} == {1, 3}
    got = {r.doc_id: (r.kept, r.known, r.keep_id) for r in exact_dedup.exact_dedup(two, index).collect()}
    assert got == {4: (False, True, 1), 5: (True, False, 5), 6: (False, False, 5)}
    assert index.read().count() == 3
    plan = index.missing(one.select(F.unhex(F.sha2("text", 256)).alias("digest")).repartition(4, "digest"))
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    index.drop()


def test_digest_index_outlives_its_session(llm, tmp_path):
    one = llm.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    two = llm.createDataFrame([(3, "a"), (4, "c")], "doc_id long, text string")
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(llm, "kept_index", path, buckets=3)
    exact_dedup.exact_dedup(one, index)
    index.drop()  # as a session without this catalogue sees it
    again = exact_dedup.DigestIndex(llm, "reopened_index", path, buckets=7)
    assert again.buckets == 3 and again.read().count() == 2
    assert {r.doc_id: r.kept for r in exact_dedup.exact_dedup(two, again).collect()} == {3: False, 4: True}
    assert again.read().count() == 3
    small = again.compacted(str(tmp_path / "compacted"))
    assert sorted(map(tuple, small.read().collect())) == sorted(map(tuple, again.read().collect()))
    small.drop()
    again.drop()


def test_repeated_batch_gets_its_first_answer(llm):
    index = exact_dedup.DigestIndex(llm, buckets=2)
    docs = llm.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    first = rows(exact_dedup.exact_dedup(docs, index, batch="monday"))
    assert rows(exact_dedup.exact_dedup(docs, index, batch="monday")) == first and index.read().count() == 2
    assert not any(r.kept for r in exact_dedup.exact_dedup(docs, index, batch="tuesday").collect())
    index.drop()


def test_of_repeated_rows_one_stays(llm):
    docs = llm.createDataFrame([(3, "a b"), (3, "a  b"), (3, "a  b"), (4, "a b")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs, exact_dedup.DigestIndex(llm))
    assert sorted(r.kept for r in got.collect()) == [False, False, False, True]
    assert [(r.doc_id, r.text) for r in exact_dedup.kept_documents(docs, got).collect()] == [(3, "a  b")]


# --- personal data -------------------------------------------------------------------------------------

# The contract's patterns as they stand; the operator writes them otherwise.
PII = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_pii(text):
    out = []
    for k, pattern in enumerate(PII):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (k == 1 and max(map(int, m.group().split("."))) > 255
                    or k == 2 and not (12 <= len(digits) <= 19 and luhn(digits)) or k == 3 and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, f"{pii.KINDS[k]}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


TRICKY = ["a@b.c_d@e.f x", "a@b a@b.c.", "1.2.3.4.5.6.7.8 300.1.1.1 00255.1.1.1 0.0.0.0", "4111 1111 1111 1111 x4111111111111111",
          "4111 1111 1111 1111 4111111111111111", "+1 (988) 555-2485 +1+12345678901 +12 + +1 2 3 4 5 6 7 8 9 0",
          "é😀 a.b@c.de 😀4111-1111-1111-1111é", "x@y.z\n@q.w a@@b.c 1.2.3 1..2.3.4", "1.1.1.1@2.2.2.2", "9" * 30000, "a" * 30000,
          "1 " * 9000, ".@" * 500, "a.b@c.d." * 300]


def test_pii_base_spans_against_plain_patterns(llm, docs, edges, nothing):
    data = [(i, t) for i, t in enumerate(TRICKY)] + [(3, "dup 10.0.0.1"), (3, "dup 10.0.0.1"), (None, "n 10.0.0.2")]
    data += [(r[0], r[1]) for r in EDGES] + [(1000 + r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    frame = llm.createDataFrame(data, "doc_id long, text string")
    got = Counter((r.doc_id, r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in pii.find_pii(frame).collect())
    want = Counter((i, hashlib.sha256((b := brute_pii(t)).encode()).hexdigest(), len(b.split(",")) if b else 0) for i, t in data)
    assert got == want
    assert pii.find_pii(nothing).count() == 0


def test_pii_discovers_unseen_identifiers_by_context(llm):
    data = [(i, f"please call helpdesk extension +1 555 010 {2000 + i} for info") for i in range(9)]
    data += [(20 + i, f"please call helpdesk extension {9000000 + 7 * i} for info") for i in range(3)]
    data += [(40 + i, f"in the year of {8100000 + i} nothing happened at all") for i in range(3)]
    got = {r.doc_id: (r.spans, r.n_discovered) for r in pii.find_pii(llm.createDataFrame(data, "doc_id long, text string")).collect()}
    for i in range(3):
        assert got[20 + i] == ("phone:31:38", 1)
        assert got[40 + i] == ("", 0)
    for i in range(9):
        assert got[i] == ("phone:31:46", 0)


def test_pii_accepted_instances_induce_patterns(llm):
    data = [(i, f"please call helpdesk extension +1 555 010 {2000 + i} for info") for i in range(9)]
    data += [(20 + i, f"please call helpdesk extension {9000000 + 7 * i} for info") for i in range(4)]
    data += [(30 + i, f"reach our night desk via {9000000 + 7 * i} any time") for i in range(4)]
    data += [(40, "reach our night desk via 7700001 any time"), (41, "in the year of 8100000 nothing happened")]
    data += [(50 + i, f"only the two of {9000000 + 7 * i} are known") for i in range(2)] + [(52, "only the two of 6600001 are known")]
    got = {r.doc_id: (r.spans, r.n_discovered) for r in pii.find_pii(llm.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[40] == ("phone:25:32", 1) and got[30] == ("phone:25:32", 1)
    assert got[41] == ("", 0) and got[52] == ("", 0)


def test_pii_context_around_neighbouring_matches(llm):
    data = [(i, f"call me on +1 555 010 {2000 + i}") for i in range(9)]
    data += [(20, "call me on (555) 123-4567"), (21, "call me on 12 / 765-4321 9"), (22, "call me up (555) 123-9999")]
    data += [(30 + i, f"+1 555 020 {2000 + i} rings all day") for i in range(9)] + [(40, "8000001 (4) - 5 rings all day")]
    got = {r.doc_id: r.spans for r in pii.find_pii(llm.createDataFrame(data, "doc_id long, text string")).collect()}
    assert (got[20], got[21], got[22], got[40]) == ("phone:17:25", "phone:16:24", "", "phone:0:7")


def test_pii_plan_is_native(llm, docs):
    plan = pii.find_pii(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- secrets -------------------------------------------------------------------------------------------

def brute_secrets(text):
    """The contract's patterns as they stand: maximal runs, failing ones dropped."""
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_secret_base_spans_against_plain_patterns(llm, docs, edges, nothing):
    texts = [r.text for r in docs.collect()] + [r[1] for r in EDGES] + [
        "password=abc token = 'abcdef' API_KEY: xyz123 ſecret=abcdefg apikey=1", "AKIAAKIA" + "A" * 20 + " AKIA12", "é" + "0af" * 9]
    for t in texts:
        assert secrets.base_spans(t or "") == brute_secrets(t)
    got = secrets.scan_secrets(edges)
    assert got.count() == len(EDGES) and secrets.scan_secrets(nothing).count() == 0
    for r in got.collect():
        assert (r.n_assign, r.n_access, r.n_hex) == (0, 0, 0)


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_secret_structures():
    rsa = der(0x30, der(2, b"\0"), *[der(2, bytes([1 + i]) * 60) for i in range(8)])
    assert secrets.der_key(rsa) == "rsa-private"
    assert secrets.der_key(rsa[:-1]) is None and secrets.der_key(rsa + b"\0") is None
    pkcs8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, rsa))
    assert secrets.der_key(pkcs8) == "pkcs8-private"
    s = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(b"pub") + s(b"priv" * 20)
    assert secrets.ssh_key(ssh) == "openssh-private" and secrets.ssh_key(ssh[:-1]) is None
    b64 = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    token = ".".join([b64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), b64(b'{"sub":"1234"}'), b64(b"x" * 32)])
    fake = ".".join([b64(b'{"notalg":1,"typ":"JWT"}'), b64(b'{"sub":"1234"}'), b64(b"x" * 32)])
    text = f"k {base64.b64encode(rsa).decode()} t {token} f {fake} h {rsa.hex().upper()} noise {'Ab1/' * 30}"
    kinds = [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.confirmed_spans(text)]
    assert kinds == [("der", base64.b64encode(rsa).decode()), ("jwt", token), ("der", rsa.hex().upper())]
    pem = "-----BEGIN OPENSSH PRIVATE KEY-----\n" + base64.encodebytes(ssh).decode() + "-----END OPENSSH PRIVATE KEY-----"
    assert [(a, secrets.KINDS[k], b) for a, k, b in secrets.confirmed_spans(pem)] [0] == (0, "ssh", len(pem))


def test_secret_keys_in_common_writings():
    s = lambda b: len(b).to_bytes(4, "big") + b
    rsa = der(0x30, der(2, b"\0"), *[der(2, bytes([1 + i]) * 60) for i in range(8)])
    pkcs8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, rsa))
    lines = base64.encodebytes(pkcs8).decode()
    for end in ("\\n", "\\\\n", "\\r\\n"):  # as JSON strings hold them
        pem = ("-----BEGIN PRIVATE KEY-----\n" + lines + "-----END PRIVATE KEY-----").replace("\n", end).replace("/", "\\/")
        assert secrets.confirmed_spans(f'{{"private_key": "{pem}"}}')[:1] == [(17, 4, 17 + len(pem))]
    key = base64.b64encode(pkcs8).decode()
    short = base64.b64encode(der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2b\x65\x70")), der(4, der(4, b"\7" * 32)))).decode()
    ssh = base64.b64encode(s(b"ssh-ed25519") + s(b"\x9a" * 32)).decode()
    own = base64.b64encode(b"openssh-key-v1\0" + s(b"none") * 2 + s(b"") + (1).to_bytes(4, "big") + s(b"pub") + s(b"priv" * 20)).decode()
    for body, kind in ((key, 4), (short, 4), (ssh, 5), (own, 5)):
        for before in ("", "key_", "a/", "--", "n", "xyMM", "AAAAB", "b3Bl"):
            text = f"x {before}{body} y"
            assert secrets.confirmed_spans(text) == [(2 + len(before), kind, 2 + len(before) + len(body))], text
    for name in (b"sk-ssh-ed25519@openssh.com", b"sk-ecdsa-sha2-nistp256@openssh.com", b"ssh-rsa"):
        assert secrets.ssh_key(s(name) + s(b"k" * 32) + s(b"ssh:")) == "ssh-public"
    assert secrets.confirmed_spans("key_" + key[:-8] + " MM" + "MIIE" * 99 + " " + "A" * 5000) == []


# --- licenses ------------------------------------------------------------------------------------------

def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_base_against_brute_force(llm, docs, edges, nothing):
    data = [(r.doc_id, r.text) for r in docs.collect()] + [(2000 + i, t) for i, t in enumerate([
        "under the mit license under-the_MIT/license", "CC BY-NC-SA 4.0, cc by nc", "é under the mit license\x85\xa0ü", "apache license version 2"])]
    frame = llm.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in licenses.scan_licenses(frame).collect()}
    assert got == {i: brute_base(t) for i, t in data}
    out = licenses.scan_licenses(edges).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id: r.labels for r in out}[8] == "mit"
    assert licenses.scan_licenses(nothing).count() == 0


@pytest.mark.parametrize("text,labels", [
    ("SPDX-License-Identifier: GPL-2.0", "gpl-2"), ("GNU Lesser General Public License, version 2.1", "lgpl-2.1"),
    ("licensed under the GNU General Public License, version 3", "gpl-3"), ("All rights reserved.", "proprietary"),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa"), ("the bsd of the sea", ""),
    ("BSD 3-Clause License", "bsd-3-clause"), ("Mozilla Public License 2.0", "mpl-2"), ("a perl of wisdom, a vim of life", "")])
def test_license_rules(text, labels):
    assert licenses.scan(text)[5] == labels


def test_license_rules_number_and_order():
    found = licenses.rules()
    assert len(found) >= 300 and [r[3] for r in found] == sorted((r[3] for r in found), reverse=True)
    for _, label, keyword, _, pattern in found:
        assert keyword in pattern.pattern, (label, pattern.pattern)


@pytest.mark.parametrize("text,labels", [
    ("SPDX-License-Identifier: 0BSD", "bsd-0-clause"), ("FreeBSD license", "bsd-2-clause"), ("OpenRAIL-M license", "openrail"),
    ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: ISC", "isc"), ("SPDX-License-Identifier: Zlib", "zlib"),
    ("License: MIT", "mit"), ("License: MIT-0", "mit-0"), ("license: BSD 3-Clause", "bsd-3-clause"), ("License: BSD", "bsd"),
    ("SPDX-License-Identifier: Artistic-2.0", "artistic-2"), ("to license artistic works", ""), ("runs on FreeBSD", ""),
    ("licensed under FreeBSD", "bsd-2-clause"), ("a professor at MIT", "")])
def test_license_short_names_and_own_keywords(text, labels):
    assert licenses.scan(text)[5] == labels


def examples(parsed):
    """Strings that together take every branch of a parsed regex."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            part = [chr(arg)]
        elif op == "ANY":
            part = ["q"]
        elif op == "IN":
            part = [{"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(v[0]), "CATEGORY": lambda v: "7"}[str(arg[0][0])](arg[0][1])]
        elif op == "BRANCH":
            part = [e for branch in arg[1] for e in examples(branch)]
        elif op == "SUBPATTERN":
            part = examples(arg[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            part = ["".join(e * n) for n in sorted({arg[0], max(arg[0], 1)}) for e in examples(arg[2])]
        else:
            assert op == "ASSERT" or op == "ASSERT_NOT", op
            continue
        # every part once, with the first choice of the others
        out = [o + part[0] for o in out] + [out[0] + p for p in part[1:]]
    return out


def test_license_gate_shuts_no_match_out(monkeypatch):
    cases = [(keyword, e) for *_, keyword, _, pattern in licenses.rules() for e in examples(re._parser.parse(pattern.pattern))
             if pattern.search(f" {e} ")]
    assert len(cases) > len(licenses.rules())
    texts = sorted({e for _, e in cases})
    gated = [licenses.scan(t) for t in texts]
    assert [c for c in cases if f" {c[0]}" not in f" {c[1]}"] == []
    every = {r[2] for r in licenses.rules()}
    monkeypatch.setattr(licenses, "automaton", lambda: type("All", (), {"iter": lambda self, stream: [(0, k) for k in every]})())
    assert [licenses.scan(t) for t in texts] == gated


def test_openssh_heads_are_scanned_in_linear_time():
    import time

    run = "b3BlbnNzaC1rZXktdjEA" * 50000
    began = time.process_time()
    assert secrets.keys_of_run(run) == []
    assert time.process_time() - began < 5
    text = b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b""))
    body = b"openssh-key-v1\0" + text + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"p" * 60, b"k" * 90))
    key = base64.b64encode(body).decode().rstrip("=")
    assert [at for at, _ in secrets.keys_of_run(key)] == [0]
    assert [at for at, _ in secrets.keys_of_run("abcd/" + key)] == [5]
