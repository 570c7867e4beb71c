"""Secret scans with structural confirmation.

Base detections are three fixed patterns. Beyond them, runs that look like
base64 or hex are decoded and reported only when what they decode to is
structurally a credential: DER whose nested lengths agree to the last byte and
whose fields are those of a private key, an OpenSSH private key container, an
SSH public key blob, or a signed token whose header is JSON with an algorithm.

A key may start within its run ("key_MIIE..."); it ends where the run ends.

Defined results: a null text counts as empty and gives zero counts and empty
spans; whole texts are scanned, however long; other columns are ignored;
repeated rows give repeated results. Offsets count code points, ends exclude.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The three base patterns of the contract (ASCII case folding for the key words).
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_MIN = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # whole runs of 20 and more characters
HEX = re.compile(r"[0-9a-f]{24,}")
# Candidates for decoding.
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
# Line ends (and slashes) may be escaped, as in JSON strings.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----((?:[A-Za-z0-9+/=\s]++|\\++[nrt/])++)-----END \1-----")
PEM_BLANKS = re.compile(r"\s+|\\+[nrt]|\\+(?=/)")
# Where a key may start within a run: a DER sequence, an OpenSSH container, a type name of 4 to 67 bytes.
HEADS = re.compile(r"(?=M[A-P]|b3BlbnNzaC1rZXk|AAAA[B-Q])")
RUN_MIN = 40

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")  # order of kinds at one start
BASE_KINDS = KINDS[:3]


def tlv(data: bytes, pos: int, end: int):
    """(tag, start, end) of the DER element at ``pos``, or None if its length does not fit."""
    if pos + 2 > end:
        return None
    tag, first = data[pos], data[pos + 1]
    pos += 2
    if first < 0x80:
        length = first
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or pos + n > end:
            return None
        length = int.from_bytes(data[pos:pos + n], "big")
        if length < 0x80 or data[pos] == 0:  # DER wants the shortest form
            return None
        pos += n
    return (tag, pos, pos + length) if pos + length <= end else None


def children(data: bytes, start: int, end: int):
    """Elements that fill [start, end) exactly, or None."""
    out = []
    while start < end:
        item = tlv(data, start, end)
        if item is None:
            return None
        out.append(item)
        start = item[2]
    return out


def der_key(data: bytes) -> str | None:
    """Which private or public key encoding ``data`` is, by tags and nested lengths."""
    top = tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return None
    parts = children(data, top[1], top[2])
    if not parts:
        return None
    tags = [t for t, _, _ in parts]
    if len(tags) == 9 and set(tags) == {0x02} and parts[0][2] - parts[0][1] == 1:
        return "rsa-private"
    if tags[:3] == [0x02, 0x30, 0x04]:
        inner = children(data, parts[1][1], parts[1][2])
        return "pkcs8-private" if inner and inner[0][0] == 0x06 else None
    if tags[:2] == [0x02, 0x04] and len(tags) > 2 and set(tags[2:]) <= {0xA0, 0xA1}:
        return "ec-private"
    if len(tags) == 6 and set(tags) == {0x02}:
        return "dsa-private"
    if tags == [0x30, 0x04]:
        inner = children(data, parts[0][1], parts[0][2])
        return "encrypted-private" if inner and inner[0][0] == 0x06 else None
    if tags == [0x30, 0x03]:
        inner = children(data, parts[0][1], parts[0][2])
        return "public" if inner and inner[0][0] == 0x06 else None
    return None


def fields(data: bytes, pos: int, count: int | None = None):
    """Length-prefixed strings from ``pos``: the strings and where they end, or None."""
    out = []
    while pos < len(data) if count is None else len(out) < count:
        if pos + 4 > len(data):
            return None
        n = int.from_bytes(data[pos:pos + 4], "big")
        pos += 4
        if pos + n > len(data):
            return None
        out.append(data[pos:pos + n])
        pos += n
    return out, pos


SSH_TYPES = re.compile(rb"ssh-(rsa|dss|ed25519)|ecdsa-sha2-nistp\d+|sk-[a-z0-9@.-]+")
SSH_NAME = 64  # bytes of the longest type name the protocol allows


SSH_MAGIC = b"openssh-key-v1\0"
SSH_KEYS = 16  # keys of one container; writers put one


def ssh_key(data: bytes) -> str | None:
    """OpenSSH private container (of at most SSH_KEYS keys) or public key blob whose nested lengths agree."""
    if data.startswith(SSH_MAGIC):
        head = fields(data, len(SSH_MAGIC), 3)
        if head is None or head[1] + 4 > len(data):
            return None
        keys = int.from_bytes(data[head[1]:head[1] + 4], "big")
        rest = fields(data, head[1] + 4, keys + 1) if 1 <= keys <= SSH_KEYS else None
        return "openssh-private" if rest and rest[1] == len(data) else None
    if len(data) > 4 and 0 < int.from_bytes(data[:4], "big") <= SSH_NAME:
        got = fields(data, 0)
        if got and len(got[0]) >= 2 and SSH_TYPES.fullmatch(got[0][0]):
            return "ssh-public"
    return None


def unbase64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _part(run: str, at: int, lo: int, hi: int) -> bytes:
    """Bytes lo to hi of what the run encodes from ``at`` on (empty where it does not decode)."""
    first = lo // 3
    data = unbase64(run[at + 4 * first:at - (-hi // 3) * 4])
    return b"" if data is None else data[lo - 3 * first:hi - 3 * first]


def _container_ends(run: str, at: int, size: int) -> bool:
    """Whether an OpenSSH container starts at ``at`` whose nested lengths end with the run; decodes only the lengths."""
    pos = len(SSH_MAGIC)
    if _part(run, at, 0, pos) != SSH_MAGIC:
        return False
    left, counted = 3, False  # fields before the number of keys, then the keys and the private part
    while True:
        if left == 0:
            if counted:
                return pos == size
            left, counted = int.from_bytes(_part(run, at, pos, pos + 4), "big") + 1, True
            if not 2 <= left <= SSH_KEYS + 1:
                return False
            pos += 4
            continue
        pos += 4 + int.from_bytes(_part(run, at, pos, pos + 4), "big")
        if pos > size:
            return False
        left -= 1


def _may_start(run: str, at: int, end: int) -> bool:
    """Whether a key can start at ``at``, by its first bytes, so that the rest is decoded only for likely ones."""
    head = unbase64(run[at:at + 8])
    if head is None:
        return False
    if head[0] == 0x30:
        size = (end - at) * 3 // 4
        top = tlv(head, 0, size)
        return top is not None and top[2] == size
    if head[0] == 0:
        size = int.from_bytes(head[:4], "big")
        name = unbase64(run[at:at + -(-(4 + size) * 4 // 3)]) if size <= SSH_NAME else None
        return name is not None and bool(SSH_TYPES.fullmatch(name[4:4 + size]))
    if head[:6] == SSH_MAGIC[:6]:
        return _container_ends(run, at, (end - at) * 3 // 4)
    return True


def keys_of_run(run: str) -> list[tuple[int, int]]:
    """(start, index in KINDS) of the first key that fills a base64 run to its end."""
    end = len(run.rstrip("="))
    starts = (m.start() for m in HEADS.finditer(run) if 0 < m.start() <= end - RUN_MIN and _may_start(run, m.start(), end))
    for at in itertools.chain([0], starts):
        data = unbase64(run[at:])
        kinds = [k for k, f in ((4, der_key), (5, ssh_key)) if data and f(data)]
        if kinds:
            return [(at, k) for k in kinds]
    return []


def signed_token(run: str) -> bool:
    """A token of three parts: JSON header with an algorithm, JSON payload, a signature unless the algorithm is none."""
    parts = run.split(".")
    try:
        head, body = (json.loads(unbase64(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    if not (isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)):
        return False
    return bool(unbase64(parts[2])) or (head["alg"].lower() == "none" and not parts[2])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of the base patterns."""
    out = []
    lower = text.lower()
    if any(k in lower for k in ASSIGN_KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans whose decoded content is structurally a credential."""
    out = set()
    if "eyJ" in text:
        out |= {(m.start(), 3, m.end()) for m in JWT.finditer(text) if signed_token(m.group())}
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = unbase64(PEM_BLANKS.sub("", m.group(2)))
            if data:
                out |= {(m.start(), k, m.end()) for k, f in ((4, der_key), (5, ssh_key)) if f(data)}
    for m in BASE64.finditer(text):
        out |= {(m.start() + at, k, m.end()) for at, k in keys_of_run(m.group())}
    for m in ANY_HEX.finditer(text):
        data = bytes.fromhex(m.group())
        out |= {(m.start(), k, m.end()) for k, f in ((4, der_key), (5, ssh_key)) if f(data)}
    return sorted(out)


def render(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None) -> tuple:
    """(counts of the base kinds, base spans' digest, all spans, number of confirmed spans) of one text."""
    base = base_spans(text or "")
    more = confirmed_spans(text or "")
    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
    return (*counts, hashlib.sha256(render(base).encode()).hexdigest(), render(sorted(base + more)), len(more))


SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "n_confirmed long")


def _scan_batches(batches):
    for b in batches:
        rows = [scan(t) for t in b.column(1).to_pylist()]
        cols = list(zip(*rows)) if rows else [[] for _ in range(6)]
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        arrays = [b.column(0).cast(pa.int64())] + [pa.array(list(c), k) for c, k in zip(cols, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
                                                        "spans", "n_confirmed"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every document, one row each; no shuffle."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_scan_batches, SCHEMA)
