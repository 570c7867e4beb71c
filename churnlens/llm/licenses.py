"""License scans: ordered signature rules over the normalised word stream.

Each license has hand-written names (regexes over words) and, where it has
one, a distinctive sentence of its text; every name is combined with the
contexts in which licenses are declared (tag, grant, title), so a few hundred
signature rules result. A rule runs only when its keyword occurs in the text
(one multi-string search finds all keywords). Detections are resolved by
priority and interval containment: a detection inside a kept one of at least
its priority is suppressed, so "gnu general public license" inside "gnu lesser
general public license ..." or a bare name inside a tag does not count twice.

Defined results: a null text counts as empty: no words, null word positions,
empty labels, score 0. Whole texts are read; other columns are ignored;
repeated rows give repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and labels of the contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Hand-written names: label | keyword that gates the rules | regex over words.
# In a regex, a space stands for one word boundary, and the stream is lower case.
NAMES = """
mit | mit | (?:the )?mit(?: expat)? licen[sc]e
mit | expat | (?:the )?expat licen[sc]e
mit-0 | mit | mit no attribution(?: licen[sc]e)?
mit-0 | mit | mit 0
apache-2 | apache | apache(?: software)? licen[sc]e(?: version)? v?2(?: 0)?
apache-2 | apache | apache 2(?: 0)?
apache-1.1 | apache | apache(?: software)? licen[sc]e(?: version)? v?1 1
apache-1.0 | apache | apache(?: software)? licen[sc]e(?: version)? v?1 0
gpl-3 | gnu | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?
gpl-3 | gpl | gpl ?v?3(?: 0)?
gpl-2 | gnu | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2(?: 0)?
gpl-2 | gpl | gpl ?v?2(?: 0)?
gpl | gnu | gnu general public licen[sc]e
gpl | gpl | gpl
lgpl-3 | gnu | gnu lesser general public licen[sc]e(?: version| v)? ?3(?: 0)?
lgpl-3 | lgpl | lgpl ?v?3(?: 0)?
lgpl-2.1 | gnu | gnu lesser general public licen[sc]e(?: version| v)? ?2 1
lgpl-2.1 | lgpl | lgpl ?v?2 1
lgpl-2 | gnu | gnu library general public licen[sc]e(?: version| v)? ?2(?: 0)?
lgpl | gnu | gnu lesser general public licen[sc]e
agpl-3 | gnu | gnu affero general public licen[sc]e(?:(?: version| v)? ?3(?: 0)?)?
agpl-3 | agpl | agpl ?v?3(?: 0)?
gfdl | gnu | gnu free documentation licen[sc]e(?: version 1 [123])?
gfdl | gfdl | gfdl(?: 1 [123])?
bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[sc]e)?
bsd-2-clause | freebsd | freebsd licen[sc]e
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?
bsd-0-clause | bsd | (?:bsd 0 clause|zero clause bsd)(?: licen[sc]e)?
bsd-0-clause | 0bsd | 0bsd(?: licen[sc]e)?
bsd | bsd | bsd(?: style)? licen[sc]e
mpl-2 | mozilla | mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?
mpl-2 | mpl | mpl ?v?2(?: 0)?
mpl-1.1 | mozilla | mozilla public licen[sc]e(?: version| v)? ?1 1
mpl-1.1 | mpl | mpl ?v?1 1
epl-2 | eclipse | eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?
epl-2 | epl | epl ?v?2(?: 0)?
epl-1 | eclipse | eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?
epl-1 | epl | epl ?v?1(?: 0)?
edl-1 | eclipse | eclipse distribution licen[sc]e(?: version| v)? ?1(?: 0)?
cddl-1 | cddl | cddl(?: version)?(?: 1 [01])?
cddl-1 | common | common development and distribution licen[sc]e(?: version)?(?: 1 [01])?
cpl-1 | common | common public licen[sc]e(?: version)?(?: 1 0)?
cpal-1 | common | common public attribution licen[sc]e(?: version)?(?: 1 0)?
cc0-1 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1 | creative | creative commons(?: zero| cc0)(?: v?1 0)?(?: universal)?
cc-by | creative | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by | cc | cc by(?: [1-4] [05])?
cc-by-sa | creative | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by-sa | cc | cc by sa(?: [1-4] [05])?
cc-by-nc | creative | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nc | cc | cc by nc(?: [1-4] [05])?
cc-by-nd | creative | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?
cc-by-nd | cc | cc by nd(?: [1-4] [05])?
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-sa | cc | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?
cc-by-nc-nd | cc | cc by nc nd(?: [1-4] [05])?
isc | isc | (?:the )?isc licen[sc]e
zlib | zlib | (?:the )?zlib(?: libpng)? licen[sc]e
libpng | libpng | (?:the )?libpng licen[sc]e
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl(?: 2)?
wtfpl | what | do what the f\\w* you want to public licen[sc]e
artistic-2 | artistic | artistic licen[sc]e(?: version)? 2(?: 0)?
artistic-1 | artistic | artistic licen[sc]e(?: version)? 1(?: 0)?
artistic | artistic | (?:the )?(?:clarified )?artistic licen[sc]e
bsl-1 | boost | boost software licen[sc]e(?: version)?(?: 1 0)?
busl-1.1 | business | business source licen[sc]e(?: version)?(?: 1 1)?
sspl-1 | sspl | sspl(?: v?1)?
sspl-1 | server | server side public licen[sc]e(?: version)?(?: 1)?
elastic-2 | elastic | elastic licen[sc]e(?: version)?(?: v?2)?(?: 0)?
eupl-1.2 | eupl | eupl(?: v)?(?: 1 [012])?
eupl-1.2 | european | european union public licen[sc]e(?: version)?(?: 1 [012])?
ms-pl | microsoft | microsoft public licen[sc]e
ms-rl | microsoft | microsoft reciprocal licen[sc]e
osl-3 | open | open software licen[sc]e(?: version)? 3(?: 0)?
afl-3 | academic | academic free licen[sc]e(?: version)? 3(?: 0)?
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
python-2 | python | python software foundation licen[sc]e(?: version 2)?
psf-2 | psf | psf licen[sc]e(?: version)?(?: 2)?
php-3 | php | php licen[sc]e(?: version)?(?: 3 0[01]?)?
ruby | ruby | ruby licen[sc]e
perl | perl | same terms as perl(?: itself)?
openssl | openssl | openssl licen[sc]e
postgresql | postgresql | postgresql licen[sc]e
ofl-1.1 | ofl | (?:sil )?ofl(?: version)?(?: 1 [01])?
ofl-1.1 | font | sil open font licen[sc]e(?: version)?(?: 1 [01])?
odbl-1 | odbl | odbl(?: 1 0)?
odbl-1 | database | open database licen[sc]e(?: v?1 0)?
odc-by-1 | attribution | open data commons attribution licen[sc]e
pddl-1 | pddl | (?:open data commons )?pddl(?: 1 0)?
ijg | jpeg | independent jpeg group licen[sc]e
x11 | x11 | (?:the )?x11 licen[sc]e
w3c | w3c | w3c(?: software)?(?: notice and)? licen[sc]e
vim | vim | vim licen[sc]e
tcl | tcl | tcl licen[sc]e
curl | curl | curl licen[sc]e
qpl-1 | public | q public licen[sc]e(?: version)?(?: 1 0)?
ipl-1 | ibm | ibm public licen[sc]e(?: version)?(?: 1 0)?
npl-1 | netscape | netscape public licen[sc]e(?: version)?(?: 1 [01])?
sleepycat | sleepycat | sleepycat licen[sc]e
cecill-2 | cecill | cecill(?: [abc])?(?: licen[sc]e)?(?: version)?(?: 2(?: [01])?)?
upl-1 | universal | universal permissive licen[sc]e(?: version)?(?: v?1 0)?
mulan-2 | mulan | mulan (?:psl|permissive software licen[sc]e)(?: v?2)?
blueoak-1 | oak | blue oak model licen[sc]e(?: 1 0 0)?
hippocratic | hippocratic | hippocratic licen[sc]e(?: \\d)*
parity-7 | parity | parity public licen[sc]e(?: 7(?: 0)*)?
polyform-nc | polyform | polyform noncommercial licen[sc]e(?: 1 0 0)?
public-domain | domain | (?:released into|placed in|dedicated to|in) the public domain
openrail | rail | (?:creativeml |bigscience |bigcode )?open rail(?: m)?(?: licen[sc]e)?
openrail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[sc]e)?
llama-community | llama | llama (?:\\d )*community licen[sc]e(?: agreement)?
"""

# Distinctive sentences of license texts and notices: label | keyword | regex over words.
SENTENCES = """
mit | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | warranty | the software is provided as is without warranty of any kind express or implied including but not limited to
apache-2 | unless | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e
apache-2 | compliance | you may not use this file except in compliance with the licen[sc]e
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e
agpl-3 | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse | neither the name of .{3,80}? may be used to endorse or promote products
mpl-2 | subject | this source code form is subject to the terms of the mozilla public licen[sc]e
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsl-1 | obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy
zlib | altered | altered source versions must be plainly marked as such
unlicense | unencumbered | this is free and unencumbered software released into the public domain
cc0-1 | waived | (?:to the extent possible under law )?.{0,80}?has waived all copyright and related
epl-2 | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
ofl-1.1 | font | this font software is licensed under the sil open font licen[sc]e
proprietary | reserved | all rights reserved
proprietary | confidential | confidential and proprietary
proprietary | unauthorized | unauthorized (?:copying|use|reproduction)(?: and or distribution)? (?:of this (?:file|software|material) )?is (?:strictly )?prohibited
"""

# Contexts of a name: rule kind, priority (100 is certain), regex around the name.
CONTEXTS = (
    ("tag", 100, r"spdx licen[sc]e identifier {}"),
    ("grant", 90, r"(?:licen[sc]ed|released|distributed|available|published|covered|provided)(?: \w+){{0,2}}? under (?:the )?(?:terms of )?(?:the )?{}"),
    ("field", 80, r"(?:licen[sc]e|licen[sc]ing) (?:is |type )?{}"),
    ("title", 60, "{}"),
)
SENTENCE_PRIORITY = 85
#: Per context, the keywords of names that declare a license there without the word (None: of all names).
SHORT = {"tag": None, "grant": {"freebsd"},
         "field": {"mit", "expat", "isc", "zlib", "libpng", "x11", "ncsa", "openssl", "postgresql", "bsd", "freebsd"}}


def _around(kind: str, around: str, keyword: str, name: str) -> str:
    """The regex of a name in a context."""
    if kind in SHORT and (SHORT[kind] is None or keyword in SHORT[kind]):
        name = name.replace(" licen[sc]e", "(?: licen[sc]e)?")
    return around.format(f"(?:{name})")


@lru_cache(maxsize=None)
def rules():
    """(order, label, keyword, priority, compiled regex) in order, the most certain first."""
    out = []
    rows = [[c.strip() for c in line.split(" | ")] for line in NAMES.strip().splitlines()]
    for kind, priority, around in CONTEXTS:
        for label, keyword, name in rows:
            bare = " " not in re.sub(r"\(\?:[^()]*\)\??", "", name).strip()
            if kind == "title" and bare and "licen" not in name:
                continue  # one bare word is no declaration without a context
            out.append((label, keyword, priority, _around(kind, around, keyword, name)))
    for line in SENTENCES.strip().splitlines():
        label, keyword, name = [c.strip() for c in line.split(" | ")]
        out.append((label, keyword, SENTENCE_PRIORITY, name))
    out.sort(key=lambda r: -r[2])
    return [(i, label, keyword, priority, re.compile(rf"(?<= ){pattern.replace(chr(92) * 2, chr(92))}(?= )"))
            for i, (label, keyword, priority, pattern) in enumerate(out)]


@lru_cache(maxsize=None)
def automaton():
    """Finds every gating keyword that begins a word; each match of a rule holds its keyword so."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for keyword in {r[2] for r in rules()}:
        found.add_word(f" {keyword}", keyword)
    found.make_automaton()
    return found


#: Bytes that are no part of a word become blanks, A-Z become a-z.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32
             for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; every byte of a non-ASCII character belongs to a word."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def detections(stream: str):
    """(start, end, label, priority) in the stream after suppression."""
    present = {keyword for _, keyword in automaton().iter(stream)}
    found = {}
    for order, label, keyword, priority, pattern in rules() if present else ():
        if keyword in present:
            found.setdefault(priority, []).extend(
                (m.start(), -m.end(), order, label) for m in pattern.finditer(stream))
    kept = []
    for priority in sorted(found, reverse=True):
        kept.sort()
        begins = [k[0] for k in kept]
        reach = list(accumulate((k[1] for k in kept), max))  # furthest end of kept ones up to each begin
        furthest, new = -1, []
        for start, end, _, label in sorted(found[priority]):
            at = bisect_right(begins, start)
            if -end > max(furthest, reach[at - 1] if at else -1):
                furthest = -end
                new.append((start, -end, label, priority))
        kept += new
    return kept


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    found = words(text)
    stream = " " + b" ".join(found).decode("latin-1") + " "  # one character a byte: positions stay byte positions
    starts, base = [], set()
    for phrase, label in BASE:
        at, last, word = stream.find(f" {phrase} "), 0, -1
        while at >= 0:
            word += stream.count(" ", last, at + 1)
            starts.append(word)
            base.add(label)
            last, at = at + 1, stream.find(f" {phrase} ", at + 1)
    kept = detections(stream)
    labels = base | {label for _, _, label, _ in kept}
    score = max([p / 100 for _, _, _, p in kept] + [0.9] * bool(base), default=0.0)
    return (len(found), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double")


def _scan_batches(batches):
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    for b in batches:
        rows = [scan(t) for t in b.column(1).to_pylist()]
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64())]
                                         + [pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                         names=["doc_id", *COLUMNS])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses of every document, one row each; no shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _scan_batches, SCHEMA)
