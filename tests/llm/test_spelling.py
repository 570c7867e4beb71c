"""Spelling variants against brute force over deletion neighbourhoods."""
import random
import re
import zlib
from collections import Counter, defaultdict

from churnlens.llm import queries, spelling

from .conftest import EDGES, SF


def counts(docs, misspelt=97):
    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\\u00C0-\\u00FF]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % misspelt == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return out


def near_words(words):
    """Near words by the strings themselves: cut one code point of each, and each against each that shares a cut."""
    cuts = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cuts[w[:i], w[i + 1:]].add(w)
    out = defaultdict(set)
    for same in cuts.values():
        for w in same:
            out[w] |= same - {w}
    for w in words:
        for i in range(len(w)):
            v = w[:i] + w[i + 1:]
            if v in words:
                out[w].add(v)
                out[v].add(w)
    return out


def expected(n, times=2):
    near, forms = near_words(set(n)), {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(near[w]), n[forms[w]] if forms[w] is not None else None))
    return Counter(out)


def levenshtein_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return Counter(tuple(r) for r in df.collect())


def test_brute_force_by_definition():
    rng = random.Random(1)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(200)}
    near = near_words(words)
    for a in words:
        assert near[a] == {b for b in words if levenshtein_one(a, b)}


def test_dense_vocabulary(llm):
    rng = random.Random(2)
    n = {"".join(rng.choices("abé", k=rng.randint(1, 7))): rng.choice([3, 4, 5, 6, 8, 12, 16, 24, 32, 64, 100]) for _ in range(900)}
    n |= {"x" * 4000: 3, "x" * 3999: 9, "x" * 2000 + "y" + "x" * 1999: 30}
    df = llm.createDataFrame(list(n.items()), "word string, n long")
    assert found(spelling.variants(df)) == expected(n)


def test_many_ranges(llm):
    rng = random.Random(9)
    n = {"".join(rng.choices("ab", k=rng.randint(4, 9))): rng.randint(3, 50) for _ in range(600)}
    before = llm.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(spelling.variants(llm.createDataFrame(list(n.items()), "word string, n long")))
    finally:
        llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == expected(n)


def test_trie_nodes_are_prefixes(llm):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 8))) for _ in range(300)})
    rows = spelling.trie_nodes(llm.createDataFrame([(w,) for w in words], "word string"), "word").collect()
    number = {}
    for r in rows:
        assert len(r.nodes) == len(r.word) + 1
        for i, node in enumerate(r.nodes):
            assert number.setdefault(r.word[:i], node) == node
    assert len(set(number.values())) == len(number) and len(rows) == len(words)


def test_query_equals_brute_force(llm, docs):
    n = {w: c for w, c in counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]).items() if len(w) >= 5 and c >= 3}
    assert found(queries.QUERIES["op13_spelling_variants"](llm, SF)) == expected(n)


def test_defined_results(llm, edges, nothing):
    assert spelling.variants(spelling.vocabulary(nothing)).count() == 0
    all_words = counts([(r[0], r[1]) for r in EDGES])
    n = {w: c for w, c in all_words.items() if len(w) >= 5 and c >= 3}
    assert found(spelling.variants(spelling.vocabulary(edges))) == expected(n)
    rows = [(i, "colour Colour COLOUR color \u00c9tude \u00e9tude" if i % 2 else "colour colours \u00e9tude") for i in range(200)]
    n = {w: c for w, c in counts(rows).items() if len(w) >= 5 and c >= 3}
    assert found(spelling.variants(spelling.vocabulary(llm.createDataFrame(rows, "doc_id long, text string")))) == expected(n)
