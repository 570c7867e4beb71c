"""The segment-tree codec against the tokenizers library."""
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from churnlens.llm import bpe, queries

from .conftest import EDGES, SF

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def same(codec, library, texts):
    for text, ids in zip(texts, codec.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_every_code_point(library):
    same(bpe.Codec(PATH), library, [f"a{chr(c)}b" for c in range(0x30000) if not 0xD800 <= c < 0xE000])


def test_random_texts(library):
    rng = random.Random(5)
    signs = "abcABC '’.,!?12e\u0301\u0307\u0345\u0130\u03a3\u03c2\u00df \x85\x1c\x1d\xa0\u2460\xb2\xbd\xaa`~\u4e2d\u65e5\U0001f642\u200d\u212b\xc5\n\t"
    words = "don't they're <|endoftext|> <|startoftext|> world's <|ENDOFTEXT|> <|endoftext|>x 12345 'll 'VE xx'd aaaa".split()
    same(bpe.Codec(PATH), library, ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(4000)]
         + [rng.choice(["", " ", "  "]).join(rng.choices(words, k=30)) for _ in range(500)])


def test_long_words_and_slices(library, monkeypatch):
    rng = random.Random(6)
    long = ["x" * 50000, "ab" * 20000, "!" * 3000, "".join(rng.choices("abcde\xe9", k=30000)), "", " \t"]
    same(bpe.Codec(PATH), library, long)
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "CACHED", 40)
    same(bpe.Codec(PATH), library, ["caf\xe9 \u0301la e \u0301 the <|endoftext|> " * 40, "one two\n" * 200])


def test_short_and_long_trees_agree():
    codec = bpe.Codec(PATH)
    rng = random.Random(7)
    for _ in range(300):
        raw = "".join(rng.choices("thein rgs", k=rng.randint(1, bpe.SHORT))).replace(" ", "").encode() or b"a"
        ids = codec.inner[np.frombuffer(raw, np.uint8)]
        ids[-1] = codec.last[raw[-1]]
        table = ids[None].copy()
        bpe.merge_short(table, codec.merges)
        assert table[table >= 0].tolist() == bpe.merge_long(ids.tolist(), codec.merges)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))


def expected(library, rows):
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return Counter(out)


def test_query_equals_the_library(llm, docs, library):
    got = queries.QUERIES["op11_bpe_codec"](llm, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = expected(library, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert Counter(tuple(r) for r in got.collect()) == want


def test_defined_results(llm, edges, nothing):
    got = bpe.decode(bpe.encode(edges, PATH), PATH).collect()
    assert len(got) == len(EDGES)
    assert all(r.n_tokens == 0 and bytes(r.ids) == b"" and r.decoded == "" for r in got if r.doc_id in (3, 4, 5))
    assert [r.doc_id for r in got].count(6) == 2 and [r.doc_id for r in got].count(None) == 1
    assert bpe.decode(bpe.encode(nothing, PATH), PATH).count() == 0
    odd = llm.createDataFrame([(1, 1, bytearray(np.array([320, 60000], "<u4").tobytes())), (2, 0, None)], bpe.ENCODED)
    assert [r.decoded for r in bpe.decode(odd, PATH).orderBy("doc_id").collect()] == [bpe.Codec(PATH).tokens[320], None]
