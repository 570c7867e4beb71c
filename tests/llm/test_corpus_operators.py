"""Mixing, n-gram join, packing, line dedup, neighbours and the pipeline against brute force."""
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from churnlens.llm import ann, line_dedup, mixing, ngram_join, packing, tokens
from churnlens.llm.components import components

from .conftest import EDGES, SF

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- mixing --------------------------------------------------------------------------------------------

@given(st.lists(st.integers(0, 5000), min_size=1, max_size=12))
def test_targets_fill_by_weight_up_to_three_times(sizes):
    got = mixing.targets(sizes)
    assert abs(sum(got) - sum(sizes)) < 1e-6 * max(1, sum(sizes))
    free = [(t / (5, 2, 1)[i % 3]) for i, (t, n) in enumerate(zip(got, sizes)) if t < 3 * n - 1e-9]
    assert all(t <= 3 * n + 1e-9 for t, n in zip(got, sizes))
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


@given(st.integers(1, 3000), st.integers(0, 1 << 40))
@settings(max_examples=40)
def test_block_permutation_is_one(n, key):
    assert sorted(mixing.permuted(np.arange(n), n, key).tolist()) == list(range(n))


def test_mix_reads_blocks_evenly_and_repeatably(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mix = mixing.plan_mix(docs, block=16, per_shard=500)
    got = {r.doc_id: r for r in mixing.taken_words(mix).collect()}
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert {i: r["size"] for i, r in got.items()} == sizes
    by = defaultdict(lambda: [0, 0, 0])
    for r in got.values():
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
        assert r.taken <= 3 * r["size"]
    for taken, target, _ in by.values():
        assert abs(taken - target) <= 2 * 16
    again = {r.doc_id: r.taken for r in mixing.taken_words(mixing.plan_mix(docs.repartition(7), block=16, per_shard=500)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    slots = mix.slots().toPandas()
    assert not slots.duplicated(["source_no", "epoch", "block"]).any()
    assert slots.groupby("shard").size().iloc[:-1].eq(500).all()
    assert slots.groupby("shard").source_no.nunique().min() > 10


def test_mix_defined_results(llm, edges, nothing):
    got = mixing.taken_words(mixing.plan_mix(edges)).collect()
    assert len(got) == len(EDGES)
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    none = [r for r in got if r.source is None]
    assert len(none) == 2 and none[0].source_size == 0
    assert mixing.taken_words(mixing.plan_mix(nothing)).count() == 0


def test_cut_text_keeps_whole_texts_and_spacing():
    text = " a  b\tc d\ne "
    assert mixing.cut_text(text, [(0, 2), (2, 3)]) == text
    assert mixing.cut_text(text, [(3, 1), (0, 2)]) == "a  b\nd"


def test_cut_text_holds_no_list_of_a_long_texts_words():
    text = "a " * 300_000
    tracemalloc.start()
    assert mixing.cut_text(text, [(299_990, 10), (5, 2), (7, 1)]) == "a a a\n" + ("a " * 10).strip()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20


# --- n-gram join -----------------------------------------------------------------------------------------

def brute_components(data, words, p, q):
    sets = {}
    for i, t in data:
        w = [m.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for m in WORD.findall(t or "")]
        sets[i] = ({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and q * len(x & y) >= p * len(x | y):
                r, s = sorted((find(ids[a]), find(ids[b])))
                root[s] = r
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups=6, copies=14, length=60):
    """Documents with random edits of an original, some copied from copies, some sharing a passage only."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    shared = [word() for _ in range(25)]
    out = []
    for _ in range(groups):
        family = [[word() for _ in range(length)]]
        for _ in range(copies):
            w = list(rng.choice(family))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            family.append(w[:len(w) - rng.randrange(3)])
        out += family
    out += [shared + [word() for _ in range(rng.randrange(5, 40))] for _ in range(12)]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed,words,similarity", [(1, 3, (9, 10)), (2, 5, (4, 5))])
def test_components_against_all_pairs(llm, monkeypatch, seed, words, similarity):
    monkeypatch.setattr(ngram_join, "LONG_LIST", 4)  # long lists are thinned in this small corpus too
    data = near_copies(seed)
    frame = llm.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame, words, similarity).collect()}
    assert got == brute_components(data, words, *similarity)
    assert len({c for _, c in got.values()}) < len(got) - 10


def test_whole_sets_of_near_copies_are_on_disk_in_parts(llm, monkeypatch):
    """Where most documents have near copies, the sets of all of them were on disk at once, beside their shuffles."""
    monkeypatch.setattr(ngram_join, "LONG_LIST", 4)
    monkeypatch.setattr(ngram_join, "LEAST", 100, raising=False)
    held, write = [], ngram_join.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name == "segments":
            held.append(out.agg(F.sum(F.size("keys"))).first()[0] or 0)
        return out

    monkeypatch.setattr(ngram_join.Scratch, "write", counted)
    data = near_copies(3, groups=3, copies=8)
    frame = llm.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame, 3, (7, 10)).collect()}
    assert got == brute_components(data, 3, 7, 10)
    assert max(held) <= sum({t: got[i][0] for i, t in data}.values()) / 2


def test_ngram_join_defined_results(llm, edges, nothing):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(edges, 3, (9, 10)).collect()),
                 key=str)
    want = brute_components([(r[0], r[1]) for r in EDGES if r[0] is not None], 3, 9, 10)
    assert [g for g in got if g[0] is not None] == sorted([(r[0], *want[r[0]]) for r in EDGES if r[0] is not None], key=str)
    assert [g for g in got if g[0] is None] == [(None, 1, None)]
    assert ngram_join.ngram_components(nothing).count() == 0


def shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for f in disk.getAllFiles().mkString("|").split("|") if (name := f.rsplit("/", 1)[-1]).startswith("shuffle_")}


@pytest.mark.parametrize("make", [lambda llm, docs: ngram_join.ngram_components(docs, 3, (9, 10)), corpus_pipeline.near],
                         ids=["join", "near"])
def test_ngram_join_leaves_no_shuffle_files(llm, make):
    """Files of every step stayed until the driver collected its garbage, beside those of later steps."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    frame = llm.createDataFrame([(i, text, "en", "a", len(text)) for i, text in near_copies(3, groups=2, copies=4)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    before, held = shuffle_files(llm), llm.conf.get(key, None)
    out = make(llm, frame)
    end = time.time() + 20  # files go in the background
    while (left := shuffle_files(llm) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert llm.conf.get(key, None) == held
    assert out.count()


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
@settings(max_examples=5, deadline=None)
def test_contraction_finds_components(llm, pairs):
    root = {i: i for p in pairs for i in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(llm.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: root[i] for a, b in pairs if a != b for i in (a, b)}


def test_contraction_of_a_long_chain(llm):
    edges = llm.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r.root for r in components(edges).collect()} == {0}


# --- packing ---------------------------------------------------------------------------------------------

ODD = ["", " ", "\n\n a", "it's  we'll", "x<|endoftext|>y", "日本 語 text", "a  b\t\nc \n", "tab\tx", " lead", "trail  ",
       "a\x0bb", "x" * 200 + " " + "y" * 70, "!!! ??? 12 34a", " x", "'s", "don't 'tis", "É ü ß́", "a\x00b", "\r\n\r\n"]


def test_encoder_equals_the_library(docs):
    texts = ODD + [r.text or "" for r in docs.collect()]
    enc, plain = tokens.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for _ in range(2):  # the second time from the words kept
        for t, got in zip(texts, enc.encode(texts)):
            assert got.tolist() == plain.encode(t, add_special_tokens=False).ids, t[:60]


@given(st.text(alphabet=st.sampled_from("ab' \n\tÉs1.<|>éあ\xa0t"), max_size=40))
@settings(max_examples=150, deadline=None)
def test_encoder_on_any_text(text):
    enc = tokens.encoder(TOKENIZER)
    assert enc.encode([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_encodes_a_large_vocabulary_once(monkeypatch):
    enc = tokens.Encoder(TOKENIZER)
    name = lambda i: "".join(chr(97 + i // 26 ** k % 26) for k in range(4))
    texts = [" ".join(name(i) for i in range(lo, lo + 1000)) for lo in range(0, 300_000, 1000)]
    first = [x.tolist() for x in enc.encode(texts)]
    assert len(enc.offsets) > 250_000
    monkeypatch.setattr(enc, "_add", None)  # nothing is new the second time
    assert [x.tolist() for x in enc.encode(texts)] == first
    assert first[7] == enc.tokenizer.encode(texts[7], add_special_tokens=False).ids


def test_encoder_keeps_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 50)
    enc = tokens.Encoder(TOKENIZER)
    for k in range(30):  # long words are kept for a batch too
        text = " ".join(chr(97 + k % 26) * n for n in range(60, 90))
        assert enc.encode([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(enc.offsets) <= 50 + 31


@given(st.lists(st.integers(1, 63), max_size=200))
@settings(max_examples=60, deadline=None)
def test_sum_of_squares_places_everything(lengths):
    seq, off, fill = packing.sum_of_squares(np.array(lengths, dtype=np.int64), 64)
    used = defaultdict(list)
    for n, s, o in zip(lengths, seq.tolist(), off.tolist()):
        used[s].append((o, n))
    for s, items in used.items():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at == fill[s] <= 64


def test_packing_round_trip(llm, edges, docs):
    frame = edges.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    frame = frame.unionByName(llm.createDataFrame([(9000, "word " * 3000)], "doc_id long, text string"))
    plain = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in frame.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > first else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    got = packing.pack_documents(frame, TOKENIZER).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for items in used.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(used) <= 1.03 * total / 1024 + 2


def test_packing_nothing(llm, nothing):
    assert packing.pack_documents(nothing, TOKENIZER).count() == 0


# --- line dedup ------------------------------------------------------------------------------------------

def test_templates_generalise_fields_and_variable_words(llm):
    data = [(i, f"Session {i} started for user{i} on host alpha\nown line {chr(97 + i) * 3} of words {chr(98 + i) * 4}\n\nshared footer")
            for i in range(8)]
    data += [(20, None), (21, ""), (22, "alone here\n\nalone again 12")]
    data += [(30 + i, f"error in module {w} while reading the config file today") for i, w in enumerate("red blue green gray pink".split())]
    got = {r.doc_id: r for r in line_dedup.clean_lines(llm.createDataFrame(data, "doc_id long, text string")).collect()}
    for i in range(8):
        assert (got[i].n_lines, got[i].n_dropped) == (4, 2)
        assert got[i].clean_text == f"own line {chr(97 + i) * 3} of words {chr(98 + i) * 4}\n"
    for i in range(5):
        assert (got[30 + i].n_dropped, got[30 + i].clean_text) == (1, "")
    assert got[22].clean_text == "alone here\n\nalone again 12" and got[20].n_lines == got[21].n_lines == 1


def test_masked_lines_are_made_once(llm):
    lines = ["", " ", "\t\x0b", "a", " a  b ", "a\tb", "x\r", "v1 two", " 12\t3 x  ", "é1 日本 2", "no\x0cfield", "a\u00a0 b", "\u2003"]
    want = {t: re.sub(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>", re.sub(r"[\x20\x09-\x0D]+", " ", t)).strip(" ") or None
            for t in lines}
    frame = llm.createDataFrame([(t,) for t in lines], "line string")
    col = F.col("line")
    got = frame.select("line", line_dedup.masked(col).alias("mask"), line_dedup.has_token(col).alias("some")).collect()
    assert {r.line: r.mask for r in got} == want and all(r.some == (r.mask is not None) for r in got)
    assert str(line_dedup.masked(col)).count("regexp_replace") <= 3  # each value named once; naming a value makes it again


def test_line_dedup_on_edges_and_plan(llm, edges, nothing):
    got = line_dedup.clean_lines(edges, min_docs=1).collect()
    assert len(got) == len(EDGES)
    con = duckdb.connect()
    frame = edges.select("doc_id", "text").dropDuplicates().where("doc_id is not null").toPandas()
    con.register("documents", frame)
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_lines, n_dropped FROM ({line_dedup.ORACLE})").fetchall()}
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.clean_lines(llm.createDataFrame(frame)).collect()} == want
    plan = line_dedup.clean_lines(edges)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert line_dedup.clean_lines(nothing).count() == 0


# --- neighbours ------------------------------------------------------------------------------------------

def brute_nearest(x, ids, asks, top):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(asks):
        s = u @ u[q]
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != ids[q]][:top]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def test_neighbours_recall_and_scores(llm):
    frame = llm.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = frame.toPandas()
    x, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    want = brute_nearest(x, ids, ids % 50 == 0, 5)
    got = defaultdict(list)
    place = {int(i): k for k, i in enumerate(ids)}
    for r in ann.search(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert r.rank == len(got[r.query_id]) and r.vec_id != r.query_id
        a, b = x[place[r.query_id]], x[place[r.vec_id]]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert set(got) == set(want)
    hits = sum(len(set(got[q]) & set(w)) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_neighbours_defined_results(llm):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (50, [-1.0, 0.0]), (100, None)]
    frame = llm.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in ann.search(frame, F.col("vec_id") % 50 == 0).orderBy(
        "query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 50, -1.0),
                   (50, 1, 3, 0.0), (50, 2, 0, -1.0), (50, 3, 1, -1.0), (50, 4, 2, -1.0)]
    assert ann.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_blocks_do_not_change_results(llm):
    rng = np.random.default_rng(3)
    data = [(i, rng.standard_normal(8).tolist() if i % 3 else [1.0] * 8) for i in range(300)]
    frame = llm.createDataFrame(data, "vec_id long, embedding array<double>")
    one = [tuple(r) for r in ann.search(frame, F.col("vec_id") % 50 == 0, probes=64).orderBy("query_id", "rank").collect()]
    many = [tuple(r) for r in ann.search(frame, F.col("vec_id") % 50 == 0, probes=64, block=16, group=2).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in one] == [r[:3] for r in many]
    x, ids = np.array([v for _, v in data]), np.arange(300)
    assert {q: [r[2] for r in one if r[0] == q] for q in range(0, 300, 50)} == brute_nearest(x, ids, ids % 50 == 0, 5)


# --- pipeline --------------------------------------------------------------------------------------------

def test_pipeline_stages(llm, tmp_path):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, f in corpus_pipeline.STAGES:
        f(llm, frames[-1], SF).write.parquet(str(tmp_path / name))
        frames.append(llm.read.parquet(str(tmp_path / name)))
    assert all(f.columns == columns for f in frames[:-1])
    texts = [[(r.doc_id, r.text) for r in f.collect()] for f in frames[:-1]]
    assert len(texts[1]) == len(texts[0])  # all documents are in known languages
    groups = defaultdict(list)
    for i, t in texts[1]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    assert sorted(i for i, _ in texts[2]) == sorted(min(g)[1] for g in groups.values())
    near = brute_components(texts[2], 5, 4, 5)
    assert sorted(i for i, _ in texts[3]) == sorted({c for _, c in near.values()})
    whole = dict(texts[3])
    words = {i: WORD.findall(t) for i, t in texts[3]}
    taken = Counter()
    for i, t in texts[4]:
        assert t in whole[i] or all(part in whole[i] for part in t.split("\n"))
        taken[i] += len(WORD.findall(t))
    assert all(n <= 3 * len(words[i]) for i, n in taken.items())
    want = {r.doc_id: r.taken for r in mixing.taken_words(mixing.plan_mix(frames[3])).collect() if r.taken}
    assert dict(taken) == want
    plain = Tokenizer.from_file(TOKENIZER)
    assert frames[5].agg(F.sum("length")).first()[0] == sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts[4])


def test_pipeline_on_edges(llm, edges, nothing, tmp_path):
    for k, start in enumerate((edges.unionByName(llm.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True), nothing)):
        frame = start
        for name, f in corpus_pipeline.STAGES:
            f(llm, frame, SF).write.parquet(str(tmp_path / f"{k}-{name}"))
            frame = llm.read.parquet(str(tmp_path / f"{k}-{name}"))
        assert (frame.count() > 0) == (k == 0)


def test_pipeline_hands_small_batches_to_workers(llm):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    step = corpus_pipeline._step(0, lambda spark, docs: docs.mapInArrow(sizes, "n long"))
    docs = llm.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    got = [r.n for r in step(llm, docs, SF).collect()]
    assert sum(got) > 6000 * 2000 and max(got) < 3 << 20


def test_ann_scores_of_extreme_components(llm):
    from churnlens.llm import ann

    rows = [(k, [x * s for x in v]) for k, (v, s) in enumerate([([1.0, 2.0, 2.0], 1e200), ([1.0, 2.0, 2.0], 1e-200), ([2.0, 1.0, 2.0], 1.0),
                                                                ([0.0, 0.0, 0.0], 1.0)])]
    got = ann.search(llm.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2] and abs(got[0].score - 1) < 1e-15 and abs(got[1].score - 8 / 9) < 1e-15
    x = np.random.default_rng(1).normal(size=(50, 8))
    plain = (x * x[::-1]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[::-1] * x[::-1]).sum(axis=1)))
    assert (ann.cosine(x, x[::-1]) == plain).all()


def test_a_worker_holds_the_tables_of_one_operator(monkeypatch):
    from churnlens.llm import common

    monkeypatch.setattr(common, "_worker", {})
    gone = []
    for owner in ("a", "a", "b", "b", "a"):
        common.worker_holds(owner, lambda owner=owner: gone.append(owner))
    assert gone == ["a", "b"] and list(common._worker) == ["a"]
