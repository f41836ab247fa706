"""Hard negatives, chunked BPE and periodic runs against brute force, the library itself, and odd rows."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chunk_bpe, negatives, periodic, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


# --- chunked BPE ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def as_library(library, texts):
    return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


PARTS = ["a", "b", "ab", " ", "  ", "\t", "\n", "1", "2.", "!", "'s", "'LL", "é", "é", "́", " ́", "가", "ᄀ", "ᅡ", "中", "😀", "İ", "ǅ", "ß", "\x1c", "\x85", "\xa0", " ", "\x0b", "<|endoftext|>", "<|startof", "text|>", "the ", "of ", "word"]


@pytest.mark.parametrize("mean", [1, 4, 16, 1024])
def test_chunks_encode_as_the_library(library, monkeypatch, mean):
    monkeypatch.setattr(chunk_bpe, "MEAN", mean)
    rng, own = random.Random(mean), chunk_bpe.ChunkCodec(PATH)
    for _ in range(15):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 5, 30, 200, 1500]))) for _ in range(15)]
        texts += [texts[1] + texts[2] + texts[5], texts[3] * 3, "x" * 3000, " " * 500]
        ids = own.encode(pa.array(texts))
        assert ids == as_library(library, texts)
        for raw in ids:
            tokens = np.frombuffer(raw, "<u4").tolist()
            assert own.decode(tokens) == library.decode(tokens, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text_encodes_as_the_library(texts):
    from tokenizers import Tokenizer

    chunk_bpe.MEAN, held = 4, chunk_bpe.MEAN
    try:
        assert chunk_bpe.codec(PATH).encode(pa.array(texts, pa.string())) == as_library(Tokenizer.from_file(PATH), texts)
    finally:
        chunk_bpe.MEAN = held


def test_chunks_follow_the_content_and_are_encoded_once(monkeypatch):
    monkeypatch.setattr(chunk_bpe, "MEAN", 64)
    rng = random.Random(5)
    passage = " ".join(str(rng.randint(0, 999)) for _ in range(800))
    texts = [f"{'head ' * k}{passage} {'tail ' * k}" for k in range(20)]
    own = chunk_bpe.ChunkCodec(PATH)
    own.encode(pa.array(texts[:1]))
    alone = own.encoded
    own.encode(pa.array(texts[1:]))
    assert alone > 20 and own.encoded < 3 * alone  # 19 more texts: only what is around the passage is new


def test_a_repair_that_does_not_agree_encodes_the_whole_text(library, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "MEAN", 32)
    own, text = chunk_bpe.ChunkCodec(PATH), " ".join(f"word{i} and" for i in range(200))
    sound = own._pieces

    def broken(chunks):
        out = sound(chunks)
        return {c: chunk_bpe.Piece(p.ids[:-4] + b"\1\0\0\0", p.head and (p.head[0], p.head[1], len(p.ids)), p.tail and (p.tail[0], 0, p.tail[2])) for c, p in out.items()}

    monkeypatch.setattr(own, "_pieces", broken)
    assert own.encode(pa.array([text])) == as_library(library, [text]) and own.disagreed == 1


def test_caches_stay_small(library, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "WORDS", 50)
    monkeypatch.setattr(chunk_bpe, "CHUNKS", 10)
    monkeypatch.setattr(chunk_bpe, "MEAN", 16)
    rng, own = random.Random(2), chunk_bpe.ChunkCodec(PATH)
    for _ in range(20):
        texts = [" ".join(str(rng.randint(0, 99)) for _ in range(60)) for _ in range(5)]
        assert own.encode(pa.array(texts)) == as_library(library, texts)
        assert len(own.words) <= 50 and len(own.chunks) <= 10 and len(own.joins) <= 10


def test_chunk_bpe_odd_rows(spark, library):
    odd = [(1, None, 5), (2, "", 6), (3, "  \n ", 7), (None, "no id", 8), (4, "twice", 9), (4, "twice", 9), (5, "long " * 50_000 + "x" * 100_000, 0), (6, "a <|endoftext|> b", 1)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, ids int").withColumnRenamed("ids", "near")
    ids = chunk_bpe.encode(docs, PATH)
    got = Counter((r.doc_id, tuple(r.ids)) for r in ids.collect())
    assert got == Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in odd)
    texts = Counter((r.doc_id, r.text) for r in chunk_bpe.decode(ids, PATH).collect())
    assert texts == Counter((d, library.decode(list(i), skip_special_tokens=False)) for (d, i), n in got.items() for _ in range(n))
    assert chunk_bpe.encode(docs.where("doc_id = 99"), PATH).collect() == []
    assert chunk_bpe.round_trip(docs.where("doc_id = 99"), PATH).collect() == []


def test_chunk_bpe_query_on_all_documents(spark, library):
    expected = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in queries.op12_chunk_bpe(spark, SF).collect()} == expected


# --- periodic runs --------------------------------------------------------------------------


def brute_runs(w, least=24, times=3):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def mixed_words(rng):
    w = []
    for _ in range(rng.randint(1, 6)):
        unit = [str(rng.randint(0, rng.choice([1, 1, 2, 3, 5]))) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 24, 31, 33, 40]))]
        w += [unit[i % len(unit)] for i in range(rng.randint(0, len(unit) * rng.choice([2, 4, 6])))]
        w += [str(rng.randint(0, 50)) for _ in range(rng.choice([0, 0, 3, 10]))]
    return w


def test_runs_are_those_of_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        w = mixed_words(rng)
        assert periodic.runs_of([x.encode() for x in w]) == brute_runs(w)
        for least, times in ((1, 3), (40, 4)):
            assert periodic.runs_of([x.encode() for x in w], least, times) == brute_runs(w, least, times)


def test_splitting_keeps_runs_and_drops_rare_words():
    w = np.array([9, *[1, 2, 3] * 10, 8, *range(20, 60), *[4, 5] * 15, 7, 1, 2, 3])
    assert periodic.split_by_frequency(w) == [(1, 31), (72, 102)]
    # A word that is frequent in the text but rare in its segment splits the segment in a later round.
    again = np.array([*[1, 2, 3] * 10, 5, *[1, 2, 3] * 10, 99, *[6, 7] * 20, 5, *[6, 7] * 20, 98, *[8, 9] * 20, 5, *[8, 9] * 20])
    assert all(5 not in again[a:b] for a, b in periodic.split_by_frequency(again)) and len(periodic.split_by_frequency(again)) == 6


def test_long_texts_take_no_square_of_their_words():
    n = 300_000
    rng = random.Random(2)
    assert periodic.runs_of([b"a"] * n) == [(0, n, 1)]
    unit = [str(rng.randint(0, 5000)).encode() for _ in range(n // 3)]
    assert periodic.runs_of(unit * 3) == [(0, n // 3 * 3, n // 3)]
    assert periodic.runs_of([str(rng.random()).encode() for _ in range(n)]) == []


def planted(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_query_on_all_documents(spark):
    expected, with_runs = {}, 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = planted(r.doc_id, r.text)
        runs = brute_runs(w) if len(w) < 3000 or zlib.crc32(str(r.doc_id).encode()) % 10 == 0 else periodic.runs_of([x.encode() for x in w])
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else (None, None, None)
        with_runs += bool(runs)
        digest = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), brute_collapsed(w, runs))]
        expected[r.doc_id] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digest)
    assert with_runs > 5
    assert {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()} == expected


def test_runs_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, " \t\n", 3), (None, "x " * 30, 4), (4, "a b " * 12, 5), (4, "a b " * 12, 5), (5, "A a " * 12, 6), (6, "y\x85y " * 24, 7), (7, "z " * 23, 8)]
    got = periodic.find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int"))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    out = sorted(((r.doc_id or 0, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got.collect()))
    assert out == [
        (0, 30, ((0, 30, 1),), "x"), (1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 24, ((0, 24, 2),), "a b"), (4, 24, ((0, 24, 2),), "a b"),
        (5, 24, ((0, 24, 2),), "A a"), (6, 24, ((0, 24, 1),), "y\x85y"), (7, 23, (), " ".join("z" * 23)),
    ]
    assert periodic.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    digest = queries.with_planted_runs(spark.createDataFrame([(None, "a b"), (30, None), (1, "")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in digest) == [(0, "a b"), (1, ""), (30, "")]


# --- hard negatives -------------------------------------------------------------------------


def brute_negatives(rows, is_anchor, positives=5, negatives=10, least=30, most=90):
    rows = sorted({(i, c, tuple(v)) for i, c, v in rows})
    out = []
    for i, c, v in rows:
        if is_anchor(i):
            scored = sorted((-sum(x * y for x, y in zip(v, u)), j, d) for j, d, u in rows if j != i and len(u) == len(v))
            for p, j, d in [x for x in scored if x[2] == c][:positives]:
                fit = [x for x in scored if x[2] != c and least * -p <= 100 * -x[0] <= most * -p][:negatives]
                out += [(i, j, k + 1, m, -p, -s) for k, (s, m, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    return sorted(map(tuple, negatives.mine(df, **kw).collect()))


@pytest.mark.parametrize("spread", [3, 40, 4000])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(negatives, "ROWS", 60)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rng = random.Random(spread)
    centres = [[rng.randint(-300, 300) for _ in range(6)] for _ in range(5)]
    rows = [(i, rng.randint(0, 3), [x + rng.randint(-spread, spread) for x in centres[i % 5]]) for i in range(300)]
    rows += [(400 + i, i % 4, [50, 60, 70, 80, 90, 100]) for i in range(120)]  # one vector, many ties
    assert mined(spark, rows, is_anchor="vec_id % 20 = 0") == brute_negatives(rows, lambda i: i % 20 == 0)


def test_bounds_spare_rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 1000
    v = np.concatenate([c + rng.normal(size=(200, 16)) for c in centres]).astype(np.int64)
    block, anchors = negatives.Block(np.arange(len(v)), np.zeros(len(v), np.int64), v), v[::50]
    for i, rows, scores in block.walk(anchors, lambda i, low, high: np.flatnonzero(high >= np.partition(low, -5)[-5])):
        every = v @ anchors[i]
        assert (scores == every[rows]).all() and set(np.flatnonzero(every >= np.sort(every)[-5])) <= set(rows.tolist())
    assert block.scored < 0.5 * len(v) * len(anchors)


def test_spanning_tree_is_minimal():
    v = np.random.default_rng(3).normal(size=(40, 5))
    tree = negatives.spanning_tree(v)
    edges = sorted((float(np.linalg.norm(v[i] - v[j])), i, j) for i in range(40) for j in range(i))
    group, total = list(range(40)), 0.0
    for d, i, j in edges:
        if group[i] != group[j]:
            total, old, new = total + d, group[i], group[j]
            group = [new if g == old else g for g in group]
    assert abs(sum(d for _, _, d in tree) - total) < 1e-6
    met = set()
    for node, parent, _ in tree:
        assert parent in met or (parent == -1 and not met)
        met.add(node)
    assert len(met) == 40


def test_negatives_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [30, 40]), (2, 2, [20, 20]), (2, 2, [20, 20]), (3, None, [9, 9]), (4, 2, None), (5, 2, [1, None]), (None, 2, [8, 8]), (6, 2, []), (7, 2, [1, 2, 3]), (8, 2, [0, 0]), (9, 2, [2**40, 2**40]), (10, 3, [20, 20])]
    good = [(0, 1, [3, 4]), (1, 1, [30, 40]), (2, 2, [20, 20]), (7, 2, [1, 2, 3]), (8, 2, [0, 0]), (10, 3, [20, 20])]
    assert mined(spark, rows, is_anchor="vec_id in (0, 2, 7)") == brute_negatives(good, lambda i: i in (0, 2, 7)) == [(0, 1, 1, 2, 250, 140), (0, 1, 2, 10, 250, 140)]
    # Scores beyond 2**53 stay exact.
    big = [(i, i % 2, [2**30 + i, 2**29 - i * i]) for i in range(40)]
    assert mined(spark, big, is_anchor="vec_id < 4", most=100) == brute_negatives(big, lambda i: i < 4, most=100)
    df = spark.createDataFrame([(0, 1, [1.0], 5), (1, 1, [1.0], 6)], "vec_id long, label int, v array<double>, rank int")
    assert negatives.mine(df).collect() == [] and negatives.mine(df.where("vec_id > 5")).collect() == []
    # A positive below zero has an empty window.
    assert mined(spark, [(0, 1, [1]), (1, 1, [-5]), (2, 2, [-2])], is_anchor="vec_id = 0") == []
