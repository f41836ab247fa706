"""Each operator against brute force, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import html.parser
import itertools
import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, decontaminate, html_text, jaccard_join, license_scan, line_dedup, pii, quality, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "vo", "zan") for b in ("ber", "dil", "fon", "gar", "hus", "")]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \n\t", "word", "word", "a b c d", "ÄÖ é 日本語 😀", "x " * 30_000, "lone | | |", "\n\n\n"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- 1 ---


def brute_lines(rows):
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for d, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 20 and d is not None:
                held[key(s)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if d is None or len(held[key(s)]) < 3 or d == max(held[key(s)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark):
    line = "This line is long enough to count"
    texts = [line, f"a\n  {line.upper()}\t\nb", f"{line}\n{line}", "short", None, "", f"É {line}", f"é {line}", f"É {line}", f"É {line}"]
    ids = [5, 9, 7, 1, 2, 3, 20, 21, 22, 23]
    rows = list(zip(ids, texts)) + [(9, f"other\n{line}"), (None, line), (7, f"{line}\n{line}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_lines", F.lit("clash")).withColumn("lines", F.lit(1))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_shared_lines(df).collect())
    assert got == sorted((-1 if d is None else d, n, k, t) for d, n, k, t in brute_lines(rows))
    assert line_dedup.drop_shared_lines(df.where("false")).count() == 0


def test_lines_of_very_long_texts(spark):
    """Every other line is shared and goes from all but the last document; time follows the number of lines."""
    took = []
    for n in (4_000, 64_000):
        texts = ["\n".join(f"line {i} that several documents hold" if i % 2 else f"own line {i} of document {d}" for i in range(n)) for d in range(3)]
        began = time.time()
        got = {r.doc_id: r for r in line_dedup.drop_shared_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
        took.append(time.time() - began)
        assert {(r.n_lines, r.n_dropped) for d, r in got.items() if d < 2} == {(n, n // 2)} and got[2].n_dropped == 0
        assert got[0].text == "\n".join(f"own line {i} of document 0" for i in range(0, n, 2)) and got[2].text == texts[2]
    assert took[1] < 16 * took[0] + 10


# --- 2 ---


def test_licenses(spark):
    texts = [*ODD, "Under the MIT License, and under the mit license!", "Licensed under the Apache License, Version 2.0.", "cc-by-nc CC BY NC", "under the mit", " ".join(license_scan.TEMPLATES["mit"].split()[:20]) + " indeed " + " ".join(license_scan.TEMPLATES["mit"].split()[20:])]
    rows = license_scan.scan_licenses(frame(spark, texts).withColumn("gram", F.lit(1)).withColumn("pos", F.lit(1))).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
        places = sorted((k, v) for p, v in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert got[i].n_words == len(words)
        assert sorted((p.at, p.label) for p in got[i].places) == places
    assert "mit" in [s.label for s in got[len(texts) - 1].spans]
    twice = frame(spark, ["under the mit license"] * 2, [4, 4])
    assert [len(r.places) for r in license_scan.scan_licenses(twice).collect()] == [1, 1]
    assert license_scan.scan_licenses(twice.where("false")).count() == 0


def brute_spans(text):
    """(label, first, last, cover) by plain loops: hits, diagonals, clusters of neighbours, the longest chain that rises in both."""
    k, out = license_scan.K, []
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    words = cut(text)
    for label, base, t in [*((v, True, p) for p, v in license_scan.PHRASES.items()), *((v.removesuffix("-notice"), False, t) for v, t in license_scan.TEMPLATES.items())]:
        tpl = cut(t)
        grams = len(tpl) - k + 1
        hits = [(i - j, i, j) for i in range(len(words) - k + 1) for j in range(grams) if words[i : i + k] == tpl[j : j + k]]
        clusters, before = [], None
        for d in sorted({h[0] for h in hits}):
            if before is None or d - before > license_scan.GAP:
                clusters.append([])
            clusters[-1] += [h for h in hits if h[0] == d]
            before = d
        for c in clusters:
            best = {}
            for _, i, j in sorted(c, key=lambda h: (h[1], -h[2])):
                best[i, j] = 1 + max((n for (a, b), n in best.items() if a < i and b < j), default=0)
            cover = (max(best.values()) + k - 1) / (grams + k - 1)
            whole = any(len({j for d, _, j in c if d == diag}) == grams for diag in {h[0] for h in c})
            if whole if base else cover >= license_scan.COVER:
                out.append((label, min(h[1] for h in c), max(h[1] for h in c) + k - 1, round(cover, 9)))
    return sorted(out)


def test_license_spans_are_those_of_a_slow_vote(spark):
    rng, texts = random.Random(8), ["gnu general public " * 6, "all rights reserved no " * 6, "the software " * 40]
    every = [*license_scan.TEMPLATES.values(), *license_scan.PHRASES]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            own = rng.choice(every).split()
            a = rng.choice([0, 0, rng.randrange(len(own))])
            own = own[a : a + rng.choice([len(own), rng.randint(1, len(own))])] * rng.choice([1, 1, 2, 5])
            own = [w if rng.random() > 0.03 else rng.choice(["edit", w + " more", ""]) for w in own]
            words += [*own, *(rng.choice(["x", "the", "license"]) for _ in range(rng.randint(0, 6)))]
        texts.append(" ".join(words))
    got = {r.doc_id: sorted((s.label, s.first, s.last, round(s.cover, 9)) for s in r.spans) for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}
    assert got[0] == got[1] == got[2] == [] and sum(map(bool, got.values())) > 20


def test_licenses_odd_rows(spark):
    rows = [(None, "under the mit license", 1), (1, "under the mit license", 2), (1, "x", 3), (2, None, 4), (3, "y " * 100_000 + "under the mit license", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tpl int")
    got = collections.Counter((r.doc_id, r.n_words, tuple(p.at for p in r.places)) for r in license_scan.scan_licenses(df).collect())
    assert got == {(None, 4, (0,)): 1, (1, 4, (0,)): 1, (1, 1, ()): 1, (2, 0, ()): 1, (3, 100_004, (100_000,)): 1}


# --- 3, 5 ---


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    seen = toxicity.score(docs, field).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    hit, all_toxic, wrong, clean = seen.agg(F.count_if((F.col("toxic") == 1) & (F.col("score") >= 0.5)), F.count_if(F.col("toxic") == 1), F.count_if((F.col("toxic") == 0) & (F.col("score") >= 0.5)), F.count_if(F.col("toxic") == 0)).first()
    assert hit / all_toxic >= 0.85
    assert wrong / clean <= 0.01
    odd = {r.doc_id: r for r in toxicity.score(frame(spark, [*ODD, "é you idiot idiot there"]), field).collect()}
    assert len(odd) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in odd.values())
    spans = odd[len(ODD)].spans
    assert spans and all("é you idiot idiot there"[s.start : s.end] in ("idiot", "idiot idiot") for s in spans)
    kept = toxicity.keep_clean(frame(spark, [*ODD, "idiot moron scum idiot"]), field)
    assert kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    assert kept.count() == len(ODD)


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    lens = [5, 1, 3, 7]
    first = np.r_[0, np.cumsum(lens)[:-1]]
    e = rng.normal(size=sum(lens))
    p, pairs = toxicity.marginals(e, first, first + lens, 0.7)
    expected, both = [], 0.0
    for a, n in zip(first, lens):
        w = {y: np.exp(sum(y[t] * e[a + t] for t in range(n)) + 0.7 * sum(y[t] * y[t - 1] for t in range(1, n))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(w.values())
        expected += [sum(v for y, v in w.items() if y[t]) / z for t in range(n)]
        both += sum(v * sum(y[t] * y[t - 1] for t in range(1, n)) for y, v in w.items()) / z
    assert np.allclose(p, expected) and np.isclose(pairs, both)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    seen = quality.score(docs, trees).join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
    right, n = seen.agg(F.count_if((F.col("score") >= 0.7).cast("int") == F.col("quality")), F.count(F.lit(1))).first()
    assert right / n >= 0.97
    odd = quality.score(frame(spark, ODD), trees).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_models_with_odd_labels(spark, module, label):
    """Labels that contradict each other count as 1 whatever their order; repeated rows and clashing columns change no score."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS) for _ in range(20)) + (" nasty" * 3 if i % 2 else " nice.") for i in range(80)]
    one = [(i, i % 2) for i in range(80)]
    odd = [*one, (1, 0), (3, 0), (None, 1), (5, None), (7, 9)]
    labels = lambda rows: spark.createDataFrame(rows, f"doc_id bigint, {label} int")
    docs = frame(spark, texts)
    scores = lambda rows, df: sorted((r.doc_id, round(r.score, 9)) for r in module.score(df, module.fit(docs, labels(rows))).collect())
    plain = scores(one, docs)
    assert scores(odd, docs) == plain == scores(odd[::-1], docs)
    twice = docs.union(docs).withColumn("score", F.lit("clash")).withColumn("spans", F.lit(1))
    assert scores(odd, twice) == sorted(plain * 2)


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_models_without_labels(spark, module, label):
    labels = spark.createDataFrame([], f"doc_id bigint, {label} int")
    docs = frame(spark, ODD)
    assert module.score(docs, module.fit(docs, labels)).count() == len(ODD)
    assert module.score(docs.where("false"), module.fit(docs.where("false"), labels)).count() == 0


# --- 4 ---


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    out = []
    for i, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), i, m.end(), m[0]))
    return sorted(out)


def test_pii(spark):
    rng = random.Random(3)
    bits = ["a.b@c.de", "x@y", "@q.r", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "007.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+49 30 1234567 8", "+1", "é", "日本", " ", "\n", "a@b.c+d@e.f", "12345678901234567890123"]
    texts = [*ODD, *("".join(rng.choice(bits) + rng.choice(["", " ", ".", "x"]) for _ in range(12)) for _ in range(300))]
    got = {r.doc_id: [tuple(b) for b in r.base] for r in pii.find_spans(frame(spark, texts).withColumn("base", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_pii(t), t
    assert pii.find_spans(frame(spark, texts).where("false")).count() == 0


def test_pii_terms_that_reveal(spark):
    rng = random.Random(5)
    fill = lambda: " ".join(rng.choice(WORDS) for _ in range(30))
    texts = [f"{fill()} mister zyxwvu {rng.choice(WORDS)} boss@corp.example {fill()}" for _ in range(6)] + [fill() for _ in range(200)]
    df = frame(spark, texts)
    spans = pii.find_spans(df)
    told = {b.value for r in spans.collect() for b in r.disclosed}
    assert {"mister", "zyxwvu"} <= told and not told & set(WORDS)
    clean = pii.redact(df, spans).where("doc_id < 6").collect()
    assert len(clean) == 6 and all("zyxwvu" not in r.sanitised and "[EMAIL]" in r.sanitised and r.sanitised.endswith(r.text[-20:]) for r in clean)


def brute_terms(texts):
    """{doc: {(start, end)}} of the terms that documents' words, as one context each, or the words near a value reveal."""
    word = re.compile(r"[^\W\d_]+")
    parts = {0: lambda v: [f"account:{re.match('([^@0-9]*[^@0-9._%+-])?', v)[0]}", f"domain:{v.split('@')[1]}"], 1: lambda v: ["network:" + ".".join(v.split(".")[:2])], 2: lambda v: [f"issuer:{re.sub('[^0-9]', '', v)[:6]}"], 3: lambda v: [f"area:{re.sub('[^0-9]', '', v)[:5]}"]}
    docs, held = {}, collections.defaultdict(dict)
    for d, t in enumerate(texts):
        spans = brute_pii(t)
        rest = t
        for s, _, e, _ in spans:
            rest = rest[:s] + " " * (e - s) + rest[e:]
        docs[d] = [(m[0].lower(), m.span()) for m in word.finditer(rest)]
        for s, kind, _, v in spans:
            i = sum(1 for _, at in docs[d] if at[0] < s)
            window = tuple(dict.fromkeys(w for w, _ in docs[d][max(0, i - 6) : i + 6]))
            for entity in [f"{kind}:{v.lower()}", f"class:{kind}", *parts[kind](v.lower())]:
                held[entity].setdefault(d, window)
    everywhere = collections.Counter(w for ws in docs.values() for w in {w for w, _ in ws})
    told = collections.defaultdict(set)
    for entity, windows in held.items():
        assert len(set(windows.values())) == len(windows)
        p = len(windows) / len(texts)
        for words_in in (lambda d: windows[d], lambda d: {w for w, _ in docs[d]}):
            for w, joint in collections.Counter(w for d in windows for w in words_in(d)).items():
                after = (min(joint, everywhere[w]) + 3 * p) / (everywhere[w] + 3)
                if after >= 0.5 and np.log2(after / p) >= 0.8 * -np.log2(p) and joint > 1:
                    told[entity].add(w)
    return {d: {at for w, at in ws if any(w in told[e] for e in held if d in held[e])} for d, ws in docs.items()}


def test_pii_terms_match_brute_force(spark):
    rng = random.Random(21)
    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    people = [(f"name{chr(97 + i)}", f"name{chr(97 + i)}.{i}@host{i % 3}.example.com", f"10.{i}.3.4") for i in range(6)]
    texts = [fill(40) for _ in range(150)]
    for _ in range(60):
        name, mail, ip = rng.choice(people)
        texts.append(f"{fill(rng.randint(5, 30))} {rng.choice(['Mr ' + name, name, 'mailbox'])} {fill(rng.randint(0, 5))} {mail} {fill(rng.randint(1, 9))} {rng.choice(['server', fill(1)])} {ip} {fill(20)}")
    got = {r.doc_id: {(b.start, b.end) for b in r.disclosed} for r in pii.find_spans(frame(spark, texts)).collect()}
    expected = brute_terms(texts)
    assert got == expected and sum(map(len, expected.values())) > 50


def test_pii_values_and_words_by_the_hundred(spark):
    """Texts that share hundreds of values and words: classes of both give what each pair of them would."""
    rng = random.Random(4)
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    texts = []
    for d in range(5):
        words = [letters(i) for i in range(0, 400, 1 + d % 2)]
        mails = [f"{letters(i)}@{letters(i % 7)}.example" for i in range(d % 3, 60)]
        texts.append(" ".join(rng.sample(words + mails, len(words) + len(mails))))
    texts += [f"plain text {letters(i)} of {letters(i + 300)}" for i in range(300)]
    got = {r.doc_id: {(b.start, b.end) for b in r.disclosed} for r in pii.find_spans(frame(spark, texts).repartition(5)).collect()}
    expected = brute_terms(texts)
    assert got == expected and sum(map(len, expected.values())) > 500


def test_pii_redacts_odd_rows(spark):
    df = frame(spark, [None, "", "a@b.example and c@d.example", "a@b.example and c@d.example"]).withColumn("doc_id", F.when(F.col("doc_id") < 2, F.col("doc_id"))).withColumns({"base": F.lit(1), "disclosed": F.lit(2), "sanitised": F.lit("mine")})
    rows = pii.redact(df, pii.find_spans(df)).collect()
    assert sorted(r.sanitised for r in rows) == ["", "", "[EMAIL] and [EMAIL]", "[EMAIL] and [EMAIL]"] and {(r.base, r.disclosed) for r in rows} == {(1, 2)}
    none = df.where("false")
    assert pii.redact(none, pii.find_spans(none)).count() == 0
    assert {r.sanitised for r in pii.redact(df, pii.find_spans(none)).where("text is not null").collect()} == {"", "a@b.example and c@d.example"}


def test_pii_secrets(spark):
    token = "dfd1944d2e84f15e89902e34b677e0aa"
    texts = [f'rata token = "{token}" tira', "a" * 40, "1234567890" * 4, "a-long-name-without-any-digits-in-it", f"x{token}", f"{token[:23]}", *(f'{w} token = "{i}{token}" {w}' for i, w in enumerate(WORDS[:9])), *(f"plain text {i}" for i in range(50))]
    df = frame(spark, texts)
    spans = pii.find_spans(df)
    got = {r.doc_id: [(b.start, b.kind, b.end) for b in r.disclosed] for r in spans.collect()}
    assert got[0] == [(5, pii.GONE, 10), (14, pii.SECRETS, 46)] or got[0] == [(5, pii.GENERAL, 10), (14, pii.SECRETS, 46)]
    assert [got[i] for i in (1, 2, 3, 5)] == [[]] * 4 and [k for _, k, _ in got[4]] == [pii.SECRETS]
    assert pii.redact(df, spans).where("doc_id = 0").first().sanitised in ('rata  = "[SECRET]" tira', 'rata [TERM] = "[SECRET]" tira')


def test_pii_terms_far_from_the_value(spark):
    """A term far from the value tells, wherever it stands in documents that hold the value; copies and one document alone tell nothing."""
    rng = random.Random(8)
    fill = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [f"Qwertzy {fill(60)} boss@corp.example {fill(60)} qwertzy, {'ö' * 200} Ümlautig" for _ in range(5)]
    copied = f"onlycopied {fill(20)} copy@corp.example {fill(20)}"
    texts += [copied + " " + fill(5) for _ in range(5)] + [f"{fill(9)} me@one.example {fill(9)} alone {fill(9)} me@one.example {fill(9)} me@one.example {fill(9)}"]
    texts += [fill(30) for _ in range(200)]
    df = frame(spark, texts)
    spans = pii.find_spans(df)
    found = {r.doc_id: [tuple(b) for b in r.disclosed] for r in spans.collect()}
    for i in range(5):
        assert [(s, e) for s, _, e, v in found[i] if v == "qwertzy"] == [m.span() for m in re.finditer("(?i)qwertzy", texts[i])]
        assert any(v == "ümlautig" for _, _, _, v in found[i])
    assert all(v == texts[d][s:e].lower() for d, b in found.items() for s, _, e, v in b)
    assert not {v for b in found.values() for *_, v in b} & {*WORDS, "onlycopied", "alone", "boss", "corp"}
    clean = pii.redact(df, spans).where("doc_id < 5").collect()
    assert len(clean) == 5 and all("qwertzy" not in r.sanitised.lower() and "[EMAIL]" in r.sanitised for r in clean)


# --- 6 ---


def brute_align(p, q):
    best = 0
    h = [[0] * (len(p) + 1) for _ in range(len(q) + 1)]
    for i in range(1, len(q) + 1):
        for j in range(1, len(p) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if p[j - 1] == q[i - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(60):
        p, q = rng.integers(0, 6, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(1, 20))
        score, a, b = decontaminate.align(p, q)
        assert np.isclose(score * 2 * len(q), brute_align(p, q))
        if score:
            assert brute_align(p[a:b], q) == brute_align(p, q)


def test_decontamination(spark):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    item = [rng.choice(words) for _ in range(40)]
    edited = [w if i % 6 else "changed" for i, w in enumerate(item)]
    fill = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [*ODD, " ".join(fill(50) + item + fill(50)), " ".join(fill(300) + edited + fill(10)), " ".join(fill(400)), " ".join(item).upper()]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "one two"), (None, " ".join(item))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_copies(frame(spark, texts), bench).collect()}
    n = len(ODD)
    assert set(got) == {(n, 1), (n + 1, 1), (n + 3, 1)}
    assert got[n, 1].score == 1 and (got[n, 1].first_word, got[n, 1].end_word) == (50, 90)
    assert decontaminate.find_copies(frame(spark, texts), bench.where("false")).count() == 0
    assert decontaminate.find_copies(frame(spark, texts).where("false"), bench).count() == 0


# --- 7 ---


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[500:1000] = v[500]  # a third of all rows are one vector
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(1500, None), (1600, []), (1700, [0.0] * 16), (1800, [float("nan")] + [1.0] * 15), (1900, [None] + [1.0] * 15), (2000, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("label", F.lit(1)).withColumn("v", F.lit(2))
    got = collections.defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    x = v.astype(np.float64)
    hit = 0
    for q in range(0, 1500, 100):
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        expected = sorted((float(d), i) for i, d in enumerate(dist) if i != q)[:10]
        assert len(got[q]) == 10 and got[q] == sorted(got[q])
        assert all(np.isclose(s, dist[i]) for s, i in got[q])
        hit += len({i for _, i in expected} & {i for _, i in got[q]})
    assert hit >= 0.9 * 150
    assert set(got) == set(range(0, 1500, 100))
    assert ann.search(df.where("false")).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.search(few).collect()] == [(0, 5)]


def test_nearest_recall_on_embeddings(spark):
    """At least 0.9 of the ten nearest by brute force, over the whole table."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids = np.array(sorted(rows))
    vectors = np.stack([rows[i] for i in ids])
    got = collections.defaultdict(list)
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in (queries := [i for i in ids.tolist() if i % 100 == 0]):
        far = np.linalg.norm(vectors - rows[q], axis=1)
        far[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, far))[:10]].tolist()) & set(got[q]))
    assert set(got) == set(queries) and all(len(x) == 10 for x in got.values())
    assert hits >= 0.9 * 10 * len(queries)


# --- 8 ---

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe(spark):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    bits = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "'s", "I'LL", "abc", "É", "ß", "日本語", "😀👍🏽", "123", "½", "²", "...", "<|endoftext|>", "हिन्दी", "​", "﻿", "é"]
    texts = [*ODD, *("".join(rng.choice(bits) for _ in range(30)) for _ in range(400))]
    df = frame(spark, texts).withColumn("ids", F.lit(1))
    for r in bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect():
        t = texts[r.doc_id] or ""
        ids = own.encode_ordinary(t)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), t
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN, with_offsets=True)
    for r in encoded.collect():
        t = texts[r.doc_id] or ""
        for i, o in zip(r.ids, r.offsets):
            assert own.decode_single_token_bytes(i) in t[o.start : o.end].encode()
    back = {r.doc_id: r.text for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert bpe.round_trip(df.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


# --- 9 ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><!-- ad <p>no</p> --><div class="ad">Buy now.</div>{0}<section id="comments"><p>Great article, I liked it a lot.</p></section><aside><p>Related stories.</p></aside>
<form><p>Your mail</p><input></form><footer>&copy; site</footer></body></html>"""


def test_html(spark):
    body = "<{0}><h1>A  title</h1><p><b>First   paragraph, with &amp; sign.<br><p>Second one:\n fish &eacute; chips, and more of it.</p><p>Of.</p></{0}>"
    expected = "A title\nFirst paragraph, with & sign.\nSecond one: fish é chips, and more of it.\nOf."
    pages = [(1, "u", PAGE.format(body.format("article"))), (2, None, PAGE.format(body.format("div"))), (3, "u", None), (4, "u", ""), (5, "u", "plain text only"), (6, "u", "<p>" * 3000), (7, "u", "<" * 5000), (8, "u", '<a "' * 3000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert got[1].text == expected and got[2].text == expected
    assert got[3].text == got[4].text == "" and got[5].text == "plain text only"
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(pages)
    assert html_text.extract_text(df.where("false")).count() == 0


def test_html_keeps_whole_articles():
    long = "A sentence of the article, with commas, and a full stop."
    items = "".join(f"<li>Item {i}: {long} {long}</li>" for i in range(9))
    parts = {"ul": f"<ul>{items}</ul>", "div": "<div class='x'>" + items.replace("li>", "p>") + "</div>", "table": f"<table><tr><td>{long * 9}</td></tr></table>", "blockquote": f"<blockquote><p>{long * 9}</p></blockquote>", "section": f"<section><p>{long * 9}</p></section>"}
    for outer in ("article", "main", "div"):
        for name, part in parts.items():
            text = html_text.main_text(PAGE.format(f"<{outer}><h1>Title</h1><p>First: {long}</p>{part}<p>Last: {long}</p></{outer}>"))
            assert text.startswith(f"Title\nFirst: {long}\n") and text.endswith(f"\nLast: {long}"), (outer, name)
            assert "cookies" not in text and "Buy now" not in text and "Great article" not in text
    for tag in ("div class='content no-sidebar'", "main class='has-comments'", "div class='layout-sidebar-right'", "div class='article-header'", "div class='hidden'"):
        assert html_text.main_text(f"<body><{tag}><h1>Title</h1><p>{long}</p></{tag.split()[0]}></body>") == f"Title\n{long}", tag


def test_html_path_table():
    """Scores against a table of paths made by plain loops."""
    rng = random.Random(3)
    paths = [("body", "div", "p"), ("body", "div", "li"), ("body", "main", "p"), ("body", "h1")]
    found = [(rng.choice(paths), "".join(rng.choice("ab cd., é!") for _ in range(rng.randint(1, 60)))) for _ in range(80)]
    ratio = []
    for path, _ in found:
        own = [t for p, t in found if p == path]
        ratio.append(sum(map(len, own)) / len(own) * (1 + sum(c in ".,;:!?" for t in own for c in t) / len(own)))
    expected = []
    for i, r in enumerate(ratio):
        left, right = ratio[max(i - 1, 0)], ratio[min(i + 1, len(ratio) - 1)]
        expected.append((r * (left + 2 * r + right) / 4) ** 0.5)
    assert np.allclose(html_text.fused_ratios([html_text.Block(*f) for f in found]), expected)


PROSE = [f"Paragraph {i} of the piece, with a comma, and a second clause; then it stops." for i in range(7)]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_html_ratios_choose():
    """On pages whose markup names nothing, the ratios alone tell the piece from what stands beside it."""
    links = "".join(f"<div>Link {i}</div>" for i in range(12))
    page = f"<body><div class=a>{links}</div><div class=b><h2>Title</h2>{paragraphs(PROSE)}<p>Short.</p></div><div class=c><div>Fine!</div><div>Me too</div></div><div class=d>{links}</div></body>"
    assert html_text.main_text(page) == "\n".join(["Title", *PROSE, "Short."])
    rng, held, changed = np.random.default_rng(1), html_text.fused_ratios, 0
    try:
        html_text.fused_ratios = lambda found: rng.random(len(found))
        changed = sum(html_text.main_text(page) != "\n".join(["Title", *PROSE, "Short."]) for _ in range(20))
    finally:
        html_text.fused_ratios = held
    assert changed > 15


@pytest.mark.parametrize("name", ["hidden", "banner", "notice", "social", "post share", "main-content login"])
def test_html_a_named_region_that_holds_the_piece_stays(name):
    page = f"<body><p>{PROSE[0]}</p><div class='{name}'>{paragraphs(PROSE[1:])}</div></body>"
    assert all(t in html_text.main_text(page) for t in PROSE[1:])


def test_html_forms_and_headers_around_the_piece():
    menu = "<ul><li><a>Home</a></li><li><a>News</a></li></ul>"
    assert html_text.main_text(f"<body><form id=aspnetForm><div>{paragraphs(PROSE)}</div></form></body>") == "\n".join(PROSE)
    assert html_text.main_text(f"<body><form><nav>{menu}</nav><article><header><h1>Title</h1></header>{paragraphs(PROSE)}</article></form></body>") == "\n".join(["Title", *PROSE])
    assert html_text.main_text(f"<body><header>{menu}<h1>Site</h1></header><div><h1>Title</h1>{paragraphs(PROSE)}</div><footer><p>All rights reserved, by us.</p></footer></body>") == "\n".join(["Title", *PROSE])
    assert html_text.main_text(f"<body><header>{paragraphs(PROSE)}</header></body>") == "\n".join(PROSE)
    # Readers' comments are never the piece, however long, where there is another.
    comments = f"<div class=comments>{paragraphs(PROSE * 20)}</div>"
    assert html_text.main_text(f"<body><div><h1>Title</h1><p>{PROSE[0]}</p></div>{comments}</body>") == f"Title\n{PROSE[0]}"
    # A short article beside a long footer.
    assert html_text.main_text(f"<body><article><h1>Hi.</h1><p>Hi there.</p></article><footer>&copy; {PROSE[0]} {PROSE[1]}</footer></body>") == "Hi.\nHi there."


class Article(html.parser.HTMLParser):
    """The blocks of a page's article element, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.parts = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.parts.append("") if tag not in html_text.INLINE | {"br"} else None
        self.parts[-1] += " " * (tag == "br")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.parts.append("") if tag not in html_text.INLINE else None

    def handle_data(self, data):
        self.parts[-1] += data if self.depth else ""


def test_html_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        known = Article()
        known.feed(r.html or "")
        known.close()
        assert got[r.page_id] == "\n".join(" ".join(x.split()) for x in known.parts if x.split()), r.page_id


def test_html_odd_rows(spark):
    body = "<article><h1>Title</h1>" + "<p>A paragraph with some words, and a full stop.</p>" * 20_000 + "</article>"
    rows = [(1, "u", PAGE.format(body)), (1, "u", PAGE.format(body)), (1, "v", "<p>Other</p>"), (None, None, "<p>No id</p>")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted(r.text.count("\n") for r in got) == [0, 0, 20_000, 20_000] and {r.page_id for r in got} == {1, None}


# --- 10 ---


def brute_groups(rows, k=5):
    sets = {}
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
            ra, rb = find(a), find(b)
            top[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(rng, n, length, rate, words):
    base = [rng.choice(words) for _ in range(length)]
    return [" ".join(rng.choice(words) if rng.random() < rate else w for w in base) for _ in range(n)]


TINY = dict(block=16, pivots=4, short=4, chunk=2000, part=3000)


@pytest.mark.parametrize("sizes", [{}, {**TINY, "pivots": 0, "short": 2}])
def test_jaccard_groups(spark, sizes):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [*ODD, "x y z", "X Y  z", *near_copies(rng, 120, 80, 0.02, words), *near_copies(rng, 60, 80, 0.008, words), *near_copies(rng, 30, 200, 0.01, words)]
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 15, 40]))) for _ in range(60)]
    texts += [" ".join(rng.choice(words) for _ in range(100)) for _ in range(40)] + [passage] * 40
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    df = frame(spark, texts, ids).withColumn("node", F.lit("clash")).withColumn("rank", F.lit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df, **sizes).collect()}
    assert got == brute_groups(rows)
    both = jaccard_join.jaccard_groups(frame(spark, ["a b c d e f", None, "a b c d e f", "q r s t u v"], [3, None, None, 3]), **sizes).collect()
    assert sorted((r.n_shingles, r.component_id or -1) for r in both) == [(0, -1), (2, -1), (2, 3), (2, 3)]
    assert jaccard_join.jaccard_groups(df.where("false")).count() == 0


def test_jaccard_ids_with_several_texts(spark):
    """An id's texts tie their groups together; a row without an id has no component."""
    one, two = "a b c d e f g h", "q r s t u v w x"
    df = frame(spark, [one, two, None, one, two, "alone in the whole wide world", None, one], [7, 7, 7, 5, 9, 1, None, None])
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df).collect()}
    assert got == {(7, 4, 5), (7, 0, 5), (5, 4, 5), (9, 4, 5), (1, 2, 1), (None, 0, None), (None, 4, None)}
    assert jaccard_join.jaccard_groups(df.where("false")).count() == 0


@pytest.mark.parametrize("sizes", [{}, TINY])
def test_jaccard_links_between_parts_of_long_lists(spark, sizes):
    """Two groups around one passage that only their first sets link, where lists run over partitions and blocks."""
    rng = random.Random(13)
    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passage, filler, one, two = some(60), some(40), some(5), some(13)
    texts = [passage + one, *(passage + one + some(1 + i % 8) for i in range(100)), passage + two, *(passage + two + some(3 + i % 6) for i in range(60))]
    texts += [passage[i : i + 14] + filler for i in range(0, 47, 6)] + [filler + some(60) for _ in range(400)]
    texts = [" ".join(t) for t in texts]
    rows = list(enumerate(texts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(frame(spark, texts), **sizes).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_groups(rows)


def listed(sets):
    """The inverted index of sets: members, and begin and length of each gram's list."""
    own, grams = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    every, starts, lens = np.unique(grams[order], return_index=True, return_counts=True)
    return own[order], every, starts, lens


def test_divide_skip_probes_long_lists(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.permutation(2000)[:100]
    sets = [np.unique(np.r_[base[rng.random(100) > 0.1], rng.integers(0, 2000, 8)]).astype(np.uint64) for _ in range(40)]
    sizes = np.array([len(s) for s in sets])
    probed, choose = [], jaccard_join.long_lists
    monkeypatch.setattr(jaccard_join, "long_lists", lambda lens, need: probed.append(choose(lens, need)) or probed[-1])
    member, every, starts, lens = listed(sets)
    for s in sets:
        shared = np.array([len(np.intersect1d(s, x)) for x in sets])
        at = np.searchsorted(every, s)
        found = jaccard_join.divide_skip((member, starts[at], lens[at]), np.arange(40), jaccard_join.needed(75, len(s), sizes), 40)
        assert found.tolist() == np.flatnonzero(100 * shared >= 75 * (len(s) + sizes - shared)).tolist()
    assert all(len(longs) for longs in probed)


def test_search_block_joins_what_links():
    """Sides and components restrict the search; what is left over joins just the sets that brute force joins."""
    rng = np.random.default_rng(4)
    base = [rng.permutation(500)[:60] for _ in range(4)]
    sets = [np.unique(np.r_[b[rng.random(60) > 0.1], rng.integers(0, 500, 3)]).astype(np.uint64) for b in base for _ in range(15)]
    sizes = np.array([len(s) for s in sets])
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    for comp, side in ((np.arange(60), None), (np.arange(60) // 7, None), (np.arange(60), np.arange(60) % 2)):
        pairs = [(i, j) for i, j in itertools.combinations(range(60), 2) if linked(i, j) and (side is None or side[i] != side[j])]
        found = jaccard_join.search_block(sets, sizes, comp, 75, side)
        assert found and {(min(p), max(p)) for p in found} <= set(pairs)

        def tops(links):
            top = comp.copy()
            for i, j in links:
                top[top == top[j]] = top[i]
            return [top.tolist().index(t) for t in top]

        assert tops(found) == tops(pairs)
        assert len(found) == len(set(comp.tolist())) - len(set(tops(pairs)))


# --- odd rows ---


def test_bpe_on_odd_rows(spark):
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = ["same text", "same text", None, "", "x" * 70_000, "é日"]
    df = frame(spark, texts, [1, 1, None, 2, 3, None]).withColumns({"ids": F.lit("mine"), "offsets": F.lit(1), "n_tokens": F.lit(2), "ids_sha256": F.lit(3)})
    rows = bpe.encode(df, *args).collect()
    assert len(rows) == 6 and sorted(r.doc_id for r in rows if r.doc_id) == [1, 1, 2, 3] and {tuple(r.ids) for r in rows if r.doc_id == 1} == {tuple(rows[0].ids)}
    back = bpe.decode(bpe.encode(df, *args).withColumn("text", F.lit("clash")), *args).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for t in texts)
    trip = bpe.round_trip(df, *args).collect()
    assert sorted(r.decoded_sha256 for r in trip) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in texts)
    none = df.where("false")
    assert bpe.encode(none, *args).count() == bpe.round_trip(none, *args).count() == bpe.decode(bpe.encode(none, *args), *args).count() == 0


def test_nearest_on_odd_rows(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 4)).tolist()
    rows = [(i, v[i]) for i in range(40)] + [(5, v[5]), (5, v[6]), (None, v[7]), (41, None), (42, [0.0] * 4), (43, [1.0, None, 1.0, 1.0]), (44, [float("inf")] * 4), (45, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"query_id": F.lit(1), "rank": F.lit(2), "score": F.lit("x"), "v": F.lit(3)})
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, k=3).orderBy("query_id", "rank").collect()]
    usable = [(i, x) for i, x in rows if i is not None and i < 41]
    far = sorted({(float(np.sqrt(((np.array(x) - np.array(v[0])) ** 2).sum())), i, tuple(x)) for i, x in usable if i != 0})
    assert [(q, k) for q, k, *_ in got] == [(0, 1), (0, 2), (0, 3)] and got[0][2] == far[0][1] and all(abs(s - next(d for d, i, _ in far if i == c)) < 1e-12 or c == 5 for _, _, c, s in got)
    assert ann.search(df.where("false")).count() == ann.search(df.where("vec_id > 40")).count() == 0


def test_copies_on_odd_rows(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    item, other = words("item", 12), words("other", 9)
    texts = [f"{words('a', 20)} {item} {words('b', 30)} {item}", f"{words('c', 7)} {item}", f"{words('c', 7)} {item}", f"{words('d', 3)} {other}", words("e", 50), None, "", f"{words('g', 60_000)} {other} {words('h', 9)}", item]
    df = frame(spark, texts, [0, 1, 1, 1, 4, 5, 6, 7, None]).withColumns({"item_id": F.lit(9), "score": F.lit("x"), "first_word": F.lit(1), "twin": F.lit(2), "base": F.lit(3), "words": F.lit(4), "grams": F.lit(5)})
    bench = spark.createDataFrame([(1, item), (2, other), (2, item.upper()), (3, None), (4, ""), (5, "two words"), (None, words("e", 50))], "item_id long, text string").withColumns({"doc_id": F.lit(1), "at": F.lit(2), "base": F.lit(3)})
    got = {(r.doc_id, r.item_id): (r.score, r.first_word, r.end_word) for r in decontaminate.find_copies(df, bench).collect()}
    # Both texts of item 2 stand in documents with the id 1; the tie goes to the first place.
    assert got == {(0, 1): (1.0, 20, 32), (0, 2): (1.0, 20, 32), (1, 1): (1.0, 7, 19), (1, 2): (1.0, 3, 12), (7, 2): (1.0, 60_000, 60_009)}
    assert decontaminate.find_copies(df.where("false"), bench).count() == decontaminate.find_copies(df, bench.where("false")).count() == 0
