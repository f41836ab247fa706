"""Vectors with known answers: predicates, exact sums, paging, histograms, generated rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.functions import predicates as P
from tidemark.operators import aggregates as A
from tidemark.operators import rows as R
from tidemark.sources.adapters import attribute

BIG = "9" * 38


@pytest.fixture(scope="module")
def ten(spark):
    text = lambda path, v: attribute("attributes", path, "string", string=F.lit(v))
    one = {
        "a": ("literal a_%b marker", []), "b": ("missing differs from null", [attribute("attributes", "/v", "null")]), "c": ("integer one", [attribute("attributes", "/v", "integer", integer=F.lit(1))]),
        "d": ("string one", [text("/v", "1")]), "e": ("integer two", [attribute("attributes", "/v", "integer", integer=F.lit(2))]), "f": ("array", [text("/features/0", "checkout"), text("/features/0/name", "checkout")]),
        "g": ("dotted", [text("/a.b", "x")]), "h": ("nested", [text("/a/b", "x")]), "i": ("ÄPFEL", []), "j": ("request timed out", []),
    }
    from tidemark.sources.schema import ATTRIBUTE

    out = None
    for name, (message, attrs) in one.items():
        row = spark.range(1).select(F.lit(name).alias("id"), F.lit(message).alias("message"), (F.array(*attrs) if attrs else F.array()).cast(f"array<{ATTRIBUTE}>").alias("attrs"), F.array(F.lit("health database" if name == "i" else message)).alias("search_values"))
        out = row if out is None else out.union(row)
    return out.cache()


def test_ten_rows(ten):
    v = P.attr("attributes", "/v", "integer")
    cases = {
        "bcde": P.exists("attributes", "/v"), "b": P.is_null("attributes", "/v"), "c": P.eq(v, 1), "e": P.ne(v, 1), "abdefghij": P.not_(P.eq(v, 1)), "d": P.eq(P.attr("attributes", "/v", "string"), "1"),
        "a": P.contains(F.col("message"), "a_%b"), "f": P.array_contains("attributes", "/features", "string", "checkout"), "g": P.exists("attributes", "/a.b"), "h": P.exists("attributes", "/a/b"),
        "i": P.icontains(F.col("message"), "ä"), "j": P.matches(F.col("message"), "timeout|timed out"),
    }
    for ids, p in cases.items():
        assert "".join(sorted(r[0] for r in ten.where(p).select("id").collect())) == ids
    assert [r[0] for r in ten.where(P.text("database")).select("id").collect()] == ["i"]


def test_pattern_rules():
    for bad in ("(?=a)", "(?<!a)b", r"(a)\1", "a++", "x" * 1025):
        with pytest.raises(ValueError):
            P.matches(None, bad)


def test_a_path_stored_twice_fails(ten):
    twice = ten.where("id = 'c'").withColumn("attrs", F.concat("attrs", "attrs"))
    with pytest.raises(Exception, match="stored twice"):
        twice.where(P.eq(P.attr("attributes", "/v", "integer"), 1)).collect()


def _sum(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string").select(F.col("x").cast("decimal(38,0)").alias("x"))
    s = df.agg(F.count("x").alias("n"), *exact.limb_sums(F.col("x"), "l"))
    limbs = [F.col(f"l{i}") for i in range(exact.LIMBS)]
    return s, limbs


@pytest.mark.parametrize("values,total", [([BIG, "1", "-1"], BIG), (["-" + BIG, "-1", "1"], "-" + BIG), (["-1", "1"], "0"), ([], None), (["-1000000000", "1"], "-999999999")])
def test_exact_sum(spark, values, total):
    s, limbs = _sum(spark, values)
    got = s.select(exact.finish_sum(limbs).cast("string")).first()[0]
    assert got == total


def test_exact_sum_overflow(spark):
    s, limbs = _sum(spark, [BIG, "1"])
    with pytest.raises(Exception, match="38 digits"):
        s.select(exact.finish_sum(limbs)).collect()


@pytest.mark.parametrize("values,mean", [([BIG, BIG], BIG + ".000000000"), (["2", "4", "100"], "35.333333333"), (["-2", "-4", "-100"], "-35.333333333"), ([], None)])
def test_exact_average(spark, values, mean):
    s, limbs = _sum(spark, values)
    assert s.select(exact.exact_average(F.col("n"), *limbs)).first()[0] == mean


@pytest.mark.parametrize("n,count,text", [(1, 2 * 10**9, "0.000000000"), (3, 2 * 10**9, "0.000000002"), (-3, 2 * 10**9, "-0.000000002")])
def test_half_even(spark, n, count, text):
    one = spark.range(1).select(exact.exact_average(F.lit(count).cast("bigint"), *(F.lit(x).cast("decimal(38,0)") for x in (n, 0, 0, 0, 0))))
    assert one.first()[0] == text


def test_top_groups_after_the_merge(spark):
    rows = spark.createDataFrame([("A", 11), ("X", 10), ("B", 11), ("X", 10)], "g string, n int").groupBy("g").agg(F.sum("n").alias("n"))
    assert [tuple(r) for r in A.top_groups(rows, F.col("n"), [F.col("g")], 1).collect()] == [("X", 20)]


def test_keyset_pages(spark):
    rows = spark.createDataFrame([(100, 1, "c"), (100, 1, "b"), (100, 0, "z"), (99, 999, "z")], "event_time_us bigint, event_time_ns_remainder int, record_id string")
    first = [tuple(r) for r in R.page(rows, R.EVENT_ORDER, 2).collect()]
    assert first == [(100, 1, "c"), (100, 1, "b"), (100, 0, "z")]
    assert [tuple(r) for r in R.page(rows, R.EVENT_ORDER, 2, first[1]).collect()] == [(100, 0, "z"), (99, 999, "z")]


def test_histogram_starts(spark):
    assert [r[0] for r in A.series(spark, -1, 1_000_001, 1_000_000).orderBy("bucket").collect()] == [-1_000_000, 0, 1_000_000]


def test_generated_counts(spark):
    i = F.col("id")
    has_id = i % 17 != 0
    null, missing = i % 31 == 0, i % 29 == 0
    row = spark.range(100_000).agg(
        F.count_if(i % 21 == 0), F.count_if(has_id & (i % 101 == 100)), F.count_if(~has_id), F.count_if(i % 97 == 0), F.count_if(null), F.count_if(missing), F.count_if(i % 23 == 0),
        F.count_if((i % 21 != 0) & ~missing & ~null & (i % 1000 - 500 > 100)),
    ).first()
    assert tuple(row) == (4_762, 932, 5_883, 1_031, 3_226, 3_449, 4_348, 35_510)


def test_message_preview_keeps_whole_characters(spark):
    texts = ["a" * 10, "é" * 1030, "x" + "é" * 1030, "日" * 700, "xy" + "😀" * 600, "a" * 2048, "a" * 2049]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    text, cut = R.preview(F.col("t"))
    for t, (got, was_cut) in zip(texts, df.select(text, cut).collect()):
        assert got == t.encode()[:2048].decode("utf-8", "ignore")
        assert was_cut == (len(t.encode()) > 2048)


def test_ordered_hash_streams_groups_larger_than_a_batch(spark):
    """Groups, the null key among them, go on over batches, and none of them becomes one value."""
    rows = [(k, f"{(i * 7919) % 1000:04d}é" if i % 50 else None) for k in ("a", None, "b") for i in range(1000)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        hashes = A.ordered_hashes(df, ["k"], "v", "hash")
        got = {r.k: r.hash for r in hashes.collect()}
        joined = A.with_ordered_hash(df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), df, ["k"], "v", "hash")
        assert {r.k: (r.n, r.hash) for r in joined.collect()} == {k: (1 if k == "none" else 1000, h) for k, h in got.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    values = {k: sorted(v for x, v in rows if x == k and v is not None) for k in ("a", None, "b")}
    assert got == {"none": None} | {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in values.items()}
    assert "listagg" not in hashes._jdf.queryExecution().toString()


def test_group_key_bytes(spark):
    """Doubles give their eight big-endian bytes, zero without a sign; negative ones come last."""
    import struct

    values = [0.0, -0.0, 0.1, 2.5, 1e300, -1.5, 5e-324]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = dict(df.select("i", A.key_bytes(A.key_of(F.col("x"), "double"))).collect())
    assert {i: bytes(b) for i, b in got.items()} == {i: b"d" + struct.pack(">d", v if v else 0.0) for i, v in enumerate(values)}


def test_timestamps(spark):
    from tidemark.functions import scalars as S

    known = {
        "1": (1_000_000, 0), "-1": (-1_000_000, 0), "1.0000000019": (1_000_000, 1), "1.9999999999999999999": (1_999_999, 999), "-1e-20": (-1, 999), "1e-20": (0, 0), "-0.0000000015": (-1, 998), "12e2": (1_200_000_000, 0),
        "1e30": (None, None), "999999999999e40": (None, None), "0e99": (0, 0), "1700000000.123456789": (1_700_000_000_123_456, 789), "abc": (None, None), "1\n": (None, None), "-1e-3": (-1000, 0), "9223372036854.775807": (9223372036854775807, 0), "9223372036854.775808": (None, None),
        "1970-01-01T00:00:01.5Z": (1_500_000, 0), "1969-12-31T23:59:59.999999999Z": (-1, 999),
    }
    us, ns = S.parse_timestamp(F.col("raw"))
    got = {r[0]: (r[1], r[2]) for r in spark.createDataFrame([(k,) for k in known], "raw string").select("raw", us, ns).collect()}
    assert got == known


def test_ids_levels_and_types(spark):
    from tidemark.functions import scalars as S

    r = spark.range(1).select(
        S.trace_id(F.lit("a" * 32 + "\n")).alias("newline"), S.span_id(F.lit("AB" * 8)).alias("span"), S.span_id(F.lit("0" * 16)).alias("zero"),
        S.level(F.lit(" error "), True).alias("blank"), S.level(F.lit("WARN"), True).alias("warn"), S.unsupported_type(F.lit("é" * 90)).alias("type"), S.unsupported_type(F.lit("x" + "é" * 90)).alias("odd"),
    ).first()
    assert (r.newline, r.span, r.zero, r.blank, r.warn) == (None, "ab" * 8, None, "unknown", "warning")
    tail = lambda t: "#" + hashlib.sha256(t.encode()).hexdigest()[:16]
    assert r.type == "é" * 50 + tail("é" * 90) and r.odd == "x" + "é" * 49 + tail("x" + "é" * 90)


def test_issue_groups(spark):
    import json

    from tidemark.operators import issues

    frame = lambda **k: {"module": "m", "function": "f", "filename": "a.py", **k}
    thrown = lambda *frames, kind="T", value="v": {"type": kind, "value": value, "stacktrace": {"frames": list(frames)}}
    raws = {
        "own": [thrown(frame(in_app=True), frame(function="lib"))], "own_value": [thrown(frame(in_app=True), value="other")], "foreign": [thrown(frame(function="lib"))], "windows": [thrown(frame(filename="x\\a.py"))], "posix": [thrown(frame(filename="x/a.py"))],
        "first_differs": [thrown(frame(function="z"), kind="A"), thrown(frame(in_app=True))], "first_same": [thrown(frame(function="y"), kind="A"), thrown(frame(in_app=True))], "bare": [{"type": "T", "value": "1"}], "bare_other": [{"type": "T", "value": "2"}],
    }
    rows = [(k, 1, json.dumps({"exception": {"values": v}}), "m", None) for k, v in raws.items()] + [("project", 2, json.dumps({"exception": {"values": raws["own"]}}), "m", None)]
    rows += [(k, 1, json.dumps({"fingerprint": f}), "said", "t") for k, f in (("custom", ["a", "{{ default }}"]), ("custom_same", ["a", "{{default}}"]), ("joined", ["a|b"]), ("apart", ["a", "b"]), ("number", ["a", 5]), ("none", []))]
    rows += [("template", 1, "{}", "other", "t"), ("message", 1, "{}", "said", None)]
    df = spark.createDataFrame(rows, "k string, p int, raw string, message string, template string")
    got = dict(df.select("k", issues.fingerprint(F.col("p"), F.col("raw"), F.col("message"), F.col("template"))).collect())
    same = [{"own", "own_value"}, {"windows", "posix"}, {"first_differs", "first_same"}, {"custom", "custom_same"}, {"number", "none", "template"}]
    groups = {}
    for k, v in got.items():
        groups.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted([*map(sorted, same), *([k] for k in got if not any(k in s for s in same))])
    title = lambda m, t, v: spark.range(1).select(issues.title(*(F.lit(x).cast("string") for x in (m, t, v)))).first()[0]
    assert (title("said", "T", "v"), title("", "T", "v"), title(None, "T", ""), title("", "", "v")) == ("said", "T: v", "T", "v")


def test_running_sums_over_ranges(spark):
    """A key that holds most rows, a null key, many ranges."""
    import itertools

    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 5}", i * 7919 % 1000, i % 17) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, at int, n int").repartition(7)
    got = {(r.k, r["at"]): r.until for r in R.running(df, ["k"], [F.col("at").asc()], F.col("n"), "until").collect()}
    expected = {}
    for k, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
        for (_, at, _), until in zip(group := list(group), itertools.accumulate(n for *_, n in group)):
            expected[k, at] = until
    assert got == expected and len(got) == 1000


def test_dedupe_hash(spark):
    from tidemark.operators import ingest

    own = "a" * 32
    rows = [("error", own, '{"b":1,"event_id":"x","a":2}'), ("error", own.upper(), '{"a":2, "b":1, "event_id":"y"}'), ("error", own, '{"a":2,"b":1.0}'), ("transaction", own, '{"a":2,"b":1}'), ("log", own, "{}"), ("error", "0" * 32, "{}"), ("error", None, "{}"), ("error", own, "[1]"), ("error", own, "no")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, id string, raw string")
    got = dict(df.select("i", ingest.dedupe_hash(F.col("kind"), F.col("id"), F.col("raw"))).collect())
    assert got[0] == got[1] == hashlib.sha256(f'{{"version":1,"kind":"error","source_event_id":"{own}","raw":{{"a":2,"b":1}}}}'.encode()).hexdigest()
    assert len({got[0], got[2], got[3]}) == 3 and all(got[i] is None for i in (4, 5, 6, 7, 8))


def test_request_limits(spark):
    from tidemark.operators.ingest import request_limits

    rows = spark.range(40).selectExpr("id div 4 as request", "if(id = 5, 100, 10) as size", "if(id = 9, 2000, if(id = 12, null, 1)) as attrs").union(spark.range(7).selectExpr("99L", "1", "1"))
    got = {r["request"]: (r["records"], r["total_bytes"], r["reason"]) for r in request_limits(rows, ["request"], F.col("size"), F.col("attrs"), most_records=6, most_total=42, most_bytes=50).collect()}
    assert got[0] == (4, 43, "request_too_large") and got[1] == (4, 133, "record_too_large") and got[2][2] == "too_many_attributes" and got[99] == (7, 13, "too_many_records")
    assert request_limits(rows, ["request"], F.col("size"), F.col("attrs")).where("request = 0").first()["reason"] is None
    assert request_limits(rows.limit(0), ["request"], F.col("size"), F.col("attrs")).count() == 0


def test_json_guard_limits():
    from tidemark.operators.normalize import guarded

    nest = lambda n: "[" * n + "]" * n
    assert guarded(nest(64))[1] is None and guarded(nest(65))[1] == "too_deep" and guarded(nest(100_000))[1] == "too_deep"
    assert guarded("[" + ",".join(["1"] * 19_999) + "]")[1] is None and guarded("[" + ",".join(["1"] * 20_000) + "]")[1] == "too_many_nodes"
    assert guarded('{"a":1,"a":2}')[1] == "repeated_key" and guarded('{"b":{"a":1},"a":2}')[1] is None and guarded("1 2")[1] == guarded("[NaN]")[1] == "no_json" and guarded(None)[1] == "empty"


def test_lone_surrogates_are_replaced(spark):
    from tidemark.operators.normalize import guard_and_scrub

    rows = spark.createDataFrame([(r'{"a":"\ud800x\ud83d\ude00"}',)], "raw string")
    r = guard_and_scrub(rows).first()
    assert r["reject_reason"] is None and r["raw"] == '{"a":"\ufffdx\U0001f600"}'


def test_log_fields_keep_their_types(spark):
    from tidemark.operators.normalize import normalize_logs

    texts = [
        '{"level":"info","severity_number":null}', '{"level":"bogus","severity_number":5.0}', '{"attributes":{"sentry.severity_number":null}}', '{"attributes":{"server.address":1,"server.name":"s"}}',
        '{"attributes":{"sentry.severity_text":"warn"},"severity_number":21}', "no json", None, '{"body":5,"severity_number":25}',
    ]
    got = [r for r in normalize_logs(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string"), "d").orderBy("i").collect()]
    assert [r["level"] for r in got] == ["info", "unknown", "unknown", "unknown", "warning", "unknown", "unknown", "unknown"]
    assert [r["severity_number"] for r in got] == [9, None, None, None, 21, None, None, None]
    assert [r["warnings"] for r in got] == [[], ["invalid_severity_number"], ["invalid_severity_number"], [], [], [], [], ["invalid_severity_number"]]
    assert [r["server_name"] for r in got] == [None] * 8 and got[3]["service"] == "d" and got[7]["message"] == ""


def test_compaction_inputs(spark):
    from tidemark.operators.maintenance import verify_inputs

    sha = lambda ids: hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()
    held = {"ok": "ab", "lost": "ab", "foreign": "ab", "swapped": "ab", "gone": "ab"}
    inputs = spark.createDataFrame([(k, sha(v)) for k, v in held.items()], "input string, identity_sha256 string")
    left = [("ok", "a", 1), ("ok", "b", 1), ("lost", "a", 1), ("lost", "b", 1), ("foreign", "a", 1), ("foreign", "b", None), ("swapped", "a", 1), ("swapped", "c", 1), ("gone", "a", 1), ("gone", "b", 1)]
    right = [("ok", "b"), ("ok", "a"), ("lost", "a"), ("foreign", "a"), ("foreign", "b"), ("swapped", "a"), ("swapped", "c")]
    analytics, payloads = spark.createDataFrame(left, "input string, record_id string, lane int"), spark.createDataFrame(right, "input string, record_id string")
    got = {r["input"]: r["problem"] for r in verify_inputs(inputs, analytics, payloads, F.col("lane") == 1).collect()}
    assert got == {"ok": None, "lost": "identity", "foreign": "scope", "swapped": "identity", "gone": "missing"}
    assert verify_inputs(inputs.limit(0), analytics, payloads, F.col("lane") == 1).count() == 0


def test_issue_decisions(spark):
    from tidemark.operators.alerts import decisions

    second = 1_000_000
    # Lane, sequence and id order them; the third row's time is behind, so it counts as at 100; the fourth shares that time.
    rows = [(1, 0, 1, "a", 0), (1, 0, 2, "b", 100), (1, 0, 3, "c", 40), (1, 1, 1, "d", 100), (1, 1, 2, "e", 159), (1, 1, 2, "f", 160), (2, 0, 1, "g", 5), (3, 0, 1, "h", 5), (3, 0, 2, "i", 5)]
    p = spark.createDataFrame([(a, l, b, r, t * second) for a, l, b, r, t in rows], "alert_id int, lane_id int, batch_seq int, record_id string, received_time_us bigint")
    got = {r["record_id"]: r["decision"] for r in decisions(p, F.col("alert_id") != 2, F.when(F.col("alert_id") == 3, 0).otherwise(60)).collect()}
    assert got == dict(a="sent", b="sent", c="cooldown", d="cooldown", e="cooldown", f="sent", g="disabled", h="sent", i="sent")
    assert decisions(p.limit(0), F.lit(True), F.lit(60)).count() == 0


def test_retention_of_occurrences_links_and_claims(spark):
    from tidemark.operators import maintenance as M

    o = spark.createDataFrame([(1, "a", 5), (1, "b", 15), (1, "c", 25), (2, "d", 15)], "tenant_id int, record_id string, received_time_us bigint")
    live = spark.createDataFrame([(1, 18), (1, 12)], "tenant_id int, floor_us bigint")
    gone = M.expired_occurrences(o, 20, live)
    assert sorted(r[0] for r in gone.collect()) == ["a", "d"]
    links = M.unlink(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, record_id string"), gone.union(gone))
    assert sorted(map(tuple, links.collect())) == [(1, None), (2, "b"), (3, None)]
    day = 86_400_000_000
    claims = spark.createDataFrame([("new", 30 * day, 1), ("live", 0, 50 * day), ("old", 0, 1), ("open", 0, None)], "id string, created_us bigint, expires_us bigint")
    assert sorted(r["id"] for r in M.live_claims(claims, 40 * day, 30).collect()) == ["live", "new", "open"]


URLS = {
    "/a?b=1&a=2#f": "/a?a=X&b=X#f", "/a": "/a", "/a?": "/a?", "/a?&&": "/a", "/a?&#x": "/a#x", "?=1&k": "?=X&k=X", "/x?a%zz=1&b=2": "/x?b=X", "/x?a;b=1&c": "/x?c=X",
    "/x?%C3%A9=1&z+y=2&~*-_.=3&B=1&a=1&a=2": "/x?B=X&a=X&a=X&z+y=X&~%2A-_.=X&%C3%A9=X", "/x?a=1?b=2&c=3": "/x?a=X&c=X", "": "", "/x#?a=1": "/x#?a=1", "/x?a=1\n#b\nc": "/x?a=X#b\nc",
}


def test_one_rule_for_the_query_values_of_urls(spark):
    from tidemark.functions.scalars import scrub_url
    from tidemark.operators.normalize import scrub_url_text, scrub_value

    expected = {u: v.replace("X", "%5BFiltered%5D") for u, v in URLS.items()}
    rows = spark.createDataFrame([(u,) for u in [*URLS, None]], "u string").select("u", scrub_url(F.col("u")).alias("s")).collect()
    assert {r.u: r.s for r in rows} == {**expected, None: None}
    assert {u: scrub_url_text(u) for u in URLS} == expected
    assert scrub_value({"page_url": "/a?t=1", "note": "/a?t=1"}) == {"page_url": "/a?t=%5BFiltered%5D", "note": "/a?t=1"}


def test_canonical_json_makes_no_decoder_per_text(monkeypatch):
    """Texts share one decoder; numbers keep their spelling, and what is no JSON gives null."""
    from tidemark.functions import scalars

    def refuse(*_, **__):
        raise AssertionError("a decoder or an encoder for one text")

    monkeypatch.setattr(scalars.json, "loads", refuse)
    assert scalars._canonical('{"b":[1.50,1e0,-0,"1"],"a":{"z":"\\u00e9\\n\\u2028","id":7},"id":1}', "id") == '{"a":{"id":7,"z":"é\\n\u2028"},"b":[1.50,1e0,-0,"1"]}'
    assert scalars._canonical("[true,null,NaN]") == "[true,null,NaN]"
    assert [scalars._canonical(t) for t in (None, "", "\ufeff1", "{", "1 2")] == [None] * 5


def test_attributes_make_no_decoder_per_text(monkeypatch):
    from tidemark.operators import normalize

    def refuse(*_, **__):
        raise AssertionError("a decoder for one text")

    monkeypatch.setattr(normalize.json, "loads", refuse)
    assert [a["integer_value"] for a in normalize.log_attributes('{"attributes":{"n":7}}')] == ["7"]
    assert [a["double_value"] for a in normalize.event_attributes('{"tags":{"n":1e0}}')] == [1.0]
    assert [normalize.event_attributes(t) for t in (None, "", "\ufeff{}", "{", "[]")] == [[]] * 5


def test_fingerprint_reads_each_path_once_and_escaped_keys_too(spark):
    from tidemark.functions import scalars as S
    from tidemark.operators import issues

    e = '{"type":"T","value":"v","stacktrace":{"frames":[{"module":"m","filename":"a\\\\b.py"}]}}'
    texts = [f'{{"exception":[{e}]}}', f'{{"\\u0065xception":{{"values":[{e}]}}}}', f"{{'exception':{e}}}", '{"message":"exception"}', '{"logentry":{"message":"t %s","formatted":"t 1"},"fingerprint":["a", "{{default}}"]}', "{", None]
    stack = '["stack",["T"],[["m","","a/b.py"]]]'
    groups = [stack, stack, stack, '["message","exception"]', '["custom",[["literal","a"],["default",["message","t %s"]]]]', '["message",""]', '["message",""]']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    said = S.let(S.event_told(F.col("raw")), lambda t: F.coalesce(t["template"], t["message"]))
    got = df.select("i", issues.fingerprint(F.lit(7), F.col("raw"), said, F.lit(None)).alias("f"))
    assert [r.f for r in got.orderBy("i").collect()] == [hashlib.sha256(f'["grouping-v1",["7"],{g}]'.encode()).hexdigest() for g in groups]
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("$.fingerprint") == 1 and plan.count("$.exception.values") == 2 and plan.count("$.logentry.formatted") == 1


def test_ordered_hash_takes_packed_blocks(spark):
    """Random ids go to the one task that hashes them in about half their bytes, in few rows; values repeat over blocks."""
    ids = sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(20_000))
    few = [""] * 300 + ["a"] + ["b"] * 700 + ["bc", "é\n"]
    df = spark.createDataFrame([("ids", v) for v in ids] + [("few", v) for v in few[::-1]], "k string, v string").repartition(4)
    blocks = {r["k"]: r for r in A.packed(df, ["k"], "v").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("__block")).alias("bytes")).collect()}
    assert blocks["ids"]["n"] < 200 and blocks["ids"]["bytes"] < 0.55 * 65 * len(ids)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        hashes = A.ordered_hashes(df, ["k"], "v", "hash")
        got = {r.k: r.hash for r in hashes.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in (("ids", ids), ("few", few))}
    plan = hashes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression [k") < plan.rindex("MapInArrow") and plan.count("MapInArrow") == 2


def test_log_entries_are_plain_columns(spark):
    """No map of all attributes is made and nothing is interpreted row by row; wrapped, absent, null and odd values stay apart."""
    from tidemark.operators import normalize

    texts = ['{"level":"warn","severity_number":"5","attributes":{"sentry.severity_number":{"type":"integer","value":9}}}', '{"severity_number":null,"attributes":{"sentry.severity_number":{"x":1}}}', '{"severity_number":null,"attributes":[]}', '{"severity_number":17,"attributes":{"sentry.severity_text":{"value":null},"service.name":7}}', '{"a":1,"a":2}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    logs = normalize.normalize_logs(df, "fallback")
    got = [(r.level, r.severity_number, r.service, r.warnings) for r in logs.orderBy("i").collect()]
    assert got == [("warning", 9, "fallback", ["severity_level_conflict"]), ("unknown", None, "fallback", ["invalid_severity_number"]), ("unknown", None, "fallback", []), ("unknown", 17, None, []), ("unknown", None, "fallback", []), ("unknown", None, "fallback", [])]
    plan = logs.select("i", "warnings")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "map<string,variant>" not in plan and "transform" not in plan and "server.address" not in plan
