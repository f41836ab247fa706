"""Stateful streams against slow folds in Python: restarts, expiry, repeated rows, actions between micro-batches."""

import random
import tempfile

from tidemark.streaming import jobs as J
from tidemark.streaming import state as S

CLAIM = "project_id bigint, kind string, source_event_id string, record_id string, batch_seq bigint, record_ordinal int, received_time_us bigint, payload_sha256 string"


def source(spark, schema):
    """A folder, a stream over it that takes a file a micro-batch, and how to add a file."""
    path = tempfile.mkdtemp(prefix="arrivals-")
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    add([])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), add


def run(stream, out, without_data=False):
    with S.rocksdb(stream.sparkSession, without_data):
        return J.run_to_table(stream, out=out)


def test_claims_restart_and_expire(spark):
    stream, add = source(spark, CLAIM)
    hour = 3_600_000_000
    row = lambda i, sid, t, digest: (1, "error", sid, f"r{i}", i, 0, t, digest)
    classes, out = S.classify(stream, hour), f"{tempfile.mkdtemp()}/out"
    add([row(1, "a", 0, "x"), row(2, "a", 5, "x"), row(3, "a", 6, "y"), row(4, None, 6, "y"), row(5, None, 6, "y")])
    assert {(r["record_id"], r["class"]) for r in run(classes, out).collect()} == {("r1", "accepted"), ("r2", "duplicate"), ("r3", "conflict"), ("r4", "accepted"), ("r5", "accepted")}
    # A start from the checkpoint knows the claim; at its end the key is free, and the next row's hash holds.
    add([row(6, "a", hour - 1, "y"), row(7, "a", hour, "y"), row(8, "a", hour + 1, "x"), row(9, "b", 7, "x")])
    got = {r["record_id"]: r["class"] for r in run(classes, out).collect()}
    assert len(got) == 9 and [got[f"r{i}"] for i in range(6, 10)] == ["conflict", "accepted", "conflict", "accepted"]


def test_claims_follow_a_slow_fold(spark):
    rng, stream_rows = random.Random(4), []
    for i in range(600):
        stream_rows.append((1, "error", f"s{rng.randint(0, 40)}", f"r{i}", i, 0, i * 1000 + rng.randint(0, 500), rng.choice("xyz")))
    held, expected = {}, {}
    for p, k, sid, r, _, _, t, digest in stream_rows:
        if sid not in held or held[sid][1] <= t:
            held[sid], expected[r] = (digest, t + 50_000), "accepted"
        else:
            expected[r] = "duplicate" if held[sid][0] == digest else "conflict"
    stream, add = source(spark, CLAIM)
    out = f"{tempfile.mkdtemp()}/out"
    for a in range(0, 600, 200):
        add(stream_rows[a : a + 200])
        got = run(S.classify(stream, 50_000), out)
    assert {r["record_id"]: r["class"] for r in got.collect()} == expected


def slow_issues(items):
    """Transitions of items in their order."""
    states, out = {}, []
    for kind, issue, x in items:
        s = states.get(issue)
        if kind == "row":
            if s is None:
                states[issue] = s = {"status": "unresolved", "revision": 1, "cut": None, "n": 0}
                new = "created"
            elif s["status"] == "resolved" and x["seq"] > s["cut"][x["lane"]]:
                s["status"], s["revision"], new = "unresolved", s["revision"] + 1, "regressed"
            else:
                new = None
            s["n"] += 1
            if new:
                out.append((issue, s["revision"], new, x["id"], s["n"]))
        elif s is not None and s["status"] != S._TARGET[x["action"]]:
            s.update(status=S._TARGET[x["action"]], revision=s["revision"] + 1, cut=x["cut"])
            out.append((issue, s["revision"], x["action"], None, s["n"]))
    return sorted(out)


def test_issues_follow_a_slow_fold_over_restarts_and_replays(spark):
    rng = random.Random(7)
    rows, acts, items = [], [], []
    for seq in range(1, 61):
        for lane in range(3):
            for ordinal in range(rng.randint(0, 2)):
                issue = rng.choice("abc")
                rows.append((1, issue, seq, lane, ordinal, f"{seq}-{lane}-{ordinal}", rng.randint(0, 1000)))
        for _ in range(rng.randint(0, 1)):
            acts.append((1, rng.choice("abcd"), seq, len(acts), rng.choice(list(S._TARGET)), [seq + lane - 1 for lane in range(16)]))
    for part in range(3):
        lo, hi = part * 20, part * 20 + 20
        here = [(r[2], 0, r[3], r[4], ("row", r[1], {"seq": r[2], "lane": r[3], "id": r[5]})) for r in rows if lo < r[2] <= hi]
        here += [(a[2], 1, a[3], 0, ("act", a[1], {"action": a[4], "cut": a[5]})) for a in acts if lo < a[2] <= hi]
        items += [x[-1] for x in sorted(here, key=lambda x: x[:4])]
    row_stream, add_rows = source(spark, "project_id bigint, issue_id string, batch_seq bigint, lane_id int, record_ordinal int, record_id string, event_time_us bigint")
    act_stream, add_acts = source(spark, "project_id bigint, issue_id string, batch_seq bigint, action_id bigint, action string, cut array<bigint>")
    out = f"{tempfile.mkdtemp()}/out"
    for part in range(3):
        lo, hi = part * 20, part * 20 + 20
        mine, theirs = [r for r in rows if lo < r[2] <= hi], [a for a in acts if lo < a[2] <= hi]
        rng.shuffle(mine)
        add_rows(mine + mine[:5])
        add_acts(theirs)
        got = run(S.issue_transitions(row_stream, act_stream), out)
    add_rows(rows)  # a replay of everything
    add_acts(acts)
    got = run(S.issue_transitions(row_stream, act_stream), out)
    assert sorted((r.issue_id, r.revision, r.type, r.record_id, r.occurrences) for r in got.collect()) == slow_issues(items)
    assert {t for _, _, t, _, _ in slow_issues(items)} == {"created", "regressed", "resolved", "ignored", "reopened"}


def test_alert_windows_close_as_time_passes(spark):
    minute = S.MINUTE
    rules = [(1, 1, 120, "lt", 1, 180, 0), (2, 1, 60, "ge", 2, 0, 30 * minute), (3, 2, 60, "ge", 1, 0, 0)]
    rules = spark.createDataFrame(rules, "alert_id bigint, project_id bigint, window_seconds int, operator string, threshold int, cooldown_seconds int, created_us bigint")
    rng = random.Random(9)
    times = sorted(rng.randint(0, 100 * minute) for _ in range(60))
    stream, add = source(spark, "project_id bigint, received_time_us bigint")
    out = f"{tempfile.mkdtemp()}/out"
    for part in (times[:25], times[25:45], times[45:]):
        add([(1, t) for t in part])
        got = run(S.alert_evaluations(stream, rules, "1 minute"), out, True)
    mark = (max(times) - minute) // 1000 * 1000
    expected, fired = set(), {}
    for alert, project, window, op, threshold, cooldown, created in [(r.alert_id, r.project_id, r.window_seconds * 1_000_000, r.operator, r.threshold, r.cooldown_seconds * 1_000_000, r.created_us) for r in rules.collect()]:
        end = (created // minute + 1) * minute + window
        while end <= mark:
            n = sum(end - window <= t < end for t in times) if project == 1 else 0
            hit = n < threshold if op == "lt" else n >= threshold
            fires = hit and (alert not in fired or end - fired[alert] >= cooldown)
            fired.update({alert: end} if fires else {})
            expected.add((alert, end, n, hit, fires))
            end += minute
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert any(n == 0 for _, _, n, _, _ in expected) and len({a for a, *_ in expected}) == 3


def test_outbox_sends_each_key_once(spark):
    stream, add = source(spark, "project_id bigint, hour bigint, note string")
    out = f"{tempfile.mkdtemp()}/out"
    for part in ([(1, 1, "a"), (1, 1, "b"), (2, 1, "c")], [(1, 1, "d"), (3, 1, "e")], [(3, 1, "f"), (1, 2, "g")]):
        add(part)
        got = run(S.once(stream, ["project_id", "hour"], 86_400_000), out)
    rows = [(r.project_id, r.hour) for r in got.collect()]
    assert sorted(rows) == [(1, 1), (1, 2), (2, 1), (3, 1)]


class ListState:
    """A list state in memory that counts its calls."""

    def __init__(self):
        self.items, self.calls = [], 0

    def getListState(self, name, schema, ttl):
        return self

    def get(self):
        self.calls += 1
        return iter(list(self.items))

    def appendValue(self, value):
        self.calls += 1
        self.items.append(value)

    def put(self, values):
        self.calls += 1
        self.items = list(values)


def test_claims_of_many_keys_take_few_calls_of_the_state():
    """A bucket is read once and added to once, however many keys a micro-batch has; merged lists keep what can still hold."""
    import pandas as pd

    state = ListState()
    claims = S.Claims(1_000, 5)
    claims.init(state)

    def classes(seq, keys, t, digest):
        n = len(keys)
        rows = pd.DataFrame({"key": keys, "record_id": [f"{seq}-{i}" for i in range(n)], "batch_seq": seq, "record_ordinal": range(n), "received_time_us": t, "payload_sha256": [digest] * n})
        return pd.concat(claims.handleInputRows((0,), iter([rows]), None))["class"].tolist()

    keys = [f"k{i}" for i in range(2000)]
    assert classes(0, keys, 0, None) == ["accepted"] * 2000 and state.calls == 2
    assert classes(1, keys, 5, None) == ["duplicate"] * 2000 and classes(2, keys, 6, "x") == ["conflict"] * 2000 and state.calls == 4
    for seq in range(3, 2 * S.MOST_TABLES):
        assert classes(seq, ["old", f"n{seq}"], 500, "x") == ["accepted" if seq == 3 else "duplicate", "accepted"]
    assert len(state.items) < S.MOST_TABLES
    assert set(classes(900, keys, 999, "x")) == {"conflict"} and set(classes(901, keys, 1000, "x")) == {"accepted"}
    # Those over for less than the backlog stay when lists are merged, the others go.
    for seq in range(1000, 1000 + S.MOST_TABLES + 1):
        classes(seq, [f"m{seq}"], 6_999, "y")
    assert {k for (t,) in state.items for k in S._unpacked(t)} >= {"k0", "m1000"}
    for seq in range(2000, 2000 + S.MOST_TABLES + 1):
        classes(seq, [f"z{seq}"], 7_000, "y")
    assert "k0" not in {k for (t,) in state.items for k in S._unpacked(t)}


def test_transitions_whatever_the_files_of_a_part(spark, tmp_path):
    """Parts written by several tasks: a lane's rows lie in several files, which must not come out of order."""
    from oracle import assert_same

    from tidemark.plans.catalog import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").repartition(6, "user_id").write.parquet(f"{tmp_path}/events.parquet")
    assert_same(spark, sf, lambda s, d: QUERIES["st_issue_transitions"](s, str(tmp_path)), ORACLES["st_issue_transitions"])
