"""Scans over ranges against plain loops: a hot key over many ranges, nulls, no keys."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, alerts, issues
from tidemark.operators.rows import running

STEP = {"sum": lambda a, x: (a or 0) + (x or 0), "max": lambda a, x: x if a is None else a if x is None else max(a, x), "last": lambda a, x: a if x is None else x}


@pytest.mark.parametrize("scan,before", [(s, b) for s in STEP for b in (False, True)])
@pytest.mark.parametrize("keys", [["k"], []])
def test_scan(spark, scan, before, keys):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 2, 2]), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(400)]
    expected, held = {}, {}
    for k, i, x in rows:
        g = k if keys else 0
        first = 0 if scan == "sum" else None
        if before:
            expected[i] = held.get(g, first)
        held[g] = STEP[scan](held.get(g, first), x)
        if not before:
            expected[i] = held[g]
    df = spark.createDataFrame(rows, "k int, i int, x bigint").repartition(5)
    out = running(df, keys, [F.col("i")], F.col("x"), "y", scan, before)
    assert out.columns == ["k", "i", "x", "y"] and {r.i: r.y for r in out.collect()} == expected
    assert running(df.where("i < 0"), keys, [F.col("i")], F.col("x"), "y", scan, before).count() == 0


def test_one_busy_lane_fills_all_tasks(spark):
    rng = random.Random(6)
    rows = [(0, i, 0, f"r{i}", rng.randint(0, 1000)) for i in range(4000)] + [(1, 0, 0, "x", 5)]
    df = spark.createDataFrame(rows, "lane_id int, batch_seq bigint, record_ordinal int, record_id string, received_time_us bigint")
    top, expected = 0, {"x": 5}
    for _, _, _, name, t in rows[:-1]:
        top = max(top, t)
        expected[name] = top
    # Small ranges would be put together; they are kept apart here, as large ones are.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = alerts.barrier(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.columns == df.columns and {r.record_id: r.received_time_us for r in out.collect()} == expected
    dealt = spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0])
    counts = [n for (n,) in dealt.where("lane_id = 0").groupBy("__part").count().select("count").collect()]
    assert len(counts) == 8 and max(counts) < 1000


def test_actions_of_one_busy_issue(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < 0.9 else "cold", rng.choice(["resolved", "ignored", "unresolved"])) for i in range(500)]
    state, revision, expected = {}, {}, {}
    for i, issue, target in rows:
        changed = int(state.get(issue, "unresolved") != target)
        state[issue], revision[issue] = target, revision.get(issue, 1) + changed
        expected[i] = (changed, revision[issue])
    got = issues.apply_actions(spark.createDataFrame(rows, "at int, issue_id string, target string"), "at").collect()
    assert {r["at"]: (r["changed"], r["revision"]) for r in got} == expected


def test_hash_trees(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def root(values):
        leaves = {}
        for v in values:
            leaves.setdefault(sha(v)[:2], []).append(v)
        return sha("\n".join(sorted(f"{k} {sha(chr(10).join(sorted(v)))}" for k, v in leaves.items()))) if values else None

    groups = {"a": [str(i) for i in range(3000)] + ["7", "7"], "b": ["ä", "", "z"], "c": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("c", None), ("b", None), (None, "x")]
    for n in (1, 6):
        random.Random(n).shuffle(rows)
        got = aggregates.tree_hashes(spark.createDataFrame(rows, "g string, v string").repartition(n), ["g"], "v", "root", 2).collect()
        assert {r.g: r.root for r in got} == {**{g: root(vs) for g, vs in groups.items()}, None: root(["x"])}
    # A value more, or another one, gives another root.
    assert len({root(groups["a"]), root(groups["a"][:-1]), root([*groups["a"][:-1], "8"])}) == 3
