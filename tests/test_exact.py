"""Exact averages and sums of doubles against Python's integers and fractions."""

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.operators import aggregates as A


def half_even(total, count):
    scaled, rest = divmod(abs(total) * 10**9, count)
    scaled += 2 * rest > count or (2 * rest == count and scaled % 2)
    return f"{'-' if total < 0 and scaled else ''}{scaled // 10**9}.{scaled % 10**9:09d}"


def test_averages_by_long_division(spark):
    rng = random.Random(1)
    cases = [[rng.choice([-1, 1]) * rng.randrange(10 ** rng.choice([1, 9, 10, 18, 27, 38])) for _ in range(rng.choice([1, 2, 3, 7, 16]))] for _ in range(150)]
    cases += [[10**38 - 1] * 3, [1 - 10**38] * 2, [10**9 * 3 - 1, 0, 0], [1] + [0] * 7, [-1] + [0] * 2_000, [999_999_999_999] * 2 + [999_999_999_998]]
    df = spark.createDataFrame([(g, str(v)) for g, vs in enumerate(cases) for v in vs], "g int, v string").withColumn("x", F.col("v").cast("decimal(38,0)"))
    state = df.groupBy("g").agg(F.count("x").alias("n"), *exact.limb_sums(F.col("x"), "l"))
    limbs = [F.col(f"l{i}") for i in range(exact.LIMBS)]
    out = state.select("g", exact.exact_average(F.col("n"), *limbs).alias("mean"), exact.average_order(F.col("n"), *limbs).alias("key"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.g: (r.mean, r.key) for r in out.collect()}
    assert {g: m for g, (m, _) in got.items()} == {g: half_even(sum(v), len(v)) for g, v in enumerate(cases)}
    mean = {g: Fraction(sum(v), len(v)) for g, v in enumerate(cases)}
    for a in range(0, len(cases), 3):
        for b in range(len(cases)):
            assert (got[a][1] < got[b][1]) == (mean[a] < mean[b]) and (got[a][1] == got[b][1]) == (mean[a] == mean[b])


def doubles(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.uniform(-1, 1) * 10.0 ** rng.randint(-5, 5) for _ in range(rng.randint(1, 60))]
    if kind == 1:  # all bits there are
        vs = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(rng.randint(1, 20))]
        return [v / 64 for v in vs if math.isfinite(v)]
    if kind == 2:  # what cancels
        big = [rng.uniform(-1, 1) * 2.0 ** rng.randint(-900, 900) for _ in range(10)]
        return [*big, *(-v for v in big), rng.uniform(-1, 1), 5e-324]
    if kind == 3:  # halves between two doubles
        return [1.0, 2.0**-53, rng.choice([0.0, 5e-324, -5e-324])] * rng.randint(1, 3) + [2.0**60]
    return [5e-324 * rng.randint(-5, 5) for _ in range(9)] + [0.0, -0.0]


def test_sums_of_doubles_are_rounded_once(spark):
    rng = random.Random(2)
    cases = [doubles(rng) for _ in range(200)] + [[1e308, 1e308, -1e308], [0.1] * 1000, [2.0**53, 1.0, 1.0], [-(2.0**53), -1.0, -1.0, 2.0**-1000], [0.0]]
    rows = [(g, v) for g, vs in enumerate(cases) for v in vs]
    metric = [A.Metric("s", "sum", F.col("v"))]
    expected = {g: float(sum(map(Fraction, vs))) for g, vs in enumerate(cases) if vs}
    for parts in (1, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "g int, v double").repartition(parts)
        out = A.aggregate(df, {"g": F.col("g")}, metric)
        assert {r.g: r.s for r in out.collect()} == expected
    # States of parts merge to the same.
    days = A.states(df.withColumn("day", F.pmod(F.xxhash64("v"), F.lit(5))), [F.col("day"), F.col("g")], metric)
    assert {r.g: r.s for r in A.finished(A.merged(days, ["g"], metric), ["g"], metric).collect()} == expected


def test_sums_of_doubles_without_rows_nulls_and_errors(spark):
    df = spark.createDataFrame([(1, None), (1, 2.5), (1, 0.5), (2, None)], "g int, v double")
    metrics = [A.Metric("s", "sum", F.col("v")), A.Metric("m", "avg", F.col("v")), A.Metric("n", "count")]
    assert sorted(tuple(r) for r in A.aggregate(df, {"g": F.col("g")}, metrics).collect()) == [(1, 3.0, 2, 1, 1.5, 2, 1, 3), (2, None, 0, 1, None, 0, 1, 1)]
    assert [tuple(r) for r in A.aggregate(df.where("g > 5"), {}, metrics).collect()] == [(None, 0, 0, None, 0, 0, 0)]
    for bad in ([float("nan"), 1.0], [float("inf")], [1.7e308, 1.7e308]):
        with pytest.raises(Exception, match="finite"):
            A.aggregate(spark.createDataFrame([(v,) for v in bad], "v double"), {}, metrics).collect()
