"""Compares a registered query with its DuckDB SQL over the driver tables."""

from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, Decimal):
        return float(v)
    return bytes(v) if isinstance(v, bytearray) else v


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = connect(sf_dir).sql(sql)
    names = list(r.columns)
    assert sorted(names) == cols
    expected = Counter(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert got == expected, (list((got - expected).items())[:3], list((expected - got).items())[:3])
