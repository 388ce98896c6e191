"""Comparison of a query's rows with those of its SQL in DuckDB."""

import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return float(v) if hasattr(v, "as_tuple") else v


def compare(spark, build, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = build(spark, DATA)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    out = con.sql(sql)
    assert sorted(out.columns) == names
    order = [out.columns.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in order) for r in out.fetchall())
    assert got - want == Counter() and want - got == Counter()
    return sum(got.values())
