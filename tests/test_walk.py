import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from afterbell.operators import backtest as B


def made(r, n, days, keys="ab"):
    rows = pd.DataFrame({"k": r.choice(list(keys), n), "day": np.sort(r.integers(0, days, n)), "i": np.arange(n), "a": r.normal(size=n) * 0.01 + 5, "b": r.normal(size=n), "flat": 0.1, "late": r.normal(size=n)})
    rows["y"] = (rows.b + r.normal(size=n) > 0).astype(float)
    rows.loc[r.random(n) < 0.1, "a"] = None
    rows.loc[: n // 2, "late"] = None
    rows["c"] = [None if i % 7 == 0 else "new" if i > 0.8 * n else "xyz"[i % 3] for i in range(n)]
    return rows


def walk(spark, rows, **more):
    df = spark.createDataFrame(rows).withColumn("at", F.expr("timestamp'2020-01-01 09:00:00' + make_interval(0, 0, 0, cast(day as int))"))
    df = df.unionByName(df.limit(1).withColumn("at", F.lit(None).cast("timestamp")))
    return B.purged_walk_forward(df, "k", "at", "i", ["a", "b", "flat", "late"], "y", categorical=["c"], **more)


def same(got, want):
    got, want = (pd.DataFrame(map(tuple, d.collect()), columns=d.columns).sort_values("i", ignore_index=True) for d in (got, want))
    assert len(got) == len(want) and set(want.status) >= {"ok", "skipped_not_enough_train"}
    pd.testing.assert_frame_equal(got, want, check_exact=False, atol=1e-9, rtol=0)


@pytest.mark.parametrize("work", [300, 20_000_000])
def test_fits_of_many_days_are_those_of_each_day(spark, monkeypatch, work):
    rows = made(np.random.default_rng(3), 320, 150)
    one_at_a_time = lambda x, y: B.logistic(x, y)
    want = walk(spark, rows, fit=one_at_a_time)
    monkeypatch.setattr(B, "PART_WORK", work, raising=False)
    same(walk(spark, rows), want)
    same(walk(spark, rows, fit=one_at_a_time), want)


def test_tiles_change_nothing(monkeypatch):
    r = np.random.default_rng(4)
    x, y, c = r.normal(size=(150, 2)), (r.random(150) < 0.4).astype(float), np.array([["p"], ["q"]] * 75, object)
    x[r.random(x.shape) < 0.1] = np.nan
    x[:, 0] = np.where(np.arange(150) < 60, 1e-8 * x[:, 0], x[:, 0])  # a spread that sums of squares don't resolve
    sizes = np.arange(40, 149)
    ends = np.stack((sizes, sizes + 1), axis=1)
    want = []
    for m in sizes:
        prepare = B.Preparation(x[:m], c[:m])
        want.append(B.logistic(prepare(x[:m], c[:m]), y[:m])(prepare(x[m : m + 1], c[m : m + 1]))[0])
    assert np.allclose(B.walk_logistic(x, c, y, sizes, ends), want, atol=1e-9)
    monkeypatch.setattr(B, "TILE_ROWS", 7)
    monkeypatch.setattr(B, "TILE_FITS", 5)
    assert np.allclose(B.walk_logistic(x, c, y, sizes, ends), want, atol=1e-9)


def test_a_large_key_is_spread_and_quick(spark, monkeypatch):
    monkeypatch.setattr(B, "PART_WORK", 2_000_000, raising=False)
    r = np.random.default_rng(5)
    n = 6_000
    rows = pd.DataFrame({"k": "one", "day": np.arange(n), "i": np.arange(n), "b": r.normal(size=n)})
    rows["y"] = (rows.b + r.normal(size=n) > 0).astype(float)
    df = spark.createDataFrame(rows).withColumn("at", F.expr("date_add(date'2000-01-01', cast(day as int))"))
    began = time.time()
    out = B.purged_walk_forward(df, "k", "at", "i", ["b"], "y").select("i", "status", F.spark_partition_id().alias("task")).collect()
    assert len({o.i for o in out}) == len(out) == n and sum(o.status == "ok" for o in out) == n - 45
    assert len({o.task for o in out}) > 1
    assert time.time() - began < 60
