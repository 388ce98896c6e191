import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from afterbell.operators import backtest as B
from afterbell.operators.scans import drawdown, numbered, running


def rows(spark, n=3000):
    r = random.Random(2)
    data = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 40}", i * 7919 % n, r.choice((None, r.uniform(-0.02, 0.03))), r.randint(0, 4)) for i in range(n)]
    return spark.createDataFrame(data, "k string, i long, x double, c long")


def test_scan_equals_a_window_over_each_key(spark):
    df = rows(spark)
    kinds = {"total": ("sum", F.coalesce(F.col("x"), F.lit(0.0))), "n": ("count", F.col("x")), "most": ("max", F.col("x")), "least": ("min", F.col("x")), "grown": ("product", 1 + F.coalesce(F.col("x"), F.lit(0.0)))}
    for inclusive in (True, False):
        w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        x = F.coalesce(F.col("x"), F.lit(0.0))
        want = df.select("k", "i", F.coalesce(F.sum(x).over(w), F.lit(0.0)).alias("total"), F.count("x").over(w).alias("n"), F.max("x").over(w).alias("most"), F.min("x").over(w).alias("least"), F.coalesce(F.product(1 + x).over(w), F.lit(1.0)).alias("grown"))
        got = running(df, ["k"], ["i"], kinds, inclusive)
        key = lambda o: (o.k or "", o.i)
        for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
            assert (a.k, a.i, a.n, a.most, a.least) == (b.k, b.i, b.n, b.most, b.least)
            assert abs(a.total - b.total) < 1e-9 and abs(a.grown / b.grown - 1) < 1e-9
    assert running(df.limit(0), ["k"], ["i"], kinds).count() == 0


def test_one_key_is_spread_over_tasks(spark):
    df = rows(spark).withColumn("k", F.lit("one"))
    out = drawdown(df, "x", ["k"], ["i"]).orderBy("i").collect()
    equity, peak = 1.0, 1.0
    for o in out:
        equity *= 1 + (o.x or 0.0)
        peak = max(peak, equity)
        assert abs(o.equity / equity - 1) < 1e-9 and abs(o.peak / peak - 1) < 1e-9 and abs(o.drawdown - (equity / peak - 1)) < 1e-9
    places = numbered(df, [F.desc("i")], "place")
    assert [o.place for o in places.orderBy(F.desc("i")).collect()] == list(range(1, 3001))
    assert len({p for p in places.select(F.spark_partition_id().alias("p")).toPandas().p}) > 1


def test_losses_beyond_all_turn_the_product_over(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate((0.5, -2.0, 0.1, -3.0, 0.2))], "k string, i int, net double")
    out = [o.equity for o in drawdown(df, "net", ["k"], ["i"]).orderBy("i").collect()]
    assert [round(e, 9) for e in out] == [1.5, -1.5, -1.65, 3.3, 3.96]


def test_ring_over_ranges(spark):
    out = dict(B.ring_peers(spark.createDataFrame([(f"t{i:03d}",) for i in range(200)] * 2, "ticker string")).collect())
    assert out == {f"t{i:03d}": f"t{(i + 1) % 200:03d}" for i in range(200)}


def test_permutations_of_places(spark):
    seen = set()
    for n in (1, 2, 3, 10, 97, 1000):
        for key in (1, 2, 500):
            rows = spark.range(n).select(B.permuted(F.col("id"), F.lit(key), F.lit(n)).alias("to")).collect()
            assert sorted(r.to for r in rows) == list(range(n))
            seen.add((n, tuple(r.to for r in rows)))
    assert len({s for s in seen if s[0] == 1000}) == 3


def test_null_shuffle_draws_each_return_alike(spark):
    n = 2500
    r = random.Random(9)
    preds = spark.createDataFrame([("k", i, 0.9 if i % 2 else 0.5, r.gauss(0.001 * (i % 7), 0.02)) for i in range(n)], "k string, i long, p double, ret double")
    out = B.null_shuffle(preds, "p", "ret", "i", ["k"], iterations=200).first()
    every = preds.agg(F.avg(F.expm1("ret")).alias("m"), F.stddev_pop(F.expm1("ret")).alias("s")).first()
    assert abs(out.null_mean - (every.m - 0.001)) < 4 * every.s / (n / 2 * 200) ** 0.5
    assert abs(out.null_std / (every.s * (1 / (n / 2) * (n / 2) / (n - 1)) ** 0.5) - 1) < 0.25


def test_rows_of_a_scan_are_dealt_once(spark):
    df = rows(spark).withColumn("text", F.concat(F.lit("row "), F.col("i")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # with many keys summaries are no small table
    try:
        out = running(df, ["k", "c"], ["i"], {"n": ("count", F.lit(1))})
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # without its children, each exchange: those whose rows still have the text are of whole rows
    plan = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    lines = plan.splitlines()
    whole = [x for i, x in enumerate(lines) if "Exchange hashpartitioning(" in x and "HashAggregate" not in lines[i + 1] and "Window" not in "".join(lines[i + 1 : i + 3])]
    assert "SortMergeJoin" in plan and len(whole) == 1 and "_in#" in whole[0]
    plain = df.withColumn("m", F.row_number().over(Window.partitionBy("k", "c").orderBy("i")))
    assert sorted((r.i, r.n) for r in out.collect()) == sorted((r.i, r.m) for r in plain.collect())
