import os

import pytest
from oracle import DATA
from pyspark.sql import Window
from pyspark.sql import functions as F

from afterbell.operators import backtest as B
from afterbell.operators.asof import asof_backward, asof_forward
from afterbell.plans import base, registry
from afterbell.plans.study import study_frame


def broadcast(df):
    """What the plan broadcasts: the nodes under each exchange, down to the first aggregate."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            last = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            first = next((j + 1 for j in range(i + 1, last) if "Aggregate(" in lines[j]), last)
            yield "\n".join(lines[i:first])


def plain(place, key, n):
    a = max(int(n**0.5), 1)
    b = -(-n // a)
    mix = lambda x, turn: ((t := (x * B.TIMES + key * B.BY_KEY + turn * B.BY_ROUND + 1) % B.PRIME) * t + x) % B.PRIME
    while True:
        low, high = divmod(place, b)
        for turn in range(1, B.ROUNDS + 1):
            if turn % 2:
                low = (low + mix(high, turn)) % a
            else:
                high = (high + mix(low, turn)) % b
        place = low * b + high
        if place < n:
            return place


def test_permutation_is_worked_out_for_batches(spark):
    for n in (1, 2, 7, 1000, 5001):
        df = spark.range(min(n, 400)).select("id", B.permuted(F.col("id"), F.lit(3), F.lit(n)).alias("to"))
        assert "ArrowEvalPython" in df._jdf.queryExecution().toString()
        assert all(r.to == plain(r.id, 3, n) for r in df.collect())


def test_rows_of_iterations_are_not_broadcast(spark):
    id_ = F.col("id")
    df = spark.range(300).select("id", (id_ % 2).alias("k"), ((id_ * 7 % 100) / 100).alias("p"), ((id_ * 3 % 11 - 5) / 100).alias("ret"))
    out = B.null_shuffle(df, "p", "ret", "id", ["k"], iterations=500)
    assert not [x for x in broadcast(out) if "_k#" in x]
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.k: r.n for r in out.collect()} == {0: 150, 1: 150}


def test_draws_are_dealt_to_many_tasks(spark):
    df = spark.range(400).select("id", F.lit(0).alias("k"), F.lit(0.9).alias("p"), (F.col("id") / 1e4).alias("ret"))
    plan = B.null_shuffle(df, "p", "ret", "id", ["k"], iterations=50)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "Generate explode" in x)  # one key, and what stands right under its draws
    below = next(x for x in plan[at + 1 :] if not x.lstrip(" :+-").startswith("Project"))
    assert "Exchange hashpartitioning(k#" in below and "_r#" in below


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_events_are_not_broadcast(spark):
    assert not [*broadcast(base.events(spark, DATA))]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["ml5_null_shuffle", "ml8_signal_gates"])
def test_queries_of_shuffled_returns_broadcast_no_trades(spark, name):
    assert not [x for x in broadcast(registry.queries()[name](spark, DATA)) if "_k#" in x]


def test_facts_out_of_a_window_are_not_shuffled_for_an_asof(spark):
    data = [("hot" if i % 2 else f"k{i % 7}" if i % 5 else None, i * 3 % 101, None if i % 4 == 0 else i) for i in range(300)]
    bars = spark.createDataFrame(sorted({x[:2]: x for x in data}.values(), key=str), "k string, d int, v int")
    facts = bars.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("d")))
    asked = [(i // 2, "hot" if i % 3 else f"k{i % 9}" if i % 5 else None, None if i % 11 == 0 else i * 5 % 120, i % 4 == 0) for i in range(120)]  # ids come twice, some without key, time or facts
    probes = spark.createDataFrame(asked, "id int, k string, t int, s boolean")
    by_key = {}
    for r in facts.collect():
        by_key.setdefault(r.k, []).append(r)
    for asof, first, ok in ((asof_forward, min, lambda d, t, s: d > t or d == t and not s), (asof_backward, max, lambda d, t, s: d < t or d == t and not s)):
        out = asof(probes, facts, ["k"], F.col("t"), F.col("d"), ["d", "v", "w"], strict=F.col("s"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(k#") == 2 and "Exchange" not in plan[: plan.index("Union")]  # bars for their window, and probes
        want = []
        for id_, k, t, s in asked:
            near = first((r for r in by_key.get(k, []) if t is not None and ok(r.d, t, s)), key=lambda r: r.d, default=None)
            want.append((id_, k, t, s, *((near.d, near.v, near.w) if near else (None, None, None))))
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
        assert "row_number" not in out.select("id", "v")._jdf.queryExecution().executedPlan().toString()  # what nobody reads is neither made nor sorted


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_market_rows_stay_with_their_ticker(spark):
    plan = study_frame(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Union")]
