import pytest
from pyspark.sql import functions as F

from afterbell.operators import backtest as B
from afterbell.operators import scans


@pytest.fixture
def counted(spark):
    """Predictions, and how many of their rows have been made so far."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(400).select("id", (F.col("id") % 3).alias("k"), ((F.col("id") * 7 % 100) / 100).alias("p"), (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") * 3 % 11 - 5) / 100).alias("ret"))
    return rows.mapInArrow(count, rows.schema), made


def test_rows_behind_ranges_are_made_once(counted):
    df, made = counted
    assert scans.ranged(df, ["k"], ["id"]).count() == made.value == 400


def test_rows_behind_metrics_are_made_once(counted):
    df, made = counted
    assert B.classification_metrics(df, "p", "y", ["k"]).count() == 3
    assert made.value == 400


def test_rows_behind_a_backtest_are_made_once(counted):
    df, made = counted
    for part in B.research_backtest(df, "p", "y", "ret", ["k"], ["id"]).values():
        part.collect()
    assert made.value == 400


def test_costs_are_columns_of_one_scan(counted, monkeypatch):
    df, _ = counted
    seen = []
    own = B.ranged
    monkeypatch.setattr(B, "ranged", lambda rows, *more: seen.append(rows.count()) or own(rows, *more))
    got = {(r.k, r.cost_bps): r for r in B.cost_grid(df, "p", "ret", ["k"], ["id"]).collect()}
    trades = df.where("p >= 0.6 or p <= 0.4")
    assert seen == [trades.count()] and len(got) == 12
    for cost in (5.0, 100.0):
        for r in B.strategy_summary(B.strategy(df, "p", "ret", ["k"], ["id"], cost_bps=cost), ["k"]).collect():
            o = got[r.k, cost]
            assert (o.trades, round(o.mean_net, 12), round(o.max_drawdown, 12)) == (r.trades, round(r.mean_net, 12), round(r.max_drawdown, 12))
