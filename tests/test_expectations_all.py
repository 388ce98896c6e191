import os

import pytest
from oracle import DATA, plain
from pyspark.sql import functions as F

from afterbell.operators import expectations as X
from afterbell.plans import base, registry


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize(("every", "part"), [("jn5_all_analyst_revisions", "jn5_analyst_revisions"), ("jn4_all_implied_moves", "jn4_implied_moves")])
def test_all_events_are_answered(spark, every, part):
    out = registry.queries()[every](spark, DATA).cache()
    few = registry.queries()[part](spark, DATA)
    rows = lambda df: sorted(str([plain(v) for v in r]) for r in df.select(*few.columns).collect())
    assert rows(out) == rows(few)  # one query under two names
    assert out.where("event_id % 50 <> 0").select("event_id").distinct().count() > 0.5 * base.events(spark, DATA).count()


def test_ages_at_their_limits(spark):
    at = lambda s: F.to_timestamp(s)
    events = spark.createDataFrame([(1, "A", "2024-03-01 10:00:00"), (2, "A", "2024-03-01 10:00:00"), (3, "B", None)], "event_id long, ticker string, t string").select("event_id", "ticker", at("t").alias("event_time"))
    estimates = spark.createDataFrame(
        [("A", "2024-03-01 10:00:00", 1, "eps", 5.0), ("A", "2024-01-31 10:00:00", 1, "eps", 4.0), ("A", "2024-02-01 10:00:00", 1, "eps", 9.0), ("A", "2023-02-25 10:00:00", 2, "eps", 1.0), ("A", "2023-02-25 09:59:59", 3, "eps", 1.0), ("A", "2024-03-01 10:00:01", 1, "eps", 7.0)],
        "ticker string, t string, analyst_id int, metric string, estimate_value double",
    ).withColumn("estimate_time", at("t"))
    out = X.revisions(events, estimates).collect()
    assert sorted((r.event_id, r.analysts, r.matched, r.revised, r.mean_revision) for r in out) == [(i, 2, 2, 1, 0.5) for i in (1, 2)]
    quotes = spark.createDataFrame(
        [("A", "2024-02-16 10:00:00", "2024-03-01", 50.0), ("A", "2024-02-16 09:59:59", "2024-03-01", 51.0), ("A", "2024-02-20 10:00:00", "2024-03-02", 52.0), ("A", "2024-03-01 10:00:01", "2024-03-01", 53.0)],
        "ticker string, t string, e string, strike double",
    ).select("ticker", at("t").alias("quote_time"), F.to_date("e").alias("expiration"), "strike", F.lit(50.0).alias("underlying_price"), *[F.lit(1.0).alias(c) for c in ("call_mid", "call_bid", "call_ask", "put_mid", "put_bid", "put_ask")])
    assert sorted((r.event_id, r.days_to_expiration, r.strike, r.implied_move) for r in X.implied_moves(events, quotes).collect()) == [(i, 0, 50.0, 0.04) for i in (1, 2)]
