import datetime as dt
import random
import statistics

from afterbell.operators import expectations as X

START = dt.datetime(2024, 1, 1)


def test_series_of_a_ticker_are_looked_up_without_being_shuffled(spark):
    draw = random.Random(2)
    events = [(i, draw.choice("ab"), START + dt.timedelta(days=draw.randrange(500))) for i in range(30)]
    made = [(draw.choice("abc"), START + dt.timedelta(days=draw.randrange(500), seconds=k), draw.choice("xyz"), draw.choice(["eps", "sales"]), draw.choice([None, *map(float, range(9))])) for k in range(150)]
    e = spark.createDataFrame(events, "event_id long, ticker string, event_time timestamp")
    f = spark.createDataFrame(made, "ticker string, estimate_time timestamp, analyst_id string, metric string, estimate_value double")
    out = X.revisions(e, f, [7, 30], age_days=100)
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().toString()
    got = {(r.event_id, r.metric, r.window_days): r for r in out.collect()}
    want = {}
    for i, ticker, t in events:
        for metric in ("eps", "sales"):
            for w in (7, 30):
                pairs = []
                for a in "xyz":
                    own = sorted((at, v) for k, at, b, m, v in made if (k, b, m) == (ticker, a, metric) and at <= t)
                    if own and (t - own[-1][0]).total_seconds() <= 100 * 86400:
                        old = [o for o in own if o[0] <= t - dt.timedelta(days=w)]
                        then = old[-1][1] if old and (t - old[-1][0]).total_seconds() <= 100 * 86400 else None
                        pairs.append((own[-1][1], then))
                if pairs:
                    want[i, metric, w] = pairs
    assert set(got) == set(want)
    for key, pairs in want.items():
        r, moves = got[key], [a - b for a, b in pairs if a is not None and b is not None]
        now = [a for a, _ in pairs if a is not None]
        assert (r.analysts, r.matched, r.revised) == (len(pairs), sum(b is not None for _, b in pairs), sum(m != 0 for m in moves))
        assert r.consensus == (sum(now) / len(now) if now else None)
        assert r.median_revision == (statistics.median(moves) if moves else None)
        assert r.pct_up == (sum(m > 0 for m in moves) / len(moves) if moves else None)
        assert (r.dispersion is None) == (len(pairs) > 1 and len(now) < 2)
