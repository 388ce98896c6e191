import datetime as dt
import random

import numpy as np
import pytest

from afterbell.operators.logistic import block_walk_forward, fit, held_out_issuers, imputed


def step(x, y, w, strength=1.0):
    """One Newton step of a class-balanced logistic model; the ridge is on standardised features."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    ridge = np.append(strength * x[:, :-1].var(axis=0), 0)
    hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w))
    return w - np.linalg.solve(hessian, x.T @ (weight * (p - y)) + ridge * w)


def fitted(x, y, rounds=25):
    w = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        w = step(x, y, w)
    return w


def probability(x, w):
    return 1 / (1 + np.exp(-np.clip(np.append(x, 1) @ w, -30, 30)))


def made(n, r, issuers=("A", "A", "A", "B", "C", "D")):
    out = []
    for i in range(n):
        x = [r.gauss(0, 1), r.gauss(3, 10)]
        y = int(r.random() < 1 / (1 + np.exp(-(1.2 * x[0] - 0.05 * x[1]))))
        out.append((r.choice(issuers), i, dt.date(2020, 1, 1) + dt.timedelta(days=i // 3), *x, y))
    return out


SCHEMA = "issuer string, i long, day date, a double, b double, y int"


def test_fit_by_sums_equals_a_fit_of_rows(spark):
    rows = made(400, random.Random(1))
    x, y = np.array([r[3:5] for r in rows]), np.array([r[5] for r in rows])
    assert np.allclose(fit(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "y"), fitted(x, y), atol=1e-6)


def test_models_without_each_issuer(spark):
    rows = made(500, random.Random(2)) + [(None, 1000, None, 0.0, 0.0, 1), ("A", 1001, None, 0.0, 0.0, None)]
    report, scored = held_out_issuers(spark.createDataFrame(rows, SCHEMA), "issuer", ["a", "b"], "y")
    got = {r.issuer: r for r in report.collect()}
    assert set(got) == {"A", "B", "C", "D", "unknown"} and got["unknown"].warnings == "one_class_test" and {r.status for r in got.values()} == {"ok"}
    known = [(r[0] or "unknown", *r[1:]) for r in rows if r[5] is not None]
    for g, r in got.items():
        rest, own = [k for k in known if k[0] != g], [k for k in known if k[0] == g]
        w = fitted(np.array([k[3:5] for k in rest]), np.array([k[5] for k in rest]))
        assert r.train_n == len(rest) and r.n == len(own)
        # large issuers are exact, small ones are a step from the model of all rows
        assert np.allclose(r.w, w, atol=1e-6 if r.share >= 0.01 else 5e-3)
        ps = [probability(k[3:5], w) for k in own]
        assert abs(r.brier - np.mean([(p - k[5]) ** 2 for p, k in zip(ps, own)])) < 2e-3
    assert scored.count() == len(known)


def test_issuer_edges(spark):
    one = spark.createDataFrame([("AAA", i, None, float(i), 0.0, i % 2) for i in range(4)], SCHEMA)
    (r,) = held_out_issuers(one, "issuer", ["a", "b"], "y", least_train=2)[0].collect()
    assert r.status == "not_possible" and "one_issuer" in r.warnings and "dominant_issuer" in r.warnings
    rows = [("AAA", 0, None, 0.1, 0.0, 1), ("AAA", 1, None, 0.2, 0.0, 1), ("BBB", 2, None, 0.3, 0.0, 1), ("CCC", 3, None, 0.4, 0.0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.status for r in held_out_issuers(df, "issuer", ["a", "b"], "y", least_train=10)[0].collect()} == {"skipped_insufficient_train_rows"}
    assert {r.issuer: r.status for r in held_out_issuers(df, "issuer", ["a", "b"], "y", least_train=2)[0].collect()}["CCC"] == "skipped_one_class_train"
    some, names = imputed(spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, None)], "a double, c string"), ["a"], {"c": ["x", "unknown"]})
    assert [tuple(o[f] for f in names) for o in some.collect()] == [(1.0, 1.0, 0.0), (2.0, 0.0, 0.0), (3.0, 0.0, 1.0)]


@pytest.mark.parametrize("purge", [0, 5])
def test_block_walk_forward_matches_a_plain_version(spark, purge):
    rows = made(600, random.Random(3), ("A", "A", "B")) + [("A", 900, dt.date(1969, 3, 1), 0.1, 0.2, 1), ("B", 901, None, 0.1, 0.2, 1)]
    out = {o.i: o for o in block_walk_forward(spark.createDataFrame(rows, SCHEMA), ["issuer"], "day", "i", ["a", "b"], "y", purge_days=purge, block_days=32, rounds=3).collect()}
    assert len(out) == len(rows) - 1
    far = 0.0
    for issuer, i, day, *x, y in rows:
        if day is None:
            continue
        train = [r for r in rows if r[0] == issuer and r[2] and (day - r[2]).days > purge]
        before = [r[5] for r in rows if r[0] == issuer and r[2] and r[2] < day]
        assert out[i].train_n == len(train) and out[i].target == y
        if len(train) < 40 or len({r[5] for r in train}) < 2:
            assert out[i].status != "ok" and (out[i].probability is None if not before else abs(out[i].probability - np.mean(before)) < 1e-9)
            continue
        ordinal = (day - dt.date(1970, 1, 1)).days
        first = dt.date(1970, 1, 1) + dt.timedelta(days=ordinal // 32 * 32)
        anchor, w = [r for r in train if (first - r[2]).days > purge], np.zeros(3)
        if len({r[5] for r in anchor}) == 2:
            for _ in range(3):
                w = step(np.array([r[3:5] for r in anchor]), np.array([r[5] for r in anchor]), w)
        xs, ys = np.array([r[3:5] for r in train]), np.array([r[5] for r in train])
        assert out[i].status == "ok" and abs(out[i].probability - probability(x, step(xs, ys, w))) < 1e-7
        far = max(far, abs(out[i].probability - probability(x, fitted(xs, ys))) if len(anchor) > 60 else 0)
    assert far < 0.02  # from a fit of all training rows to the end
