"""Logistic models fitted by sums: every Newton step is an aggregation, so fits without an issuer, or up to a day, are differences and running sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from afterbell.sources.shared import written

CLASSES = (0, 1)


def score(features: Sequence[str], w: Column) -> Column:
    """Probability of the positive class; the last coefficient is the intercept."""
    z = F.get(w, F.lit(len(features)))
    for i, f in enumerate(features):
        z = z + F.col(f) * F.get(w, F.lit(i))
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def names(d: int) -> list[str]:
    """Columns of :func:`newton_sums`: by class n, sums and squares of the features, gradient and upper half of the Hessian."""
    out = []
    for c in CLASSES:
        out += [f"n{c}", *[f"s{c}_{i}" for i in range(d)], *[f"q{c}_{i}" for i in range(d)]]
        out += [*[f"g{c}_{i}" for i in range(d + 1)], *[f"h{c}_{i}_{j}" for i in range(d + 1) for j in range(i, d + 1)]]
    return out


def newton_sums(features: Sequence[str], y: str, w: Column) -> list[Column]:
    """Aggregates over rows, at their coefficients ``w``: all that a Newton step of a class-balanced, standardised, ridged fit needs."""
    p = score(features, w)
    x = [F.col(f) for f in features] + [F.lit(1.0)]
    out = []
    for c in CLASSES:
        of = lambda v, c=c: F.sum(F.when(F.col(y) == c, v).otherwise(0.0))
        out += [F.sum((F.col(y) == c).cast("long")).alias(f"n{c}")]
        out += [of(v).alias(f"s{c}_{i}") for i, v in enumerate(x[:-1])] + [of(v * v).alias(f"q{c}_{i}") for i, v in enumerate(x[:-1])]
        out += [of((p - c) * v).alias(f"g{c}_{i}") for i, v in enumerate(x)]
        out += [of(p * (1 - p) * x[i] * x[j]).alias(f"h{c}_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return out


def newton_step(sums: pd.DataFrame, w: np.ndarray, d: int, strength: float) -> np.ndarray:
    """New coefficients for each row of sums. Classes have equal weight; the ridge is on standardised features, not on the intercept."""
    k = len(sums)
    n = {c: sums[f"n{c}"].to_numpy(float) for c in CLASSES}
    total = n[0] + n[1]
    mean = np.stack([(sums[f"s0_{i}"] + sums[f"s1_{i}"]).to_numpy(float) for i in range(d)], axis=1).reshape(k, d) / np.maximum(total, 1)[:, None]
    square = np.stack([(sums[f"q0_{i}"] + sums[f"q1_{i}"]).to_numpy(float) for i in range(d)], axis=1).reshape(k, d) / np.maximum(total, 1)[:, None]
    ridge = np.zeros((k, d + 1))
    ridge[:, :d] = strength * np.maximum(square - mean**2, 0)
    gradient, hessian = ridge * w, np.zeros((k, d + 1, d + 1))
    for c in CLASSES:
        weight = total / (2 * np.maximum(n[c], 1))
        gradient += weight[:, None] * np.stack([sums[f"g{c}_{i}"].to_numpy(float) for i in range(d + 1)], axis=1)
        for i in range(d + 1):
            for j in range(i, d + 1):
                hessian[:, i, j] += weight * sums[f"h{c}_{i}_{j}"].to_numpy(float)
    for i in range(d + 1):
        hessian[:, i, i] += ridge[:, i] + 1e-9  # a feature that never varies has no curvature
        hessian[:, i + 1 :, i] = hessian[:, i, i + 1 :]
    return w - np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]


def stepped(sums: DataFrame, keys: Sequence[str], d: int, strength: float) -> DataFrame:
    """(keys, sums, ``w``) to (keys, n, positives, ``w`` after one step)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                out = pdf[list(keys)].copy()
                out["n"], out["positives"] = pdf.n0 + pdf.n1, pdf.n1
                out["w"] = list(newton_step(pdf, np.array(pdf.w.tolist()), d, strength))
                yield out

    kinds = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(run, f"{kinds}{', ' if keys else ''}n long, positives long, w array<double>")


def _array(w: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in w])


def fit(rows: DataFrame, features: Sequence[str], y: str, strength: float = 1.0, rounds: int = 12) -> list[float]:
    """Coefficients of one model over all rows: each round is one aggregation to one row, and the same step."""
    d, w = len(features), np.zeros(len(features) + 1)
    for _ in range(rounds):
        sums = rows.agg(*newton_sums(features, y, _array(w))).toPandas().fillna(0)  # one row of sums
        new = newton_step(sums, w[None, :], d, strength)[0]
        done = np.abs(new - w).max() < 1e-9
        w = new
        if done:
            break
    return w.tolist()


def imputed(df: DataFrame, features: Sequence[str], levels: dict[str, Sequence[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """Missing numbers become the mean of all rows, and each given level of a categorical column (missing: ``unknown``) a 0/1 feature; with the names of the features."""
    means = df.agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f) for f in features]).first()
    out = df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(means[f])) for f in features})
    more = {f"{c}__{i}": (F.coalesce(F.col(c).cast("string"), F.lit("unknown")) == v).cast("double") for c, values in (levels or {}).items() for i, v in enumerate(values)}
    return out.withColumns(more), [*features, *more]


def held_out_issuers(
    df: DataFrame, issuer: str, features: Sequence[str], y: str, least_train: int = 40, rounds: int = 12, exact_rounds: int = 8, heavy: float = 0.01, strength: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """Models without each issuer in turn, and how they do on it: (one row per issuer, one row per event with its held-out probability).

    The model of all rows is fitted first. Gradients and Hessians at its coefficients are summed by issuer in one pass; the fit without
    an issuer is one Newton step from there with the totals minus the issuer's own sums. Its error is of second order in the
    issuer's share, so issuers with at least ``heavy`` of all rows (there are at most 1 / heavy) are stepped on with sums over all other rows at
    their own coefficients, ``exact_rounds`` times. No issuer's rows are gathered anywhere.

    Features must not be missing (:func:`imputed`); a missing issuer is ``unknown``. Issuer rows: train_n, n, positive_rate, status (``ok``,
    ``skipped_insufficient_train_rows``, ``skipped_one_class_train``), accuracy, brier, w, share and warnings (one class in the test, dominant issuer, one issuer).
    """
    d = len(features)
    rows = df.withColumns({issuer: F.coalesce(F.col(issuer).cast("string"), F.lit("unknown")), y: F.col(y).cast("int")}).where(F.col(y).isNotNull())
    rows = written(rows, "issuer-rows")
    w = _array(fit(rows, features, y, strength, rounds))
    own = written(rows.groupBy(issuer).agg(*newton_sums(features, y, w)), "issuer-sums")
    totals = own.agg(*[F.sum(n).alias(f"_all_{n}") for n in names(d)], F.count("*").alias("_issuers"))
    rest = own.join(F.broadcast(totals))  # one row
    counts = rest.select(issuer, (F.col("n0") + F.col("n1")).alias("own_n"), F.col("n1").alias("own_positives"), (F.col("_all_n0") + F.col("_all_n1")).alias("all_n"), F.col("_all_n1").alias("all_positives"), "_issuers")
    left = rest.select(issuer, *[(F.col(f"_all_{n}") - F.col(n)).alias(n) for n in names(d)], w.alias("w"))
    models = written(stepped(left, [issuer], d, strength), "issuer-models")
    shares = models.join(counts.select(issuer, (F.col("own_n") / F.col("all_n")).alias("_share")), issuer)
    large = written(shares.where(F.col("_share") >= heavy).select(F.col(issuer).alias("_held"), "w"), "issuer-large")  # at most 1 / heavy rows
    for _ in range(exact_rounds):
        at = rows.join(F.broadcast(large)).where(F.col(issuer) != F.col("_held"))
        sums = at.groupBy("_held").agg(*newton_sums(features, y, F.col("w"))).join(F.broadcast(large), "_held")
        large = written(stepped(sums, ["_held"], d, strength).select("_held", "w"), "issuer-large")
    better = large.select(F.col("_held").alias(issuer), F.col("w").alias("_exact"))
    models = models.join(better, issuer, "left").select(issuer, "n", "positives", F.coalesce("_exact", "w").alias("w"))
    status = (
        F.when(F.col("n") < max(2, least_train), "skipped_insufficient_train_rows").when((F.col("positives") == 0) | (F.col("positives") == F.col("n")), "skipped_one_class_train").otherwise("ok")
    )
    models = models.join(counts, issuer).where("_issuers > 1").withColumn("status", status)
    scored = rows.join(models.where("status = 'ok'").select(issuer, "w"), issuer).withColumn("probability", score(features, F.col("w"))).drop("w")
    p, hit = F.col("probability"), ((F.col("probability") >= 0.5).cast("int") == F.col(y)).cast("double")
    clipped = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    metrics = scored.groupBy(issuer).agg(F.avg(hit).alias("accuracy"), F.avg((clipped - F.col(y)) ** 2).alias("brier"))
    share = F.col("own_n") / F.col("all_n")
    warning = F.concat_ws(";", F.when(F.col("own_positives").isin(0) | (F.col("own_positives") == F.col("own_n")), "one_class_test"), F.when(share > 0.5, "dominant_issuer"), F.when(F.col("_issuers") == 1, "one_issuer"))
    report = counts.join(models.select(issuer, "n", "status", "w"), issuer, "left").join(metrics, issuer, "left").select(
        issuer, F.col("n").alias("train_n"), F.col("own_n").alias("n"), (F.col("own_positives") / F.col("own_n")).alias("positive_rate"), F.coalesce("status", F.lit("not_possible")).alias("status"), "accuracy", "brier", "w", share.alias("share"), warning.alias("warnings")
    )
    return report, scored


def block_walk_forward(
    df: DataFrame, keys: Sequence[str], day: str, row_id: str, features: Sequence[str], y: str, least_train: int = 40, purge_days: int = 5, block_days: int = 64, rounds: int = 4, strength: float = 1.0
) -> DataFrame:
    """Each row's probability from the rows of its key more than ``purge_days`` before it, for keys of any size.

    Time is dealt in blocks. Each block has an anchor: the model of the rows before the block (less the purge), by ``rounds`` Newton
    steps from zero that all blocks take together, each step an aggregation by (key, block). A day's model is one more step from
    its block's anchor with the sums of all rows the day may learn from: those before the block as one, and those since by running sums over
    the block's days. So a row is scored once for each later block and never gathered by key. A block without both classes before it has a zero anchor.

    Rows without a key, day or target are left out; features must not be missing (:func:`imputed`).
    Returns keys, row_id, train_n, probability (the mean of the targets before, if there are too few rows or one class), target, status.
    """
    d = len(features)
    rows = df.select(*keys, F.col(row_id), F.col(day).cast("date").alias("_day"), *[F.col(f).cast("double").alias(f) for f in features], F.col(y).cast("int").alias("_y")).where("_day is not null and _y is not null").dropna(subset=list(keys))
    block = F.expr(f"cast(floor(unix_date(_day) / {block_days}) as int)")
    free = F.expr(f"cast(floor((unix_date(_day) + {purge_days}) / {block_days}) as int) + 1")  # the first block whose first day may learn from all that the row's day holds
    rows = written(rows.withColumns({"_block": block, "_free": free}), "walk-rows")
    blocks = written(rows.select(*keys, "_block").distinct(), "walk-blocks")
    zero = _array([0.0] * (d + 1))
    anchors = blocks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_block", zero.alias("w")))).alias("_anchors"))  # as many as a key has blocks of days
    # a row meets the later blocks of its key that hold rows
    later = F.filter(F.map_entries("_anchors"), lambda e: e["key"] >= F.col("_free"))
    for _ in range(rounds):
        at = rows.join(anchors, list(keys)).select(*keys, *features, "_y", F.explode(later).alias("e")).select(*keys, *features, "_y", F.col("e.key").alias("_block"), F.col("e.value").alias("w"))
        sums = at.groupBy(*keys, "_block").agg(*newton_sums(features, "_y", F.col("w")), F.first("w").alias("w")).where("n0 > 0 and n1 > 0")
        moved = blocks.join(stepped(sums, [*keys, "_block"], d, strength).select(*keys, "_block", "w"), [*keys, "_block"], "left")
        anchors = written(moved.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_block", F.coalesce("w", zero).alias("w")))).alias("_anchors")), "walk-anchors")
    # sums at each block's anchor: of rows before it as one, of the others by the first day that may learn from them
    own = F.filter(F.map_entries("_anchors"), lambda e: (e["key"] >= F.col("_free")) | (e["key"] * block_days + (block_days - 1) > F.expr(f"unix_date(_day) + {purge_days}")) & (e["key"] >= F.col("_block")))
    at = rows.join(anchors, list(keys)).select(*keys, *features, "_y", "_free", F.expr(f"unix_date(_day) + {purge_days} + 1").alias("_from"), F.explode(own).alias("e"))
    at = at.select(*keys, *features, "_y", F.col("e.key").alias("_block"), F.col("e.value").alias("w"), F.when(F.col("e.key") >= F.col("_free"), F.lit(-1)).otherwise(F.col("_from")).alias("_from"))
    parts = at.groupBy(*keys, "_block", "_from").agg(*newton_sums(features, "_y", F.col("w")))
    days = rows.select(*keys, "_block", F.expr("unix_date(_day)").alias("_from")).distinct()
    # a day asks for all that may be learned from on it; a block has as many days as it is long
    both = parts.withColumn("_asks", F.lit(0)).unionByName(days.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "_block").orderBy("_from").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.select(*keys, "_block", "_from", "_asks", *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(n) for n in names(d)]).where("_asks = 1")
    pairs = anchors.select(*keys, F.explode(F.map_entries("_anchors")).alias("e")).select(*keys, F.col("e.key").alias("_block"), F.col("e.value").alias("w"))
    by_day = written(stepped(summed.join(pairs, [*keys, "_block"]), [*keys, "_from"], d, strength), "walk-models")
    # the targets before each day, purged or not, for the baseline
    daily = rows.groupBy(*keys, F.expr("unix_date(_day)").alias("_from")).agg(F.count("*").alias("_c"), F.sum("_y").alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    base = daily.select(*keys, "_from", F.try_divide(F.sum("_s").over(earlier), F.sum("_c").over(earlier)).alias("_base"))
    models = by_day.join(base, [*keys, "_from"])
    out = rows.withColumn("_from", F.expr("unix_date(_day)")).join(models, [*keys, "_from"])
    enough, two = F.col("n") >= least_train, (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return out.select(
        *keys, row_id, F.col("n").alias("train_n"), F.when(enough & two, score(features, F.col("w"))).otherwise(F.col("_base")).alias("probability"), F.col("_y").cast("double").alias("target"),
        F.when(~enough, "skipped_not_enough_train").when(~two, "one_class").otherwise("ok").alias("status"),
    )
