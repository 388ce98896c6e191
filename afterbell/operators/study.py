"""Event study: reaction day, rolling market model, abnormal returns by horizon, base rates and robustness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from afterbell.functions.exprs import direction, norm, two_sided_p
from afterbell.operators.asof import asof_forward
from afterbell.operators.quantiles import value_range, with_quantile
from afterbell.operators.scans import running
from afterbell.operators.windows import by_day, by_ticker, forward_sum, market_model, trailing_std, trailing_sum
from afterbell.sources.shared import written

HORIZONS = (1, 3, 10)


def market_rows(returns: DataFrame, benchmark: DataFrame, horizons: Sequence[int] = HORIZONS, length: int = 120, gap: int = 5, least: int = 60) -> DataFrame:
    """Everything an event needs, computed once per (ticker, d) in one sort by ticker.

    returns: ticker, d, log_ret. benchmark: d, log_ret. A horizon's sums are NULL unless all its
    rows have complete pairs.
    """
    rows = returns.select("ticker", "d", F.col("log_ret").alias("y")).join(by_day(benchmark.select("d", F.col("log_ret").alias("x"))), "d", "left")
    complete = F.col("y").isNotNull() & F.col("x").isNotNull()
    columns = {"i": F.row_number().over(by_ticker()) - 1, "pre_5": trailing_sum("y", 5), "pre_20": trailing_sum("y", 20), "pre_vol_20": trailing_std("y", 20)}
    for h in horizons:
        columns |= {f"raw_{h}": forward_sum("y", h, complete), f"bench_{h}": forward_sum("x", h, complete)}
    return market_model(rows, length=length, gap=gap, least=least).withColumns(columns)


def event_study(
    events: DataFrame, market: DataFrame, horizons: Sequence[int] = HORIZONS, length: int = 120, gap: int = 5, least: int = 60, band: float = 0.002, level: float = 1.96
) -> DataFrame:
    """Events (event_id, ticker, event_time, release_session, ...) with status and abnormal returns.

    The reaction day is the first day with a bar on or after the event's date, after it when the
    release was after the close. Skipped events are rows with a status: ``ticker_not_found``,
    ``no_trading_day``, ``not_enough_history``, ``not_enough_pairs``. For horizon h: car_h sums
    y - alpha - beta x, z_h divides by resid_vol * sqrt(h), significance is |z| >= ``level``.
    """
    carry = ["d", "i", "est_n", "alpha", "beta", "resid_vol", "pre_5", "pre_20", "pre_vol_20", *[f"{k}_{h}" for h in horizons for k in ("raw", "bench")]]
    probes = events.withColumn("_day", F.col("event_time").cast("date"))
    found = asof_forward(probes, market, ["ticker"], F.col("_day"), F.col("d"), carry, strict=F.coalesce(F.col("release_session") == "after_close", F.lit(False)), known="_known")
    status = (
        F.when(~F.col("_known"), "ticker_not_found")
        .when(F.col("d").isNull(), "no_trading_day")
        .when(F.col("i") < gap + length, "not_enough_history")
        .when(F.coalesce(F.col("est_n"), F.lit(0)) < least, "not_enough_pairs")
        .when(F.col("beta").isNull(), "no_fit")
        .otherwise("ok")
    )
    out = found.withColumn("status", status).withColumnRenamed("d", "reaction_start")
    ok = F.col("status") == "ok"
    for h in horizons:
        car = F.col(f"raw_{h}") - h * F.col("alpha") - F.col("beta") * F.col(f"bench_{h}")
        out = (
            out.withColumn(f"car_{h}", F.when(ok, car))
            .withColumn(f"z_{h}", F.col(f"car_{h}") / (F.col("resid_vol") * F.sqrt(F.lit(float(h)))))
            .withColumn(f"p_{h}", two_sided_p(F.col(f"z_{h}")))
            .withColumn(f"significant_{h}", F.coalesce(F.abs(F.col(f"z_{h}")) >= level, F.lit(False)))
            .withColumn(f"direction_{h}", direction(F.col(f"car_{h}"), band))
            .withColumn(f"index_adjusted_{h}", F.when(ok, F.col(f"raw_{h}") - F.col(f"bench_{h}")))
        )
    return out.drop("_day", "_known")


def base_rates(study: DataFrame, by: Sequence[str], horizon: int = 1, least: int = 1) -> DataFrame:
    """Rates and moments of the abnormal return by text columns (NULL: unknown), groups of at least ``least`` rows."""
    car = F.col(f"car_{horizon}")
    rows = study.where((F.col("status") == "ok") & car.isNotNull())
    # two passes read them: the study behind them is computed once
    named = written(rows.select(*[norm(F.col(c)).alias(c) for c in by], car.alias("_car"), f"significant_{horizon}", f"z_{horizon}"), "rates")
    car = F.col("_car")
    n, mean, std = F.count("*"), F.avg(car), F.stddev_samp(car)
    stderr = F.when(n > 1, std / F.sqrt(n))
    stats = (
        named.groupBy(*by)
        .agg(
            n.alias("n"),
            F.avg((car > 0).cast("double")).alias("positive_rate"),
            F.avg(F.col(f"significant_{horizon}").cast("double")).alias("significant_rate"),
            mean.alias("mean_car"),
            value_range("_car", 0.5).alias("_between"),
            std.alias("std_car"),
            stderr.alias("stderr_car"),
            F.avg(F.expm1(car)).alias("mean_simple"),
            F.avg(f"z_{horizon}").alias("mean_z"),
            F.try_divide(mean, stderr).alias("t_stat"),
        )
        .where(F.col("n") >= least)
    )
    return with_quantile(stats, named, "_car", by, 0.5, "median_car", "n", "_between")


def one_way_marginals(study: DataFrame, by: Sequence[str], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """All, and each value of each column, by horizon in one pass: group_column, group_value, horizon, n, mean, median, positive_rate."""
    kept = written(study.where(F.col("status") == "ok").select(*[norm(F.col(c)).alias(c) for c in by], *[F.col(f"car_{h}") for h in horizons]), "marginals")
    long = kept.select(*by, F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"car_{h}").alias("car")) for h in horizons])).alias("m"))
    cells = long.select("*", "m.*").where(F.col("car").isNotNull()).withColumn(
        "g", F.explode(F.array(F.struct(F.lit("all").alias("c"), F.lit("all").alias("v")), *[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in by]))
    )
    cells = cells.select(F.col("g.c").alias("group_column"), F.col("g.v").alias("group_value"), "horizon", "car")
    keys = ["group_column", "group_value", "horizon"]
    stats = cells.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("car").alias("mean_car"), value_range("car", 0.5).alias("_between"), F.avg((F.col("car") > 0).cast("double")).alias("positive_rate")
    )
    return with_quantile(stats, cells, "car", keys, 0.5, "median_car", "n", "_between")


def winsorised_mean(df: DataFrame, value: str, by: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Mean of values clipped to their group's quantiles (linear interpolation)."""
    rows = written(df.where(F.col(value).isNotNull()).select(*by, value), "winsorised")
    bounds = rows.groupBy(*by).agg(F.count("*").alias("_n"), value_range(value, low).alias("_around_low"), value_range(value, high).alias("_around_high"))
    bounds = with_quantile(bounds, rows, value, by, low, "_low", "_n", "_around_low")
    bounds = with_quantile(bounds, rows, value, by, high, "_high", "_n", "_around_high").drop("_n")
    clipped = F.least(F.greatest(F.col(value), F.col("_low")), F.col("_high"))
    return rows.join(bounds, list(by)).groupBy(*by).agg(F.count("*").alias("n"), F.avg(clipped).alias("winsorised_mean"))


def leave_one_out_range(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Least and largest mean with one row left out, in closed form from the group's sums."""
    x = F.col(value)
    n, total = F.count(x), F.sum(x)
    return df.groupBy(*by).agg(
        n.alias("n"), F.try_divide(total - F.max(x), n - 1).alias("least_mean"), F.try_divide(total - F.min(x), n - 1).alias("largest_mean")
    )


def leave_one_group_out(df: DataFrame, value: str, group: str) -> DataFrame:
    """Mean and positive rate of all rows but those of each group: totals minus the group's own."""
    per = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count("*").alias("_n"), F.sum(value).alias("_s"), F.sum((F.col(value) > 0).cast("long")).alias("_p")
    )
    total = per.agg(F.sum("_n").alias("_tn"), F.sum("_s").alias("_ts"), F.sum("_p").alias("_tp"))
    left = F.col("_tn") - F.col("_n")
    return per.join(F.broadcast(total)).select(  # one row
        F.col(group).alias("removed"), left.alias("n"), F.try_divide(F.col("_ts") - F.col("_s"), left).alias("mean_left"), F.try_divide(F.col("_tp") - F.col("_p"), left).alias("positive_rate")
    )


def top_k_exclusion(df: DataFrame, value: str, by: Sequence[str], tie: str, ks: Sequence[int] = (0, 1, 3, 5)) -> DataFrame:
    """Mean without the k largest absolute values, and their share of the absolute sum."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs(F.col(value))), tie)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w))
    total = F.sum(F.abs(F.col(value)))
    columns = []
    for k in ks:
        columns += [
            F.avg(F.when(F.col("_r") > k, F.col(value))).alias(f"mean_without_{k}"),
            F.try_divide(F.coalesce(F.sum(F.when(F.col("_r") <= k, F.abs(F.col(value)))), F.lit(0.0)), total).alias(f"share_top_{k}"),
        ]
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), *columns)


def concentration(df: DataFrame, value: str, group: str) -> DataFrame:
    """Share of each group in the absolute sum, its rank, the running top share and a warning over 50 % and 75 %."""
    per = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.sum(F.abs(F.col(value))).alias("absolute"))
    all_of_it = per.agg(F.sum("absolute").alias("_all"))
    ranked = per.join(F.broadcast(all_of_it)).withColumn("share", F.try_divide(F.col("absolute"), F.col("_all")))
    return (
        running(ranked, [], [F.desc("share"), F.col(group)], {"rank": ("count", F.lit(1)), "top_share": ("sum", F.col("share"))})
        .withColumn("rank", F.col("rank").cast("int"))
        .withColumn("warning", F.when(F.col("share") > 0.75, "dominant").when(F.col("share") > 0.5, "concentrated").otherwise("none"))
        .drop("_all")
    )


def hypothesis_table(df: DataFrame, value: str, masks: dict[str, Column], expected: dict[str, int]) -> DataFrame:
    """One row per named mask: n, mean, positive rate and the rate of values on the expected side (1 or -1)."""
    named = df.where(F.col(value).isNotNull()).select(
        value, F.explode(F.array_compact(F.array(*[F.when(m, F.struct(F.lit(k).alias("name"), F.lit(expected[k]).alias("side"))) for k, m in masks.items()]))).alias("h")
    )
    return named.groupBy(F.col("h.name").alias("hypothesis")).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean_value"),
        F.avg((F.col(value) > 0).cast("double")).alias("positive_rate"),
        F.avg((F.col(value) * F.col("h.side") > 0).cast("double")).alias("alignment_rate"),
    )


def threshold_sensitivity(df: DataFrame, by: str, value: str, thresholds: Sequence[float]) -> DataFrame:
    """n, mean and positive rate of the rows with ``by`` at or above each threshold (groups overlap)."""
    rows = df.where(F.col(value).isNotNull()).select(by, value, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return rows.where(F.col(by) >= F.col("threshold")).groupBy("threshold").agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.avg((F.col(value) > 0).cast("double")).alias("positive_rate")
    )
