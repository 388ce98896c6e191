"""Rolling windows over bars (ticker, d, ...), one row per ticker and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ticker(key: str = "ticker", at: str = "d"):
    return Window.partitionBy(key).orderBy(at)


def by_day(df: DataFrame) -> DataFrame:
    """One row per day (d) for a broadcast that keeps the other side dealt by ticker. A date has 3.65 million values: tens of megabytes at most."""
    return F.broadcast(df.withColumn("d", F.col("d").cast("date")).where(F.col("d").isNotNull()).dropDuplicates(["d"]))


def dense_returns(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Log returns on the union calendar: a day without a bar has no price and no return, and neither has the day after.

    calendar: one row per day (d). Columns: ticker, d, price, log_ret, i (place of the day).
    The grid is (tickers x days), the shape of the analysis itself, not of a pair join.
    """
    days = calendar.select("d", F.row_number().over(Window.orderBy("d")).alias("i"))  # one row per calendar day
    grid = bars.select("ticker").distinct().join(by_day(days))
    w = by_ticker()
    ratio = F.try_divide(F.col("price"), F.lag("price").over(w))
    return grid.join(bars.select("ticker", "d", "price"), ["ticker", "d"], "left").withColumn("log_ret", F.when(ratio > 0, F.ln(ratio)))


def sparse_returns(bars: DataFrame) -> DataFrame:
    """Log returns over the ticker's own bars."""
    ratio = F.try_divide(F.col("price"), F.lag("price").over(by_ticker()))
    return bars.withColumn("log_ret", F.when(ratio > 0, F.ln(ratio)))


def rolling_moments(rows: DataFrame, y: str, x: str, first: int, last: int, prefix: str = "_m") -> DataFrame:
    """Sums of the complete (x, y) pairs over rows [i + first, i + last], for last <= 0: {prefix}_n, _x, _y, _xx, _xy, _yy.

    Running sums are taken once and two of them subtracted, so the work per row doesn't grow with
    the window, as it would with a sliding frame.
    """
    w = by_ticker()
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    px, py = F.when(both, F.col(x)).otherwise(0.0), F.when(both, F.col(y)).otherwise(0.0)
    terms = {"n": both.cast("double"), "x": px, "y": py, "xx": px * px, "xy": px * py, "yy": py * py}
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumns({f"{prefix}_c{k}": F.sum(v).over(upto) for k, v in terms.items()})
    end = lambda c: F.coalesce(F.lag(c, -last).over(w), F.lit(0.0)) if last < 0 else F.col(c)
    sums = {f"{prefix}_{k}": end(f"{prefix}_c{k}") - F.coalesce(F.lag(f"{prefix}_c{k}", 1 - first).over(w), F.lit(0.0)) for k in terms}
    return running.withColumns(sums).drop(*[f"{prefix}_c{k}" for k in terms])


def least_squares(prefix: str = "_m") -> tuple[Column, Column, Column, Column]:
    """n, slope, intercept and sum of squared residuals from :func:`rolling_moments`; NULL for a constant x."""
    n, sx, sy, sxx, sxy, syy = (F.col(f"{prefix}_{k}") for k in ("n", "x", "y", "xx", "xy", "yy"))
    spread = sxx - F.try_divide(sx * sx, n)
    slope = F.when(spread > 1e-12 * sxx, F.try_divide(sxy - F.try_divide(sx * sy, n), spread))
    intercept = F.try_divide(sy - slope * sx, n)
    sse = syy - F.try_divide(sy * sy, n) - slope * (sxy - F.try_divide(sx * sy, n))
    return n, slope, intercept, F.greatest(sse, F.lit(0.0))


def market_model(returns: DataFrame, y: str = "y", x: str = "x", length: int = 120, gap: int = 5, least: int = 60) -> DataFrame:
    """Rolling least squares of y on x over rows [i - gap - length, i - gap): alpha, beta, resid_vol, n.

    Only complete pairs count. Residual deviation is sqrt(SSE / (n - 2)), at least 1e-9. NULL with fewer
    than ``least`` pairs or a constant x. One pass of running sums, no refit per row.
    """
    rows = rolling_moments(returns, y, x, -(gap + length), -(gap + 1))
    n, slope, intercept, sse = least_squares()
    enough = n >= least
    out = rows.withColumns(
        {
            "est_n": n.cast("long"), "alpha": F.when(enough, intercept), "beta": F.when(enough, slope),
            "resid_vol": F.when(enough & slope.isNotNull(), F.greatest(F.sqrt(sse / (n - 2)), F.lit(1e-9))),
        }
    )
    return out.drop(*[f"_m_{k}" for k in ("n", "x", "y", "xx", "xy", "yy")])


def forward_sum(c: str, length: int, complete: Column | None = None) -> Column:
    """Sum over the row and the length - 1 rows after it; NULL unless all ``length`` rows are there and complete."""
    w = by_ticker().rowsBetween(0, length - 1)
    ok = F.col(c).isNotNull() if complete is None else complete
    return F.when(F.sum(F.when(ok, 1).otherwise(0)).over(w) == length, F.sum(F.when(ok, F.col(c))).over(w))


def trailing_sum(c: str, length: int) -> Column:
    """Sum over the ``length`` rows before the row; NULLs are skipped, 0 without any."""
    return F.coalesce(F.sum(c).over(by_ticker().rowsBetween(-length, -1)), F.lit(0.0))


def trailing_std(c: str, length: int, least: int = 2) -> Column:
    w = by_ticker().rowsBetween(-length, -1)
    return F.when(F.count(c).over(w) >= least, F.stddev_samp(c).over(w))


def trailing_return(price: str, length: int) -> Column:
    """Simple return over the last ``length`` bars up to the row."""
    return F.try_divide(F.col(price), F.lag(price, length).over(by_ticker())) - 1


def price_features(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Features of the day before an event: what is known at the close of each bar.

    ret_n: simple return over the last n returns, which must all be there; adj_n: less the
    benchmark's; vol_20 (at least 20 returns); beta_60 and idio_vol_60 over complete pairs; volume_z
    against the 20 bars before; runup_z; expected_move_h.
    """
    rows = sparse_returns(bars).join(by_day(benchmark.select("d", F.col("log_ret").alias("x"))), "d", "left").withColumnRenamed("log_ret", "y")

    def last(n: int):
        return by_ticker().rowsBetween(-(n - 1), 0)

    returns = {}
    for n in (5, 20, 60):
        full = F.count("y").over(last(n)) == n
        total = F.when(full, F.sum("y").over(last(n)))
        other = F.when(F.count("x").over(last(n)) == n, F.sum("x").over(last(n)))
        returns |= {f"ret_{n}": F.expm1(total), f"adj_{n}": F.expm1(total - other)}
    rows = rows.withColumns(returns)
    rows = rolling_moments(rows, "y", "x", -59, 0)
    n, slope, _, sse = least_squares()
    enough = n >= 20
    beta = F.when(enough, slope)
    before = by_ticker().rowsBetween(-20, -1)
    spread = F.stddev_samp("volume").over(before)
    vol = F.when(F.count("y").over(last(20)) >= 20, F.stddev_samp("y").over(last(20)))
    rows = (
        rows.withColumns(
            {
                "vol_20": vol, "beta_60": beta, "idio_vol_60": F.when(enough, F.sqrt(sse / (n - 2))),
                "volume_z": F.when((F.count("volume").over(before) == 20) & (spread > 0), (F.col("volume") - F.avg("volume").over(before)) / spread),
            }
        )
    )
    runup = F.try_divide(F.col("adj_20"), F.col("vol_20") * F.sqrt(F.lit(20.0)))
    return rows.withColumn("runup_z", runup).withColumn("expected_move_3", F.col("vol_20") * F.sqrt(F.lit(3.0)))


def anchor_features(bars: DataFrame) -> DataFrame:
    """Per bar: trailing returns, volatility, distance from the 253-bar high, dollar and share volume, window return."""
    w = by_ticker()
    pct = F.try_divide(F.col("price"), F.lag("price").over(w)) - 1
    rows = bars.withColumn("pct", pct)
    full_20 = F.count("price").over(w.rowsBetween(-19, 0)) == 20
    return (
        rows.withColumn("trail_20", trailing_return("price", 20))
        .withColumn("trail_60", trailing_return("price", 60))
        .withColumn("volatility_20", F.stddev_samp("pct").over(w.rowsBetween(-19, 0)))
        .withColumn("from_high", F.col("price") / F.max("price").over(w.rowsBetween(-252, 0)) - 1)
        .withColumn("dollar_volume_20", F.avg(F.col("price") * F.col("volume")).over(w.rowsBetween(-19, 0)))
        .withColumn("dollar_volume_full_20", F.when(full_20, F.avg(F.col("price") * F.col("volume")).over(w.rowsBetween(-19, 0))))
        .withColumn("share_volume_21", F.avg("volume").over(w.rowsBetween(-20, 0)))
        .withColumn("window_log_3", F.ln(F.try_divide(F.lead("price", 2).over(w), F.lag("price").over(w))))
    )


def covariance_beta(returns: DataFrame, y: str, x: str, length: int = 120, least: int = 50) -> Column:
    """Sample covariance over variance of the complete pairs in the ``length`` rows before the row."""
    w = by_ticker().rowsBetween(-length, -1)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(F.count(px).over(w) >= least, F.try_divide(F.covar_samp(py, px).over(w), F.var_samp(px).over(w)))


def liquidity_audit(bars: DataFrame, thin: float) -> DataFrame:
    """Average and median dollar volume of the 20 bars before, gap from the last price, flags and risk."""
    w = by_ticker().rowsBetween(-20, -1)
    dollars = F.col("price") * F.col("volume")
    framed = F.array_sort(F.collect_list("_dollars").over(w))  # a frame of 20 rows
    size = F.size(framed)
    median = F.when(size > 0, (F.get(framed, ((size - 1) / 2).cast("int")) + F.get(framed, (size / 2).cast("int"))) / 2)
    rows = bars.withColumn("_dollars", dollars)
    rows = rows.withColumn("avg_dollar_volume", F.avg("_dollars").over(w)).withColumn("median_dollar_volume", median)
    rows = rows.withColumn("gap", F.try_divide(F.col("price"), F.lag("price").over(by_ticker())) - 1)
    flags = F.array_compact(
        F.array(
            F.when(F.col("avg_dollar_volume").isNull(), "no_history"),
            F.when(F.col("median_dollar_volume") < thin, "thin"),
            F.when(F.abs(F.col("gap")) > 0.2, "large_gap"),
        )
    )
    return (
        rows.withColumn("flags", F.array_join(flags, ";"))
        .withColumn("risk", F.when(F.size(flags) >= 2, "high").when(F.size(flags) == 1, "medium").otherwise("low"))
        .drop("_dollars")
    )


def interval_distinct(df: DataFrame, key: str, at: str, what: str, days: int, when: Column | None = None, include_now: bool = True) -> Column:
    """Distinct values in the ``days`` days up to the row's day (or before it)."""
    w = Window.partitionBy(key).orderBy(F.unix_date(F.col(at).cast("date"))).rangeBetween(-days, 0 if include_now else -1)
    value = F.col(what) if when is None else F.when(when, F.col(what))
    return F.size(F.collect_set(value).over(w))
