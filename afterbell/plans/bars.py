"""Queries over bars: returns, trailing features, liquidity, clusters. A nudge of 1e-9 keeps exact halves from being rounded either way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from afterbell.functions.exprs import labels_above
from afterbell.operators import windows as W
from afterbell.operators.asof import asof_backward, asof_forward
from afterbell.plans import base
from afterbell.plans.registry import register
from afterbell.sources.prices import first_price_per_day


def _sql(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


@register(
    "sc5_dense_log_returns",
    _sql(base.BARS)
    + """, cal AS (SELECT DISTINCT d FROM bars), t AS (SELECT DISTINCT ticker FROM bars), g AS (SELECT t.ticker, cal.d, b.price FROM t CROSS JOIN cal LEFT JOIN bars b ON b.ticker = t.ticker AND b.d = cal.d),
    r AS (SELECT ticker, d, price, ln(price / lag(price) OVER (PARTITION BY ticker ORDER BY d)) AS log_ret FROM g)
    SELECT ticker, CAST(d AS VARCHAR) AS d, round(price + 1e-9, 6) AS price, round(log_ret, 6) AS log_ret FROM r WHERE log_ret IS NOT NULL""",
)
def sc5_dense_log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-5, SC-6: log returns on the union calendar (a gap breaks the return)."""
    b = base.bars(spark, sf_dir)
    out = W.dense_returns(b, b.select("d").distinct())
    return out.where("log_ret is not null").select("ticker", F.col("d").cast("string").alias("d"), F.round(F.col("price") + 1e-9, 6).alias("price"), F.round("log_ret", 6).alias("log_ret"))


_F = ["ret_5", "ret_20", "ret_60", "adj_5", "adj_20", "adj_60", "vol_20", "beta_60", "idio_vol_60", "volume_z", "runup_z", "expected_move_3"]


@register(
    "wn4_price_features",
    _sql(base.BARS, base.BENCH)
    + """, r AS (SELECT ticker, d, volume, ln(price / lag(price) OVER (PARTITION BY ticker ORDER BY d)) AS y FROM bars),
    p AS (SELECT r.*, b.log_ret AS x, CASE WHEN y IS NOT NULL AND b.log_ret IS NOT NULL THEN y END AS py, CASE WHEN y IS NOT NULL AND b.log_ret IS NOT NULL THEN b.log_ret END AS px FROM r LEFT JOIN bench b USING (d)),
    f AS (SELECT ticker, d, """
    + ", ".join(
        f"exp(CASE WHEN count(y) OVER w{n} = {n} THEN sum(y) OVER w{n} END) - 1 AS ret_{n}, "
        f"exp(CASE WHEN count(y) OVER w{n} = {n} THEN sum(y) OVER w{n} END - CASE WHEN count(x) OVER w{n} = {n} THEN sum(x) OVER w{n} END) - 1 AS adj_{n}"
        for n in (5, 20, 60)
    )
    + """, CASE WHEN count(y) OVER w20 >= 20 THEN stddev_samp(y) OVER w20 END AS vol_20,
      CASE WHEN count(px) OVER w60 >= 20 THEN regr_slope(py, px) OVER w60 END AS beta_60,
      CASE WHEN count(px) OVER w60 >= 20 THEN sqrt(greatest(regr_syy(py, px) OVER w60 - regr_slope(py, px) OVER w60 * regr_sxy(py, px) OVER w60, 0.0) / (count(px) OVER w60 - 2)) END AS idio_vol_60,
      CASE WHEN count(volume) OVER b20 = 20 AND stddev_samp(volume) OVER b20 > 0 THEN (volume - avg(volume) OVER b20) / stddev_samp(volume) OVER b20 END AS volume_z
      FROM p WINDOW """
    + ", ".join(f"w{n} AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 20, 60))
    + """, b20 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT ticker, CAST(d AS VARCHAR) AS d, """
    + ", ".join(f"round(ln(1 + {c}), 5) AS {c}" for c in _F[:6])
    + ", "
    + ", ".join(f"round({c}, 5) AS {c}" for c in _F[6:10])
    + ", round(ln(1 + abs(adj_20 / nullif(vol_20 * sqrt(20.0), 0))), 5) AS runup_z, round(vol_20 * sqrt(3.0), 5) AS expected_move_3 FROM f",
)
def wn4_price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-4: features known at the close of each bar; the returns as logs, as the driver's prices make simple ones very large."""
    f = W.price_features(base.bars(spark, sf_dir), base.benchmark_returns(spark, sf_dir))
    return f.select("ticker", F.col("d").cast("string").alias("d"), *[F.round(F.log1p(c), 5).alias(c) for c in _F[:6]], *[F.round(F.log1p(F.abs(F.col(c))) if c == "runup_z" else F.col(c), 5).alias(c) for c in _F[6:]])


_A = ["trail_20", "trail_60", "volatility_20", "from_high", "dollar_volume_20", "dollar_volume_full_20", "share_volume_21", "window_log_3"]


@register(
    "wn5_anchor_features",
    _sql(base.BARS)
    + """, p AS (SELECT *, price / lag(price) OVER (PARTITION BY ticker ORDER BY d) - 1 AS pct FROM bars),
    f AS (SELECT ticker, d, price / lag(price, 20) OVER w - 1 AS trail_20, price / lag(price, 60) OVER w - 1 AS trail_60, stddev_samp(pct) OVER w20 AS volatility_20,
      price / max(price) OVER w253 - 1 AS from_high, avg(price * volume) OVER w20 AS dollar_volume_20, CASE WHEN count(price) OVER w20 = 20 THEN avg(price * volume) OVER w20 END AS dollar_volume_full_20,
      avg(volume) OVER w21 AS share_volume_21, ln(lead(price, 2) OVER w / lag(price) OVER w) AS window_log_3 FROM p
      WINDOW w AS (PARTITION BY ticker ORDER BY d), w20 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
      w21 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), w253 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 252 PRECEDING AND CURRENT ROW))
    SELECT ticker, CAST(d AS VARCHAR) AS d, """
    + ", ".join(f"round({c} + 1e-9, 4) AS {c}" for c in _A)
    + " FROM f",
)
def wn5_anchor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-5 to WN-8, WN-10, WN-22: trailing return, volatility, distance from the high, volumes, window return."""
    return W.anchor_features(base.bars(spark, sf_dir)).select("ticker", F.col("d").cast("string").alias("d"), *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in _A])


@register(
    "wn9_covariance_beta",
    _sql(base.BARS, base.BENCH)
    + """, r AS (SELECT ticker, d, ln(price / lag(price) OVER (PARTITION BY ticker ORDER BY d)) AS y FROM bars),
    p AS (SELECT r.ticker, r.d, CASE WHEN log_ret IS NOT NULL THEN y END AS py, CASE WHEN y IS NOT NULL THEN log_ret END AS px FROM r LEFT JOIN bench USING (d))
    SELECT ticker, CAST(d AS VARCHAR) AS d, round(CASE WHEN count(CASE WHEN py IS NOT NULL THEN px END) OVER w >= 50 THEN covar_samp(py, px) OVER w / nullif(var_samp(px) OVER w, 0) END, 5) AS beta
    FROM p WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)""",
)
def wn9_covariance_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-9: trailing covariance beta."""
    rows = W.sparse_returns(base.bars(spark, sf_dir)).join(base.benchmark_returns(spark, sf_dir).select("d", F.col("log_ret").alias("x")), "d", "left")
    return rows.select("ticker", F.col("d").cast("string").alias("d"), F.round(W.covariance_beta(rows, "log_ret", "x"), 5).alias("beta"))


@register(
    "wn11_liquidity_audit",
    _sql(base.BARS)
    + """, f AS (SELECT ticker, d, avg(price * volume) OVER w AS a, median(price * volume) OVER w AS m, price / lag(price) OVER (PARTITION BY ticker ORDER BY d) - 1 AS gap
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, list_filter([CASE WHEN a IS NULL THEN 'no_history' END, CASE WHEN m < 40000 THEN 'thin' END, CASE WHEN abs(gap) > 0.2 THEN 'large_gap' END], lambda x: x IS NOT NULL) AS fl FROM f)
    SELECT ticker, CAST(d AS VARCHAR) AS d, round(a + 1e-9, 4) AS avg_dollar_volume, round(m + 1e-9, 4) AS median_dollar_volume, round(gap, 6) AS gap, coalesce(array_to_string(fl, ';'), '') AS flags,
      CASE WHEN len(fl) >= 2 THEN 'high' WHEN len(fl) = 1 THEN 'medium' ELSE 'low' END AS risk FROM g""",
)
def wn11_liquidity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.liquidity_audit(base.bars(spark, sf_dir), 40000.0)
    return out.select(
        "ticker", F.col("d").cast("string").alias("d"), F.round(F.col("avg_dollar_volume") + 1e-9, 4).alias("avg_dollar_volume"),
        F.round(F.col("median_dollar_volume") + 1e-9, 4).alias("median_dollar_volume"), F.round("gap", 6).alias("gap"), "flags", "risk",
    )


@register(
    "wn21_interval_cluster",
    _sql(base.EVENTS)
    + """, p AS (SELECT event_id, ticker, customer, CAST(event_time AS DATE) AS d, event_subtype <> 'P' AS is_primary FROM evts),
    c AS (SELECT a.event_id, a.ticker, a.is_primary, count(DISTINCT b.customer) FILTER (WHERE b.d BETWEEN a.d - 10 AND a.d) AS owners_10, count(DISTINCT b.customer) FILTER (WHERE b.d BETWEEN a.d - 5 AND a.d) AS owners_5,
      count(*) FILTER (WHERE b.d BETWEEN a.d - 183 AND a.d - 1) AS prior_183 FROM p a LEFT JOIN p b ON b.ticker = a.ticker AND b.is_primary AND b.d BETWEEN a.d - 183 AND a.d GROUP BY ALL)
    SELECT event_id, owners_5, owners_10, prior_183, is_primary AND owners_10 >= 2 AS cluster FROM c""",
)
def wn21_interval_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-21: distinct owners among primary rows of the ticker in trailing calendar intervals, and the cluster flag."""
    e = base.events(spark, sf_dir).withColumn("d", F.col("event_time").cast("date")).withColumn("is_primary", F.col("event_subtype") != "P")
    prior = Window.partitionBy("ticker").orderBy(F.unix_date("d")).rangeBetween(-183, -1)
    out = (
        e.withColumn("owners_5", W.interval_distinct(e, "ticker", "d", "customer", 5, F.col("is_primary")))
        .withColumn("owners_10", W.interval_distinct(e, "ticker", "d", "customer", 10, F.col("is_primary")))
        .withColumn("prior_183", F.count(F.when(F.col("is_primary"), 1)).over(prior))
    )
    return out.select("event_id", "owners_5", "owners_10", "prior_183", (F.col("is_primary") & (F.col("owners_10") >= 2)).alias("cluster"))


@register(
    "jn1_forward_asof",
    _sql(base.BARS, base.EVENTS)
    + """SELECT event_id, CAST(b.d AS VARCHAR) AS first_day, CAST(s.d AS VARCHAR) AS day_after FROM (SELECT *, CAST(event_time AS DATE) AS day FROM evts) e
    ASOF LEFT JOIN bars b ON e.ticker = b.ticker AND e.day <= b.d ASOF LEFT JOIN bars s ON e.ticker = s.ticker AND e.day < s.d""",
)
def jn1_forward_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-1: first bar on or after the event's day, and first bar after it."""
    e = base.events(spark, sf_dir).withColumn("day", F.col("event_time").cast("date")).select("event_id", "ticker", "day")
    b = base.bars(spark, sf_dir).select("ticker", F.col("d").alias("first_day"))
    one = asof_forward(e, b, ["ticker"], F.col("day"), F.col("first_day"), ["first_day"])
    two = asof_forward(one, b.withColumnRenamed("first_day", "day_after"), ["ticker"], F.col("day"), F.col("day_after"), ["day_after"], strict=True)
    return two.select("event_id", F.col("first_day").cast("string").alias("first_day"), F.col("day_after").cast("string").alias("day_after"))


@register(
    "jn2_price_anchor",
    _sql(base.BARS, base.EVENTS)
    + """SELECT event_id, CAST(b.d AS VARCHAR) AS anchor_day, round(b.price + 1e-9, 6) AS anchor_price
    FROM (SELECT *, CAST(event_time AS DATE) - CASE WHEN release_session = 'before_open' THEN 1 ELSE 0 END AS day FROM evts) e ASOF LEFT JOIN bars b ON e.ticker = b.ticker AND e.day >= b.d""",
)
def jn2_price_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-2: last bar on or before the event's day, before it when the release was before the open."""
    e = base.events(spark, sf_dir).withColumn("day", F.col("event_time").cast("date")).select("event_id", "ticker", "day", "release_session")
    b = base.bars(spark, sf_dir).select("ticker", F.col("d").alias("anchor_day"), F.col("price").alias("anchor_price"))
    out = asof_backward(e, b, ["ticker"], F.col("day"), F.col("anchor_day"), ["anchor_day", "anchor_price"], strict=F.col("release_session") == "before_open")
    return out.select("event_id", F.col("anchor_day").cast("string").alias("anchor_day"), F.round(F.col("anchor_price") + 1e-9, 6).alias("anchor_price"))


@register(
    "pj9_runup_bucket",
    _sql(base.BARS)
    + """, f AS (SELECT ticker, d, price / lag(price, 20) OVER (PARTITION BY ticker ORDER BY d) - 1 AS r FROM bars)
    SELECT CASE WHEN r IS NULL THEN 'unknown' WHEN r >= 1.0 THEN 'extreme_up' WHEN r >= 0.35 THEN 'up' WHEN r >= -0.35 THEN 'flat' WHEN r >= -1.0 THEN 'down' ELSE 'extreme_down' END AS bucket, count(*) AS n FROM f GROUP BY 1""",
)
def pj9_runup_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-9, PJ-10: labelled cuts of a trailing return."""
    r = W.trailing_return("price", 20)
    cuts = ((1.0, "extreme_up"), (0.35, "up"), (-0.35, "flat"), (-1.0, "down"))
    return base.bars(spark, sf_dir).select(labels_above(r, cuts, "extreme_down").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@register(
    "sc3_price_normalisation",
    """WITH r AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS price,
      row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem WHERE l_extendedprice IS NOT NULL)
    SELECT ticker, CAST(d AS VARCHAR) AS d, round(price + 1e-9, 6) AS price FROM r WHERE k = 1""",
)
def sc3_price_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-3, SE-3: one price per ticker and day, the first in order wins."""
    rows = base.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("d"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("place"),
    )
    return first_price_per_day(rows, "place").select("ticker", F.col("d").cast("string").alias("d"), F.round(F.col("price") + 1e-9, 6).alias("price"))
