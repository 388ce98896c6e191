"""The engine's notions on the driver's tables, as DataFrames and as SQL with the same rows.

bars: revenue over quantity by supplier and ship date. benchmark: the same by date. sector: the
supplier's region. events: orders, linked to the least supplier of their lines. lineitem has no row
key, so everything is aggregated to a keyed grain first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many tasks as a shuffle has: a small file is read by few tasks, however much is made of each row."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("d")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), F.sum("l_quantity").alias("volume")
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_shipdate").cast("date").alias("d")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))


def benchmark_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.orderBy("d")  # one row per calendar day
    return benchmark(spark, sf_dir).withColumn("log_ret", F.ln(F.col("price") / F.lag("price").over(w)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("ticker"))
    orders = table(spark, sf_dir, "orders")
    session = F.expr("element_at(array('before_open', 'intraday', 'after_close', 'unknown'), cast(o_orderkey % 4 as int) + 1)")
    # not broadcast: of a file below the threshold Spark would make many times its size in the driver
    return orders.join(owner.hint("merge"), orders.o_orderkey == owner.l_orderkey).select(
        F.col("o_orderkey").alias("event_id"),
        "ticker",
        F.col("o_orderdate").alias("event_time"),
        F.lower(F.trim("o_orderpriority")).alias("event_type"),
        F.col("o_orderstatus").alias("event_subtype"),
        session.alias("release_session"),
        F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("materiality"),
        F.col("o_custkey").alias("customer"),
        F.col("o_totalprice").alias("amount"),
    )


BARS = """bars AS (
  SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""
BENCH = """bench AS (
  SELECT d, price, ln(price / lag(price) OVER (ORDER BY d)) AS log_ret FROM (
    SELECT CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY 1))"""
EVENTS = """evts AS (
  SELECT o_orderkey AS event_id, w.ticker, o_orderdate AS event_time, lower(trim(o_orderpriority)) AS event_type, o_orderstatus AS event_subtype,
    ['before_open', 'intraday', 'after_close', 'unknown'][o_orderkey % 4 + 1] AS release_session,
    least(o_totalprice / 500000, 1.0) AS materiality, o_custkey AS customer, o_totalprice AS amount
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS ticker FROM lineitem GROUP BY 1) w ON o_orderkey = w.l_orderkey)"""
MARKET = """rets AS (
  SELECT ticker, d, price, volume, CASE WHEN price / lag(price) OVER w > 0 THEN ln(price / lag(price) OVER w) END AS y FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)),
pairs AS (
  SELECT r.*, b.log_ret AS x, CASE WHEN r.y IS NOT NULL AND b.log_ret IS NOT NULL THEN r.y END AS py,
    CASE WHEN r.y IS NOT NULL AND b.log_ret IS NOT NULL THEN b.log_ret END AS px FROM rets r LEFT JOIN bench b USING (d)),
market AS (
  SELECT *, row_number() OVER w - 1 AS i, count(px) OVER e AS est_n,
    CASE WHEN count(px) OVER e >= 60 THEN regr_slope(py, px) OVER e END AS beta,
    CASE WHEN count(px) OVER e >= 60 THEN regr_intercept(py, px) OVER e END AS alpha,
    CASE WHEN count(px) OVER e >= 60 THEN greatest(sqrt(greatest(regr_syy(py, px) OVER e - regr_slope(py, px) OVER e * regr_sxy(py, px) OVER e, 0.0)
      / (count(px) OVER e - 2)), 1e-9) END AS resid_vol,
    CASE WHEN count(px) OVER h1 = 1 THEN sum(py) OVER h1 END AS raw_1, CASE WHEN count(px) OVER h1 = 1 THEN sum(px) OVER h1 END AS bench_1,
    CASE WHEN count(px) OVER h3 = 3 THEN sum(py) OVER h3 END AS raw_3, CASE WHEN count(px) OVER h3 = 3 THEN sum(px) OVER h3 END AS bench_3,
    CASE WHEN count(px) OVER h10 = 10 THEN sum(py) OVER h10 END AS raw_10, CASE WHEN count(px) OVER h10 = 10 THEN sum(px) OVER h10 END AS bench_10,
    coalesce(sum(y) OVER b5, 0) AS pre_5, coalesce(sum(y) OVER b20, 0) AS pre_20, CASE WHEN count(y) OVER b20 >= 2 THEN stddev_samp(y) OVER b20 END AS pre_vol_20
  FROM pairs WINDOW w AS (PARTITION BY ticker ORDER BY d), e AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 125 PRECEDING AND 6 PRECEDING),
    h1 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN CURRENT ROW AND CURRENT ROW), h3 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
    h10 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), b5 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
    b20 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


def erf_sql(x: str) -> str:
    """The same polynomial as :func:`afterbell.functions.exprs.erf`."""
    from afterbell.functions.exprs import ERF_A, ERF_P

    t = f"(1 / (1 + {ERF_P} * abs({x})))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly} + CAST({a} AS DOUBLE)) * {t})"
    return f"(sign({x}) * (1 - {poly} * exp(-({x}) * ({x}))))"


def p_sql(z: str) -> str:
    return f"(2 * (1 - 0.5 * (1 + {erf_sql(f'(abs({z}) / sqrt(2.0))')})))"


def _horizon_sql(h: int) -> str:
    return f"""
    CASE WHEN status = 'ok' THEN raw_{h} - {h} * alpha - beta * bench_{h} END AS car_{h},
    CASE WHEN status = 'ok' THEN (raw_{h} - {h} * alpha - beta * bench_{h}) / (resid_vol * sqrt({h}.0)) END AS z_{h},
    coalesce(abs(CASE WHEN status = 'ok' THEN (raw_{h} - {h} * alpha - beta * bench_{h}) / (resid_vol * sqrt({h}.0)) END) >= 1.96, false) AS significant_{h}"""


STUDY = (
    "WITH "
    + ", ".join((BARS, BENCH, EVENTS, MARKET))
    + f""",
joined AS (
  SELECT e.*, m.d AS reaction_start, m.* EXCLUDE (ticker, d, price, volume, y, x, py, px)
  FROM (SELECT *, CAST(event_time AS DATE) + CASE WHEN release_session = 'after_close' THEN 1 ELSE 0 END AS first_day FROM evts) e
  ASOF LEFT JOIN market m ON e.ticker = m.ticker AND e.first_day <= m.d),
staged AS (
  SELECT *, CASE WHEN ticker NOT IN (SELECT ticker FROM bars) THEN 'ticker_not_found' WHEN reaction_start IS NULL THEN 'no_trading_day'
    WHEN i < 125 THEN 'not_enough_history' WHEN coalesce(est_n, 0) < 60 THEN 'not_enough_pairs' WHEN beta IS NULL THEN 'no_fit' ELSE 'ok' END AS status FROM joined),
study AS (SELECT *, {_horizon_sql(1)}, {_horizon_sql(3)}, {_horizon_sql(10)} FROM staged)
"""
)
