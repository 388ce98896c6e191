"""Calendar, taxonomy and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.functions import calendar as C
from afterbell.functions import taxonomies as T
from afterbell.plans import base
from afterbell.plans.registry import register
from afterbell.plans.study import rounded
from afterbell.sources.shared import shared_dir
from afterbell.streaming import events as ST

_HOLIDAYS = ", ".join(f"DATE '{d}'" for y in (2023, 2024, 2025) for d in C.market_holidays(y))
_CAL = f"""c AS (SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(DATE '2023-01-01', DATE '2025-12-31', INTERVAL 1 DAY)) AS d)),
trading AS (SELECT day FROM c WHERE dayofweek(day) BETWEEN 1 AND 5 AND day NOT IN ({_HOLIDAYS}))"""


@register("au9_calendar", f"WITH {_CAL} SELECT CAST(day AS VARCHAR) AS day, day IN (SELECT day FROM trading) AS is_trading, CAST((SELECT min(t.day) FROM trading t WHERE t.day >= c.day) AS VARCHAR) AS same_or_next FROM c WHERE year(day) = 2024")
def au9_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading days by rule."""
    return C.calendar(spark, 2023, 2025).where(F.year("day") == 2024).select(F.col("day").cast("string").alias("day"), "is_trading", F.col("same_or_next").cast("string").alias("same_or_next"))


@register(
    "au9_timestamp_audit",
    f"""WITH {_CAL}, e AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS t, event_id % 3 = 0 AS accepted, event_id % 19 = 0 AS date_only, CASE WHEN event_id % 23 = 0 THEN CAST(ts AS DATE) - 1 END AS r FROM events),
    s AS (SELECT *, CASE WHEN t IS NULL THEN 'missing' WHEN date_only THEN 'ambiguous' WHEN hour(t) * 60 + minute(t) < 570 THEN 'before_open' WHEN hour(t) * 60 + minute(t) >= 960 THEN 'after_close' ELSE 'intraday' END AS session FROM e),
    n AS (SELECT c.day, min(t.day) AS nx FROM c JOIN trading t ON t.day > c.day AND t.day < c.day + 15 GROUP BY 1), m AS (SELECT c.day, min(t.day) AS sx FROM c JOIN trading t ON t.day >= c.day AND t.day < c.day + 15 GROUP BY 1),
    f AS (SELECT s.*, CASE WHEN session = 'missing' THEN NULL WHEN session = 'before_open' THEN sx ELSE nx END AS first_tradable FROM s LEFT JOIN n ON n.day = CAST(t AS DATE) LEFT JOIN m ON m.day = CAST(t AS DATE))
    SELECT event_id, session, CAST(first_tradable AS VARCHAR) AS first_tradable,
      CASE WHEN session = 'missing' THEN 'missing_timestamp' WHEN coalesce(r < first_tradable, false) THEN 'invalid_reaction_window' WHEN session IN ('intraday', 'ambiguous') THEN 'ambiguous' ELSE 'ok' END AS status,
      CASE WHEN session = 'missing' THEN 0.0 WHEN coalesce(r < first_tradable, false) THEN 0.1 WHEN session = 'ambiguous' THEN 0.2 WHEN session = 'intraday' THEN 0.4 WHEN accepted THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence FROM f""",
)
def au9_timestamp_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU-8, AU-9, AU-10: session, first tradable day, status and confidence."""
    t = F.when(F.col("event_id") % 17 != 0, F.col("ts"))
    e = base.table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, t).alias("acceptance_time"), t.alias("event_time"), (F.col("event_id") % 19 == 0).alias("date_only"), F.when(F.col("event_id") % 23 == 0, F.date_sub(F.col("ts").cast("date"), 1)).alias("reaction_start")
    )
    return C.timestamp_audit(e, C.calendar(spark, 2023, 2025)).select("event_id", "session", F.col("first_tradable").cast("string").alias("first_tradable"), "status", "confidence")


_PACK = (("metal", "steel|copper|brass", 0.9), ("plated", "plated", 0.8), ("large", "large|jumbo", 0.7))


@register(
    "pj17_taxonomy",
    "SELECT p_partkey, " + "CASE " + " ".join(f"WHEN regexp_matches(lower(p_type), '{p}') THEN '{label}'" for label, p, _ in _PACK) + " ELSE 'other' END AS label, CASE "
    + " ".join(f"WHEN regexp_matches(lower(p_type), '{p}') THEN {c}" for _, p, c in _PACK) + " ELSE 0.3 END::DOUBLE AS confidence FROM part",
)
def pj17_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-16, PJ-17, PJ-19: first label of an ordered rule table."""
    return base.table(spark, sf_dir, "part").select("p_partkey", T.first_label(F.col("p_type"), _PACK, "other").alias("x")).select("p_partkey", "x.*")


@register("st1_window_counts", "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st1_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the inventory: a stream of events in daily windows."""
    stream = ST.windowed_counts(ST.read_stream(spark, sf_dir, "events.parquet"), "1 day", late="40 days")
    out = ST.run_once(stream, "w" + uuid.uuid4().hex, "complete", f"{shared_dir(spark)}/afterbell/stream-{uuid.uuid4().hex}")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register(
    "st2_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def st2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the inventory: user sessions with a gap of 30 minutes, over the table as a batch."""
    w = base.table(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    text = F.regexp_replace(F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return w.select("user_id", text.alias("start"), "n")


@register("sc18_json_props", "SELECT event_type, count(*) AS n, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS mean_k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY 1")
def sc18_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-18: attributes out of JSON texts."""
    e = base.table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return rounded(e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.col("k").cast("double")).alias("mean_k"), F.max("k").alias("max_k")))


@register("se1_union_by_name", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def se1_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE-1, SE-2: union by name, missing columns NULL."""
    s = base.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = base.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    return s.unionByName(c, allowMissingColumns=True)


@register("se5_grouping_sets", "SELECT coalesce(o_orderstatus, 'combined') AS split, o_orderpriority, count(*) AS n, round(avg(o_totalprice) + 1e-9, 4) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority))")
def se5_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE-5, AG-25: per split and combined in one pass."""
    o = base.table(spark, sf_dir, "orders")
    g = o.groupingSets([[F.col("o_orderstatus"), F.col("o_orderpriority")], [F.col("o_orderpriority")]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    return g.select(F.coalesce("o_orderstatus", F.lit("combined")).alias("split"), "o_orderpriority", "n", F.round(F.col("mean") + 1e-9, 4).alias("mean"))
