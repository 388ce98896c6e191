"""Queries around the event table: merges, labels, queues, templates, packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.operators import backtest as B
from afterbell.operators import expectations as X
from afterbell.operators import facts as FA
from afterbell.operators import projections as P
from afterbell.operators import review as R
from afterbell.plans import base
from afterbell.plans.evidence import FACTS, cent_facts
from afterbell.plans.registry import register
from afterbell.plans.study import rounded, study_frame
from afterbell.sources.documents import filing_items, filter_filings
from afterbell.sources.events import template
from afterbell.sources.shared import written
from afterbell.sources.sinks import packets

_E = "WITH " + base.EVENTS


@register("jn6_override_known", "SELECT c_custkey, coalesce(round(s_acctbal, 2), c_acctbal) AS balance, coalesce(s_name, c_name) AS name FROM (SELECT c_custkey, c_acctbal, c_name FROM customer) LEFT JOIN supplier ON c_custkey = s_suppkey")
def jn6_override_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-6: the right side's known values win."""
    c = base.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    s = base.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.round("s_acctbal", 2).alias("balance"), F.col("s_name").alias("name"))
    return R.override_known(c, s, "c_custkey", ["balance", "name"])


@register(
    "jn7_release_times",
    _E + """, x AS (SELECT o_orderkey AS event_id, o_orderdate + to_hours(o_orderkey % 20) AS t, CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE 'intraday' END AS s FROM orders WHERE o_orderkey % 2 = 0)
    SELECT e.event_id, CAST(coalesce(t, event_time) AS VARCHAR) AS event_time, coalesce(nullif(trim(s), ''), release_session) AS release_session, t IS NOT NULL AS release_time_exact FROM evts e LEFT JOIN x USING (event_id)""",
)
def jn7_release_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-7: exact release times replace times and sessions."""
    o = base.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    exact = o.select(F.col("o_orderkey").alias("event_id"), F.expr("o_orderdate + make_interval(0, 0, 0, 0, cast(o_orderkey % 20 as int))").alias("exact_release_time"), F.when(F.col("o_orderkey") % 6 == 0, " ").otherwise("intraday").alias("release_session"))
    out = P.merge_release_times(base.events(spark, sf_dir), exact)
    return out.select("event_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "release_session", "release_time_exact")


@register("jn11_leaks", _E + ", a AS (SELECT o_orderkey AS event_id, o_orderdate + to_days(CAST(o_orderkey % 3 - 1 AS INTEGER)) AS t FROM orders) SELECT event_id FROM a JOIN evts USING (event_id) WHERE t > event_time")
def jn11_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11: expectations from after their event."""
    a = base.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.expr("o_orderdate + make_interval(0, 0, 0, cast(o_orderkey % 3 - 1 as int))").alias("asof_time"))
    return X.leaks(a, base.events(spark, sf_dir)).select("event_id")


@register(
    "jn19_link_mentions",
    """WITH e AS (SELECT p_partkey AS event_id, p_brand AS ticker, CAST(p_size AS VARCHAR) AS amount_token, split_part(p_type, ' ', 1) AS agency, ['steel', 'promo'] AS keywords, p_type || ' ' || p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS link_text FROM part),
    k AS (SELECT event_id, contains(lower(link_text), lower(ticker)) AS a, contains(lower(link_text), amount_token) AS b, contains(lower(link_text), lower(agency)) AS c, contains(lower(link_text), 'steel') OR contains(lower(link_text), 'promo') AS d FROM e)
    SELECT event_id, concat_ws(';', CASE WHEN a THEN 'ticker' END, CASE WHEN b THEN 'amount' END, CASE WHEN c THEN 'agency' END, CASE WHEN d THEN 'keyword' END) AS mentions,
      CASE a::INT + b::INT + c::INT + d::INT WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 ELSE 0.9 END::DOUBLE AS link_confidence FROM k""",
)
def jn19_link_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-19, AU-11: what of an event its links mention."""
    p = base.table(spark, sf_dir, "part")
    e = p.select(F.col("p_partkey").alias("event_id"), F.col("p_brand").alias("ticker"), F.col("p_size").cast("string").alias("amount_token"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("agency"), F.array(F.lit("steel"), F.lit("promo")).alias("keywords"))
    links = p.select(F.col("p_partkey").alias("event_id"), F.concat_ws(" ", "p_type", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("")).alias("link_text"))
    return P.link_mentions(e, links).select("event_id", "mentions", "link_confidence")


@register(
    "jn22_dual_context",
    _E + """, ctx AS (SELECT ticker, CAST(event_time AS DATE) AS asof_date, max(CAST(round(amount) AS BIGINT)) AS cap FROM evts WHERE event_id % 5 = 0 GROUP BY 1, 2), a AS (SELECT event_id, ticker AS target, (ticker + 1) % 90 AS acquirer, CAST(event_time AS DATE) AS day FROM evts)
    SELECT event_id, t.cap AS target_cap, q.cap AS acquirer_cap, round(t.cap / nullif(q.cap, 0), 6) AS size_ratio FROM a ASOF LEFT JOIN ctx t ON a.target = t.ticker AND a.day >= t.asof_date ASOF LEFT JOIN ctx q ON a.acquirer = q.ticker AND a.day >= q.asof_date""",
)
def jn22_dual_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-22: context of both parties of a deal."""
    e = base.events(spark, sf_dir)
    context = e.where("event_id % 5 = 0").select(F.lit(None).cast("long").alias("event_id"), "ticker", F.col("event_time").cast("date").alias("asof_date"), F.round("amount").cast("long").alias("cap"))
    deals = e.select("event_id", "ticker", "event_time", ((F.col("ticker") + 1) % 90).alias("acquirer"))
    one = X.context_lookup(deals, context, ["cap"]).drop("context_match").withColumnRenamed("cap", "target_cap").withColumnsRenamed({"ticker": "target", "acquirer": "ticker"})
    two = X.context_lookup(one, context, ["cap"]).withColumnRenamed("cap", "acquirer_cap")
    return two.select("event_id", "target_cap", "acquirer_cap", F.round(F.try_divide(F.col("target_cap"), F.col("acquirer_cap")), 6).alias("size_ratio"))


@register("ag22_modal_value", "WITH c AS (SELECT l_suppkey AS ticker, l_returnflag || l_linestatus AS v, count(*) AS k FROM lineitem GROUP BY 1, 2) SELECT ticker, arg_min(v, (-k, v)) AS modal, max(k) AS modal_count, CAST(sum(k) AS BIGINT) AS n FROM c GROUP BY 1")
def ag22_modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-22, SC-21: most frequent value per ticker."""
    rows = base.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.concat("l_returnflag", "l_linestatus").alias("v"))
    return P.modal_value(rows, "ticker", "v")


@register(
    "ag23_source_groups",
    "SELECT doc_id % 100 AS event_id, count(*) AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS source_types, min(n_chars) FILTER (WHERE lang = 'en') AS first_official, count(DISTINCT sha256(text)) AS distinct_contents FROM documents GROUP BY 1",
)
def ag23_source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base.table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("event_id"), F.col("source").alias("source_type"), (F.col("lang") == "en").alias("official"), F.col("n_chars").alias("published_at"), F.sha2("text", 256).alias("content_hash"))
    return P.source_groups(d)


@register(
    "wn14_next_open_frame",
    "WITH " + base.BARS + ", " + base.EVENTS + """, r AS (SELECT ticker, d, price, lead(price, 3) OVER w AS xp, lead(d, 3) OVER w AS xd FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)),
    e AS (SELECT *, CAST(event_time AS DATE) + CASE WHEN release_session = 'before_open' THEN 0 ELSE 1 END AS day FROM evts)
    SELECT event_id, CAST(d AS VARCHAR) AS entry_day, CAST(xd AS VARCHAR) AS exit_day, round(xp / price - 1 + 1e-9, 5) AS trade_return FROM e ASOF LEFT JOIN r ON e.ticker = r.ticker AND e.day <= r.d""",
)
def wn14_next_open_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.next_open_frame(base.events(spark, sf_dir), base.bars(spark, sf_dir))
    return out.select("event_id", F.col("entry_day").cast("string").alias("entry_day"), F.col("exit_day").cast("string").alias("exit_day"), F.round(F.col("trade_return") + 1e-9, 5).alias("trade_return"))


@register(
    "sc15_filing_items",
    r"""WITH t AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date, 'Item ' || (o_orderkey % 9)::VARCHAR || '.0' || (o_custkey % 6)::VARCHAR || ' and ITEM 8.01, item 8.01' AS text FROM orders),
    i AS (SELECT *, list_sort(list_distinct(regexp_extract_all(text, '(?i)item\s+([0-9]\.[0-9]{2})', 1))) AS items FROM t)
    SELECT o_orderkey, array_to_string(items, ',') AS items FROM i WHERE filing_date >= '1996-01-01' AND filing_date <= '1998-12-31' AND list_has_any(items, ['1.05', '2.02'])""",
)
def sc15_filing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-11, SC-15: item numbers of filings, and the filings of a range and item."""
    o = base.table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Item "), (F.col("o_orderkey") % 9).cast("string"), F.lit(".0"), (F.col("o_custkey") % 6).cast("string"), F.lit(" and ITEM 8.01, item 8.01"))
    f = o.select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("filing_date"), filing_items(text).alias("items"))
    return filter_filings(f, "1996-01-01", "1998-12-31", ("1.05", "2.02")).select("o_orderkey", F.array_join("items", ",").alias("items"))


@register("sc16_last_per_ticker", _E + ", r AS (SELECT event_id, ticker, row_number() OVER (PARTITION BY ticker ORDER BY event_time DESC, event_id DESC) AS k FROM evts) SELECT event_id, ticker FROM r WHERE k <= 8")
def sc16_last_per_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-16, SO-4: the last eight events of each ticker (a top-n report)."""
    return P.last_per_key(base.events(spark, sf_dir), "ticker", [F.desc("event_time"), F.desc("event_id")], 8).select("event_id", "ticker")


@register(
    "pj8_surprise_labels",
    "WITH p AS (SELECT o_orderkey, o_totalprice / 200000 - 1 AS p FROM orders) SELECT o_orderkey, CASE WHEN abs(p) < 0.02 THEN 'expected' ELSE 'unexpected' END AS expectedness, CASE WHEN abs(p) >= 0.2 THEN 'large' WHEN abs(p) >= 0.08 THEN 'medium' WHEN abs(p) >= 0.02 THEN 'small' ELSE 'none' END AS magnitude FROM p",
)
def pj8_surprise_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "orders").select("o_orderkey", P.surprise_labels(F.col("o_totalprice") / 200000 - 1).alias("x")).select("o_orderkey", "x.*")


@register(
    "pj18_best_amount",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal WHEN c_nationkey > 0 THEN CAST(c_nationkey AS DOUBLE) END AS amount, CASE WHEN c_acctbal > 0 THEN 'balance' WHEN c_nationkey > 0 THEN 'nation' ELSE 'none' END AS source FROM customer",
)
def pj18_best_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-4, PJ-18: first usable amount by precedence."""
    c = base.table(spark, sf_dir, "customer")
    return c.select("c_custkey", P.best_amount((("balance", F.col("c_acctbal")), ("nation", F.col("c_nationkey")))).alias("x")).select("c_custkey", "x.*")


@register(
    "pj22_priority_top",
    _E + """, s AS (SELECT event_id, round(least(materiality * 0.5, 0.25) + least(CASE WHEN event_subtype = 'F' THEN 0.3 ELSE 0.0 END, 0.25) + least(amount / 1000000, 0.25), 9) AS score FROM evts)
    SELECT event_id, round(score, 6) AS score FROM s ORDER BY score DESC, event_id LIMIT 50""",
)
def pj22_priority_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-22: the fifty of highest priority (a top-n report)."""
    parts = {"size": (F.col("materiality"), 0.5), "final": ((F.col("event_subtype") == "F").cast("double"), 0.3), "amount": (F.col("amount"), 1e-6)}
    out = base.events(spark, sf_dir).select("event_id", F.round(P.priority(parts), 9).alias("score")).orderBy(F.desc("score"), "event_id").limit(50)
    return out.withColumn("score", F.round("score", 6))


@register(
    "rv1_event_queue",
    "WITH " + FACTS + ", " + base.EVENTS + """, c AS (SELECT event_id, count(*) AS fact_count, count(CASE WHEN trim(evidence_text) <> '' THEN 1 END) AS evidence_count, avg(confidence) AS mean_confidence FROM facts GROUP BY 1),
    j AS (SELECT e.event_id, coalesce(fact_count, 0) AS f, coalesce(evidence_count, 0) AS v, mean_confidence AS m FROM evts e LEFT JOIN c USING (event_id)), a AS (SELECT *, v > 0 AND f >= 3 AND coalesce(round(m, 9) >= 0.8, false) AS auto FROM j)
    SELECT event_id, CASE WHEN v = 0 THEN 'missing' WHEN v < f THEN 'partial' ELSE 'complete' END AS evidence_status, CASE WHEN auto THEN 'auto_accepted' ELSE 'needs_review' END AS review_status, CASE WHEN auto THEN 'low' WHEN v = 0 THEN 'high' ELSE 'medium' END AS review_priority FROM a""",
)
def rv1_event_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV-1: events for review, with automatic acceptance."""
    counts = FA.fact_counts(cent_facts(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 9))
    return P.event_review_queue(base.events(spark, sf_dir), counts).select("event_id", "evidence_status", "review_status", "review_priority")


@register("sk2_metric_template", _E + " SELECT event_id, ticker, m.metric, NULL::DOUBLE AS estimate_value FROM evts, (VALUES ('eps'), ('revenue'), ('margin')) m(metric)")
def sk2_metric_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK-1, SK-2, SK-3: a table to fill in, by event and metric."""
    return template(base.events(spark, sf_dir), {"estimate_value": "double"}, ["eps", "revenue", "margin"])


@register(
    "sk10_packets",
    "SELECT doc_id, CAST(to_json({'source_doc_id': doc_id, 'title': source || ' ' || doc_id::VARCHAR, 'fields': ['eps', 'revenue'], 'text': substring(text, 1, 12000)}) AS VARCHAR) AS packet FROM documents",
)
def sk10_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK-10: JSON packets for an extractor, with title and text."""
    d = base.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_doc_id"), F.concat("source", F.lit(" "), F.col("doc_id").cast("string")).alias("title"), "text")
    return packets(d, ["eps", "revenue"]).withColumnRenamed("source_doc_id", "doc_id")


@register(
    "tx6_role_facts",
    r"""WITH t AS (SELECT p_partkey, ['Revenue of ', 'Consensus EPS was ', 'Guidance: gross margin ', 'Other ', 'Previously announced revenue '][p_partkey % 5 + 1] || p_size::VARCHAR || ['.5 million', '', '%', ' billion'][p_partkey % 4 + 1] AS segment FROM part), l AS (SELECT *, lower(segment) AS s FROM t),
    m AS (SELECT *, CASE WHEN regexp_matches(s, 'revenue|sales') THEN 'revenue' WHEN regexp_matches(s, '\beps\b|per share') THEN 'eps' WHEN contains(s, 'margin') THEN 'gross_margin' END AS metric, CASE WHEN contains(s, 'consensus') THEN 'consensus' WHEN contains(s, 'guidance') THEN 'guidance' ELSE 'actual' END AS role,
      regexp_extract(segment, '([0-9]+(?:\.[0-9]+)?)', 1) AS n, CASE WHEN regexp_matches(s, 'million|billion') THEN 'usd' WHEN contains(s, '%') THEN 'fraction' ELSE 'none' END AS unit FROM l)
    SELECT p_partkey, metric || '_' || role AS fact_name, CAST(n AS DOUBLE) * CASE WHEN contains(s, 'billion') THEN 1e9 WHEN contains(s, 'million') THEN 1e6 WHEN contains(s, '%') THEN 0.01 ELSE 1 END AS value, unit,
      round(least(0.6 + CASE WHEN role <> 'actual' THEN 0.15 ELSE 0 END + CASE WHEN unit <> 'none' THEN 0.15 ELSE 0 END, 0.95), 6)::DOUBLE AS confidence FROM m WHERE metric IS NOT NULL AND n <> '' AND NOT contains(s, 'previously announced')""",
)
def tx6_role_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-6, TX-7, TX-13: facts by metric and role words."""
    p = base.table(spark, sf_dir, "part")
    words = F.expr("element_at(array('Revenue of ', 'Consensus EPS was ', 'Guidance: gross margin ', 'Other ', 'Previously announced revenue '), cast(p_partkey % 5 as int) + 1)")
    unit = F.expr("element_at(array('.5 million', '', '%', ' billion'), cast(p_partkey % 4 as int) + 1)")
    out = P.role_facts(p.select("p_partkey", F.concat(words, F.col("p_size").cast("string"), unit).alias("segment")))
    return out.select("p_partkey", "fact_name", "value", "unit", F.round("confidence", 6).alias("confidence"))


@register(
    "tx8_scalar_fields",
    r"""WITH t AS (SELECT p_partkey, 'Holds ' || (p_size / 2)::VARCHAR || '% of the outstanding stock, 1,' || lpad(p_partkey::VARCHAR, 6, '0') || ' shares; NCT' || lpad(p_partkey::VARCHAR, 8, '0') || ' p=0.0' || (p_size % 10)::VARCHAR || '1; voted ' || (p_size % 13)::VARCHAR || ' to 2' AS x FROM part), l AS (SELECT p_partkey, lower(x) AS x FROM t)
    SELECT p_partkey, round(CAST(nullif(regexp_extract(x, '([0-9]+(?:\.[0-9]+)?)\s?% of (?:the )?(?:outstanding|common|shares)', 1), '') AS DOUBLE) / 100, 6) AS ownership_pct, CAST(replace(regexp_extract(x, '([0-9][0-9,]*) shares', 1), ',', '') AS DOUBLE) AS shares_owned,
      upper(regexp_extract(x, '(nct[0-9]{8})', 1)) AS trial_id, CAST(regexp_extract(x, 'p\s?[<=]\s?(0?\.[0-9]+)', 1) AS DOUBLE) AS p_value, CAST(regexp_extract(x, 'voted ([0-9]+) to [0-9]+', 1) AS DOUBLE) AS votes_for FROM l""",
)
def tx8_scalar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-8: single values that texts state."""
    key = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("Holds "), (F.col("p_size") / 2).cast("string"), F.lit("% of the outstanding stock, 1,"), F.lpad(key, 6, "0"), F.lit(" shares; NCT"), F.lpad(key, 8, "0"), F.lit(" p=0.0"), (F.col("p_size") % 10).cast("string"), F.lit("1; voted "), (F.col("p_size") % 13).cast("string"), F.lit(" to 2")
    )
    return rounded(base.table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in P.scalar_fields(text).items()]))


@register(
    "ml1_feature_availability",
    base.STUDY + """, c AS (SELECT count(*) AS rows, count(pre_5) AS pre_5, count(pre_vol_20) AS pre_vol_20, count(beta) AS beta, count(car_10) AS car_10, 0 AS nothing FROM study), u AS (UNPIVOT c ON pre_5, pre_vol_20, beta, car_10, nothing INTO NAME feature VALUE known)
    SELECT feature, known, rows, known > 0 AND feature <> 'car_10' AS used FROM u""",
)
def ml1_feature_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-1: features with values, without those that leak."""
    s = study_frame(spark, sf_dir).withColumn("nothing", F.lit(None).cast("double"))
    return P.feature_availability(s, ["pre_5", "pre_vol_20", "beta", "car_10", "nothing"], ["car_10"])


@register(
    "ml8_control_comparison",
    base.STUDY + """, m AS (SELECT count(*) AS n, avg(car_3) AS mean FROM study WHERE status = 'ok' AND car_3 IS NOT NULL AND event_type = '1-urgent'),
    c AS (SELECT event_type AS control, count(*) AS control_n, avg(car_3) AS control_mean FROM study WHERE status = 'ok' AND car_3 IS NOT NULL AND event_type <> '1-urgent' GROUP BY 1)
    SELECT control, control_n, round(control_mean, 6) AS control_mean, n, round(mean, 6) AS mean, round(mean - control_mean, 6) AS difference, CASE WHEN n >= 20 AND control_n >= 20 AND abs(mean) > 2 * abs(control_mean) THEN 'distinct' WHEN n < 20 OR control_n < 20 THEN 'too_few' ELSE 'not_distinct' END AS verdict FROM c, m""",
)
def ml8_control_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-8, ML-10: events against controls."""
    s = written(study_frame(spark, sf_dir).where("status = 'ok'").select("event_type", "car_3"), "controls")  # both sides read it
    return rounded(P.compare_controls(s.where("event_type = '1-urgent'"), s.where("event_type <> '1-urgent'").withColumn("control", F.col("event_type")), "car_3"))


@register(
    "ml6_shifted_placebos",
    "WITH " + base.BARS + ", " + base.EVENTS + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_id) - 1 AS k FROM evts), s AS (SELECT *, CAST(event_time AS DATE) + [30, 60, 90, -30, -60, -90][k % 6 + 1]::INTEGER AS day FROM numbered),
    f AS (SELECT s.event_id, s.ticker, b.d FROM s ASOF JOIN bars b ON s.ticker = b.ticker AND s.day <= b.d)
    SELECT event_id::VARCHAR || '__placebo01' AS event_id, ticker, CAST(d AS VARCHAR) AS placebo_day FROM f WHERE NOT EXISTS (SELECT 1 FROM evts e WHERE e.ticker = f.ticker AND abs(CAST(e.event_time AS DATE) - f.d) <= 10)""",
)
def ml6_shifted_placebos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-6, shift mode: cycling shifts to the next bar, blocked days dropped."""
    return B.shifted_placebos(base.events(spark, sf_dir), base.bars(spark, sf_dir)).withColumn("placebo_day", F.col("placebo_day").cast("string"))


@register(
    "pj7_raw_sessions",
    "WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) WHEN 1 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw, ts FROM events) "
    "SELECT event_id, CASE WHEN raw = 'soon' THEN 'missing' WHEN length(raw) = 10 THEN 'ambiguous' WHEN hour(ts) * 60 + minute(ts) < 570 THEN 'before_open' WHEN hour(ts) * 60 + minute(ts) >= 960 THEN 'after_close' ELSE 'intraday' END AS session FROM r",
)
def pj7_raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-7: session of raw time texts."""
    raw = F.when(F.col("event_id") % 4 == 0, F.col("ts").cast("date").cast("string")).when(F.col("event_id") % 4 == 1, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return base.table(spark, sf_dir, "events").select("event_id", P.raw_session(raw).alias("session"))


@register("wn20_previous_quarter", "WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'FY' ELSE year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR END AS p, o_orderdate FROM orders) SELECT o_orderkey, CASE WHEN p <> 'FY' THEN year(o_orderdate - INTERVAL 3 MONTH)::VARCHAR || 'Q' || quarter(o_orderdate - INTERVAL 3 MONTH)::VARCHAR END AS before FROM p")
def wn20_previous_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base.table(spark, sf_dir, "orders")
    period = F.when(F.col("o_orderkey") % 10 == 0, "FY").otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    return o.select("o_orderkey", P.fiscal_quarter_before(period).alias("before"))
