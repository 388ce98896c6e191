"""Claims, review, expectations and audits on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.functions.exprs import direction, issues, normal_cdf, right_closed_bucket, session_of
from afterbell.operators import evidence as E
from afterbell.operators import expectations as X
from afterbell.operators import review as R
from afterbell.plans import base
from afterbell.plans.evidence import MATCHES, matches
from afterbell.plans.registry import register
from afterbell.plans.study import rounded

CLAIMS = "WITH " + MATCHES + """, claims AS (SELECT 'claim_' || substr(sha256(CAST(to_json([doc_id::VARCHAR, field_name, value]) AS VARCHAR)), 1, 16) AS claim_id, doc_id AS source_doc_id, doc_id % 300 AS event_id, field_name, value, confidence,
    'span_' || substr(sha256(CAST(to_json([doc_id::VARCHAR, field_name, start_char::VARCHAR, end_char::VARCHAR]) AS VARCHAR)), 1, 16) AS evidence_span_id, evidence_text, start_char, end_char FROM kept),
over AS (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 'human_rejected' WHEN quality = 1 THEN 'human_verified' ELSE ' ' END) AS review_status FROM labels GROUP BY 1),
merged AS (SELECT c.*, CASE WHEN trim(coalesce(o.review_status, '')) = '' THEN 'unreviewed' ELSE o.review_status END AS review_status FROM claims c LEFT JOIN over o ON c.source_doc_id = o.doc_id),
evid AS (SELECT * FROM merged WHERE source_doc_id % 9 <> 0),
queue AS (SELECT m.* EXCLUDE (review_status), e.evidence_span_id IS NOT NULL AND trim(e.evidence_text) <> '' AS evidence_present,
    CASE WHEN m.review_status IN ('human_verified', 'human_rejected') THEN m.review_status WHEN e.evidence_span_id IS NULL THEN 'needs_review' WHEN m.confidence >= 0.8 THEN 'machine_high_confidence' ELSE 'needs_review' END AS review_status,
    concat_ws(';', CASE WHEN e.evidence_span_id IS NULL THEN 'missing_evidence' END, CASE WHEN m.confidence < 0.8 THEN 'low_confidence' END) AS issue_flags
  FROM merged m LEFT JOIN evid e ON m.claim_id = e.claim_id AND m.evidence_span_id = e.evidence_span_id AND m.source_doc_id = e.source_doc_id)
"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.claims_of(matches(spark, sf_dir)).withColumn("event_id", F.col("source_doc_id") % 300).withColumn("review_status", F.lit("unreviewed"))
    status = F.when(F.col("toxic") == 1, "human_rejected").when(F.col("quality") == 1, "human_verified").otherwise(" ")
    labels = base.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_doc_id"), status.alias("review_status"))
    return R.override_non_blank(c, labels, "source_doc_id", ["review_status"])


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    spans = c.where("source_doc_id % 9 <> 0").select("evidence_span_id", "source_doc_id", "claim_id", "evidence_text")
    return R.claim_queue(c, spans)


@register("jn8_review_override", CLAIMS + "SELECT claim_id, source_doc_id, field_name, review_status FROM merged")
def jn8_review_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-8: labels override a claim's status where they aren't blank."""
    return claims(spark, sf_dir).select("claim_id", "source_doc_id", "field_name", "review_status")


@register("rv2_claim_queue", CLAIMS + "SELECT claim_id, evidence_span_id, review_status, evidence_present, issue_flags FROM queue")
def rv2_claim_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV-2, JN-9, JN-10: claims with evidence and status."""
    return queue(spark, sf_dir).select("claim_id", "evidence_span_id", "review_status", "evidence_present", "issue_flags")


@register(
    "ag13_field_coverage",
    CLAIMS + """SELECT field_name, count(*) AS claims, count(DISTINCT event_id) AS events, count(*) FILTER (WHERE review_status = 'human_verified') AS verified, count(*) FILTER (WHERE review_status = 'human_rejected') AS rejected,
    count(*) FILTER (WHERE review_status = 'needs_review') AS needs_review, round(count(*) FILTER (WHERE review_status = 'human_verified') / nullif(count(*) FILTER (WHERE review_status IN ('human_verified', 'human_rejected')), 0), 6) AS yield,
    round(avg(confidence), 6) AS mean_confidence, round(count(DISTINCT event_id) / (SELECT count(DISTINCT event_id) FROM queue), 6) AS coverage FROM queue GROUP BY 1""",
)
def ag13_field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.field_coverage(queue(spark, sf_dir)))


@register("ag14_issue_counts", CLAIMS + ", v AS (SELECT trim(unnest(string_split(issue_flags, ';'))) AS value FROM queue) SELECT value, count(*) AS n FROM v WHERE value <> '' GROUP BY 1")
def ag14_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exploded_counts(queue(spark, sf_dir), "issue_flags")


@register(
    "ag15_missing_claim_recall",
    CLAIMS + """, miss AS (SELECT 'insult' AS expected_field FROM labels l WHERE toxic = 1 AND NOT EXISTS (SELECT 1 FROM queue q WHERE q.source_doc_id = l.doc_id AND q.field_name = 'insult')
      UNION ALL SELECT 'licence' FROM labels l WHERE quality = 0 AND NOT EXISTS (SELECT 1 FROM queue q WHERE q.source_doc_id = l.doc_id AND q.field_name = 'licence')),
    xc AS (SELECT field_name, count(*) AS extracted FROM queue GROUP BY 1), mc AS (SELECT expected_field AS field_name, count(*) AS missing FROM miss GROUP BY 1),
    f AS (SELECT field_name, coalesce(extracted, 0) AS extracted, coalesce(missing, 0) AS missing FROM xc FULL JOIN mc USING (field_name)),
    g AS (SELECT * FROM f UNION ALL SELECT 'all', CAST(sum(extracted) AS BIGINT), CAST(sum(missing) AS BIGINT) FROM f)
    SELECT field_name, extracted, missing, round(extracted / (extracted + missing), 6) AS recall FROM g""",
)
def ag15_missing_claim_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, labels = queue(spark, sf_dir), base.table(spark, sf_dir, "labels")

    def missing(field: str, asked: F.Column) -> DataFrame:
        have = q.where(F.col("field_name") == field).select(F.col("source_doc_id").alias("doc_id"))
        return labels.where(asked).join(have, "doc_id", "left_anti").select(F.lit(field).alias("expected_field"))

    return rounded(R.missing_claim_recall(q, missing("insult", F.col("toxic") == 1).unionAll(missing("licence", F.col("quality") == 0))))


@register(
    "ag16_quality_report",
    CLAIMS + """, o AS (SELECT count(*) AS claims, count(DISTINCT event_id) AS events, count(DISTINCT source_doc_id) AS documents, count(*) FILTER (WHERE evidence_present) AS with_evidence,
      count(*) FILTER (WHERE review_status = 'human_verified') AS verified, count(*) FILTER (WHERE review_status = 'human_rejected') AS rejected, count(*) FILTER (WHERE review_status = 'machine_high_confidence') AS machine,
      count(*) FILTER (WHERE review_status = 'needs_review') AS needs_review, round(avg(confidence), 6) AS mean_confidence FROM queue)
    SELECT *, round(needs_review / claims, 6) AS review_rate, round(verified / nullif(verified + rejected, 0), 6) AS yield, verified + machine AS reviewed,
      concat_ws(';', CASE WHEN with_evidence < claims THEN 'missing_evidence' END, CASE WHEN needs_review / claims > 0.5 THEN 'high_needs_review_rate' END, CASE WHEN (verified + machine) / claims < 0.5 THEN 'low_human_review_coverage' END) AS warnings FROM o""",
)
def ag16_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.quality_report(queue(spark, sf_dir)))


_FIELDS = ("credential_leak", "insult", "licence", "network_address", "shouting", "table_layout")


@register(
    "rv3_event_rows",
    CLAIMS + """, f AS (SELECT doc_id % 300 AS event_id, min(doc_id) AS doc_id FROM documents GROUP BY 1),
    p AS (SELECT event_id, """ + ", ".join(f"bool_or(field_name = '{x}' AND value = 'true') AS {x}" for x in _FIELDS) + """, count(*) AS claim_count, bool_and(review_status IN ('human_verified', 'machine_high_confidence')) AS ok FROM queue GROUP BY 1)
    SELECT f.event_id, f.doc_id, """ + ", ".join(f"coalesce({x}, false) AS {x}" for x in _FIELDS) + """, coalesce(claim_count, 0) AS claim_count,
      CASE WHEN claim_count IS NULL THEN 'no_claims' WHEN ok THEN 'reviewed' ELSE 'needs_review' END AS review_status FROM f LEFT JOIN p USING (event_id)""",
)
def rv3_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV-3: documents and claims to event rows."""
    docs = base.table(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("event_id"), "doc_id")
    return R.event_rows(docs, queue(spark, sf_dir), _FIELDS).select("event_id", "doc_id", *_FIELDS, "claim_count", "review_status")


@register(
    "sk5_nested_export",
    CLAIMS + """, c AS (SELECT event_id, list({'field_name': field_name, 'claim_id': claim_id, 'value': value, 'review_status': review_status, 'evidence': {'start_char': start_char, 'end_char': end_char}} ORDER BY field_name, claim_id) AS claims, count(*) AS n FROM queue GROUP BY 1)
    SELECT event_id, n AS n_claims, CAST(to_json({'event_id': event_id, 'claims': claims}) AS VARCHAR) AS json FROM c""",
)
def sk5_nested_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK-4, SK-5: events with nested claims and evidence as JSON."""
    claim = F.struct("field_name", "claim_id", "value", "review_status", F.struct("start_char", "end_char").alias("evidence"))
    per = queue(spark, sf_dir).groupBy("event_id").agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    return per.select("event_id", F.size("claims").cast("long").alias("n_claims"), F.to_json(F.struct("event_id", "claims")).alias("json"))


@register(
    "rv4_promotion",
    CLAIMS + """, c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE review_status IN ('human_verified', 'machine_high_confidence') AND evidence_present) AS eligible, count(*) FILTER (WHERE review_status = 'human_verified') AS verified,
      count(*) FILTER (WHERE evidence_present) AS evidenced FROM queue)
    SELECT *, concat_ws(';', CASE WHEN eligible < 60 THEN 'too_few_eligible' END, CASE WHEN verified < 80 THEN 'too_few_verified' END) AS failed_gates,
      CASE WHEN rows = 0 THEN 'reject_modeling' WHEN eligible = 0 THEN 'monitor_only' WHEN eligible < 60 OR verified < 80 THEN 'needs_review' ELSE 'model_ready' END AS decision FROM c""",
)
def rv4_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV-4, AG-24: readiness from conditional counts and minimums."""
    gates = {"eligible": F.col("review_status").isin("human_verified", "machine_high_confidence") & F.col("evidence_present"), "verified": F.col("review_status") == "human_verified", "evidenced": F.col("evidence_present")}
    return R.readiness_decision(queue(spark, sf_dir), gates, {"eligible": 60, "verified": 80})


@register(
    "pj5_surprise_features",
    """WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS a1, sum(l_quantity) AS a2, count(*) * 25.0 AS e2 FROM lineitem GROUP BY 1),
    p AS (SELECT o_orderkey AS event_id, (a1 - o_totalprice) / nullif(abs(o_totalprice), 0) AS p1, (a2 - e2) / nullif(abs(e2), 0) AS p2 FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
    s AS (SELECT *, (p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT AS n FROM p),
    t AS (SELECT event_id, n, (coalesce(tanh(p1 / 0.05), 0) + coalesce(tanh(p2 / 0.05), 0)) / nullif(n, 0) AS score, (coalesce(p1, 0) + coalesce(p2, 0)) / nullif(n, 0) AS mean, greatest(abs(p1), abs(p2)) AS m FROM s)
    SELECT event_id, round(score, 6) AS surprise_score, n AS surprise_signals, CASE WHEN mean IS NULL THEN 'unknown' WHEN mean > 0.005 THEN 'positive' WHEN mean < -0.005 THEN 'negative' ELSE 'mixed' END AS surprise_direction,
      CASE WHEN score IS NULL THEN 'unknown' WHEN abs(score) >= 0.65 THEN 'large' WHEN abs(score) >= 0.25 THEN 'medium' ELSE 'small' END AS surprise_magnitude, round(m, 6) AS surprise_max_abs_pct FROM t""",
)
def pj5_surprise_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-3, PJ-5: surprise score, direction and magnitude."""
    per = base.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("a1"), F.sum("l_quantity").alias("a2"), (F.count("*") * 25.0).cast("double").alias("e2")
    )
    o = base.table(spark, sf_dir, "orders")
    rows = o.join(per, o.o_orderkey == per.l_orderkey, "left").select(F.col("o_orderkey").alias("event_id"), "o_totalprice", "a1", "a2", "e2")
    return rounded(X.surprise_features(rows, (("a1", "o_totalprice"), ("a2", "e2"))).drop("o_totalprice", "a1", "a2", "e2"))


_CONTEXT = "WITH " + base.EVENTS + """, ctx AS (SELECT CASE WHEN event_id % 10 = 0 THEN event_id END AS event_id, ticker, CAST(event_time AS DATE) AS asof_date, CAST(round(amount) AS BIGINT) AS shares FROM evts WHERE event_id % 5 = 0),
exact AS (SELECT event_id, arg_max(shares, (asof_date, shares)) AS shares FROM ctx WHERE event_id IS NOT NULL GROUP BY 1),
dated AS (SELECT ticker, asof_date, max(shares) AS shares FROM ctx GROUP BY 1, 2), asked AS (SELECT *, CAST(event_time AS DATE) AS day FROM evts)
"""


@register(
    "jn3_context_lookup",
    _CONTEXT + """SELECT a.event_id, coalesce(x.shares, d.shares) AS shares, CASE WHEN x.shares IS NOT NULL THEN 'exact' WHEN d.shares IS NOT NULL THEN 'asof' ELSE 'none' END AS context_match
    FROM asked a LEFT JOIN exact x USING (event_id) ASOF LEFT JOIN dated d ON a.ticker = d.ticker AND a.day >= d.asof_date""",
)
def jn3_context_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-3: exact context, else the latest of the ticker."""
    e = base.events(spark, sf_dir)
    context = e.where("event_id % 5 = 0").select(F.when(F.col("event_id") % 10 == 0, F.col("event_id")).alias("event_id"), "ticker", F.col("event_time").cast("date").alias("asof_date"), F.round("amount").cast("long").alias("shares"))
    return X.context_lookup(e, context, ["shares"]).select("event_id", "shares", "context_match")


def _revisions(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    estimates = base.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").alias("estimate_time"), F.col("l_linenumber").alias("analyst_id"), F.col("l_returnflag").alias("metric"), F.col("l_extendedprice").alias("estimate_value")
    )
    return rounded(X.revisions(events, estimates).drop("consensus", "median_revision").withColumn("dispersion", F.round("dispersion", 4)))


def _moves(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice")
    quotes = base.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").alias("quote_time"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")).alias("expiration"), (F.col("l_quantity") * 1500).alias("underlying_price"),
        price.alias("strike"), (price * F.col("l_discount")).alias("call_mid"), F.lit(None).cast("double").alias("call_bid"), F.lit(None).cast("double").alias("call_ask"),
        F.lit(None).cast("double").alias("put_mid"), (price * F.col("l_tax")).alias("put_bid"), (price * F.col("l_discount")).alias("put_ask"),
    )
    return X.implied_moves(events, quotes).withColumn("implied_move", F.round(F.col("implied_move") + 1e-9, 6))


_REVISIONS = (
    "WITH " + base.EVENTS + """, r AS (SELECT f.event_id, l_returnflag AS metric, l_linenumber AS analyst_id, l_extendedprice AS v, l_shipdate AS t, date_diff('second', l_shipdate, f.event_time) AS age FROM evts f JOIN lineitem ON l_suppkey = f.ticker
      WHERE date_diff('second', l_shipdate, f.event_time) BETWEEN 0 AND 370 * 86400),
    b AS (SELECT event_id, metric, analyst_id, arg_max(v, (t, v)) AS n, arg_max(v, (t, v)) FILTER (WHERE age >= 30 * 86400) AS p FROM r GROUP BY 1, 2, 3)
    SELECT event_id, metric, count(*) AS analysts, count(p) AS matched, count(*) FILTER (WHERE abs(n - p) > 1e-12) AS revised, round(avg(n - p), 6) AS mean_revision, round(avg(CASE WHEN p IS NOT NULL THEN CAST(n > p AS DOUBLE) END), 6) AS pct_up,
      round(avg(CASE WHEN p IS NOT NULL THEN CAST(n < p AS DOUBLE) END), 6) AS pct_down, round(CASE WHEN count(*) > 1 THEN stddev_samp(n) ELSE 0 END, 4) AS dispersion FROM b GROUP BY 1, 2"""
)


@register("jn5_analyst_revisions", _REVISIONS)
@register("jn5_all_analyst_revisions", _REVISIONS)
def jn5_analyst_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-5: latest and earlier estimate per analyst, and their change."""
    return _revisions(spark, sf_dir, base.events(spark, sf_dir))


@register(
    "jn5_revision_features",
    "WITH " + base.EVENTS + """, est AS (SELECT l_suppkey AS ticker, CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN l_orderkey END AS event_id, l_shipdate AS t, l_linenumber AS analyst_id, l_returnflag AS metric, l_extendedprice AS v FROM lineitem),
    named AS (SELECT DISTINCT event_id, ticker FROM est WHERE event_id IS NOT NULL), asked AS (SELECT e.event_id, e.ticker, e.event_time, n.event_id IS NOT NULL AS own FROM evts e LEFT JOIN named n ON e.event_id = n.event_id AND e.ticker = n.ticker),
    met AS (SELECT a.event_id, metric, analyst_id, v, t, date_diff('second', t, a.event_time) AS age FROM asked a JOIN est ON NOT a.own AND est.ticker = a.ticker AND date_diff('second', t, a.event_time) BETWEEN 0 AND 370 * 86400
      UNION ALL SELECT a.event_id, metric, analyst_id, v, t, date_diff('second', t, a.event_time) FROM asked a JOIN est ON a.own AND est.event_id = a.event_id WHERE date_diff('second', t, a.event_time) BETWEEN 0 AND 370 * 86400),
    b AS (SELECT event_id, metric, analyst_id, w, arg_max(v, (t, v)) AS n, arg_max(v, (t, v)) FILTER (WHERE age >= w * 86400) AS p FROM met, (VALUES (7), (30)) g(w) WHERE metric IN ('A', 'N') GROUP BY ALL),
    f AS (SELECT event_id, metric, w AS window_days, count(*) AS analysts, avg(n) AS consensus, count(p) AS matched, count(*) FILTER (WHERE abs(n - p) > 1e-12) AS revised, avg(n - p) AS mean_revision, median(n - p) AS median_revision,
      avg(CASE WHEN p IS NOT NULL THEN CAST(n > p AS DOUBLE) END) AS pct_up, avg(CASE WHEN p IS NOT NULL THEN CAST(n < p AS DOUBLE) END) AS pct_down, CASE WHEN count(*) > 1 THEN stddev_samp(n) ELSE 0 END AS dispersion FROM b GROUP BY ALL)
    SELECT a.event_id, CASE WHEN f.metric IS NULL THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN f.metric IS NOT NULL THEN '' WHEN a.event_id IN (SELECT event_id FROM met) THEN 'no requested metric estimates' ELSE 'no pre-event estimates' END AS reason,
      f.metric, window_days, analysts, round(consensus + 1e-9, 4) AS consensus, matched, revised, round(mean_revision + 1e-9, 4) AS mean_revision, round(median_revision + 1e-9, 4) AS median_revision, round(pct_up, 6) AS pct_up, round(pct_down, 6) AS pct_down, round(dispersion + 1e-9, 3) AS dispersion
    FROM asked a LEFT JOIN f ON a.event_id = f.event_id""",
)
def jn5_revision_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-5: two windows, estimates that name their event, and skipped events with the reason."""
    estimates = base.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 3 == 0), F.col("l_orderkey")).alias("event_id"), F.col("l_shipdate").alias("estimate_time"), F.col("l_linenumber").alias("analyst_id"), F.col("l_returnflag").alias("metric"), F.col("l_extendedprice").alias("estimate_value")
    )
    out = X.revision_features(base.events(spark, sf_dir), estimates, ["A", "N"])
    fine = {c: F.round(F.col(c) + 1e-9, 4) for c in ("consensus", "mean_revision", "median_revision")}
    return out.withColumns(fine | {"dispersion": F.round(F.col("dispersion") + 1e-9, 3), "pct_up": F.round("pct_up", 6), "pct_down": F.round("pct_down", 6)})


_MOVES = (
    "WITH " + base.EVENTS + """, q AS (SELECT f.event_id, date_diff('day', CAST(f.event_time AS DATE), CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER)) AS dte, abs(l_extendedprice - l_quantity * 1500) / (l_quantity * 1500) AS miss,
      date_diff('second', l_shipdate, f.event_time) AS age, l_extendedprice AS strike, l_extendedprice * l_discount AS c, (l_extendedprice * l_tax + l_extendedprice * l_discount) / 2 AS p, l_quantity * 1500 AS spot
      FROM evts f JOIN lineitem ON l_suppkey = f.ticker),
    b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dte, miss, age, strike, c, p, spot) AS k FROM q WHERE age BETWEEN 0 AND 14 * 86400 AND dte >= 0)
    SELECT event_id, dte AS days_to_expiration, strike, round((c + p) / spot + 1e-9, 6) AS implied_move FROM b WHERE k = 1"""
)


@register("jn4_implied_moves", _MOVES)
@register("jn4_all_implied_moves", _MOVES)
def jn4_implied_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-4: at-the-money straddle per event."""
    return _moves(spark, sf_dir, base.events(spark, sf_dir))


@register(
    "wn16_guidance_bridge",
    """WITH g AS (SELECT o_orderkey AS event_id, o_custkey AS ticker, o_orderdate AS event_time, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS a, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice * (0.8 + (o_orderkey % 5) / 10) END AS guidance FROM orders),
    l AS (SELECT *, lag(guidance) OVER w AS prior, date_diff('day', CAST(lag(event_time) OVER w AS DATE), CAST(event_time AS DATE)) AS gap FROM g WINDOW w AS (PARTITION BY ticker ORDER BY event_time, event_id)),
    s AS (SELECT *, a / nullif(prior, 0) AS ratio FROM l),
    t AS (SELECT *, CASE WHEN a IS NULL THEN 'missing_actual_revenue' WHEN prior IS NULL THEN 'missing_prior_guidance' WHEN gap = 0 THEN 'duplicate_or_same_day_event' WHEN gap < 45 THEN 'prior_event_gap_too_short' WHEN gap > 190 THEN 'prior_event_gap_too_long'
      WHEN ratio NOT BETWEEN 0.5 AND 1.75 THEN 'ambiguous' ELSE 'ready' END AS status FROM s),
    r AS (SELECT *, (rank() OVER (PARTITION BY ticker, status = 'ready' ORDER BY round(ratio, 9)) + (count(*) OVER (PARTITION BY ticker, status = 'ready', round(ratio, 9)) - 1) / 2) / count(*) OVER (PARTITION BY ticker, status = 'ready') AS k FROM t)
    SELECT event_id, gap AS gap_days, round(ratio, 6) AS ratio, status, CASE WHEN status = 'ready' THEN CASE WHEN ratio - 1 > 0.02 THEN 'positive' WHEN ratio - 1 < -0.02 THEN 'negative' ELSE 'flat' END END AS guidance_direction,
      CASE WHEN status = 'ready' THEN CASE WHEN abs(ratio - 1) >= 0.1 THEN 'large' WHEN abs(ratio - 1) >= 0.04 THEN 'medium' WHEN abs(ratio - 1) >= 0.02 THEN 'small' ELSE 'none' END END AS guidance_magnitude,
      round(CASE WHEN status = 'ready' THEN k END, 6) AS surprise_rank FROM r""",
)
def wn16_guidance_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-16: actual against the guidance of the previous event."""
    o = base.table(spark, sf_dir, "orders")
    e = o.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("ticker"), F.col("o_orderdate").alias("event_time"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("actual_revenue"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") * (0.8 + (F.col("o_orderkey") % 5) / 10)).alias("guidance"),
    )
    return rounded(X.guidance_bridge(e).select("event_id", "gap_days", "ratio", "status", "guidance_direction", "guidance_magnitude", "surprise_rank"))


_SESSION = "CASE WHEN hour(ts) * 60 + minute(ts) < 570 THEN 'before_open' WHEN hour(ts) * 60 + minute(ts) >= 960 THEN 'after_close' ELSE 'intraday' END"


@register("pj6_sessions", f"SELECT {_SESSION} AS session, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def pj6_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-6: release session by the clock."""
    return rounded(base.table(spark, sf_dir, "events").groupBy(session_of(F.col("ts")).alias("session"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


@register(
    "pj15_timestamp_readiness",
    f"""WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 13 = 0 THEN NULL ELSE {_SESSION} END AS s FROM events),
    i AS (SELECT event_id, concat_ws(';', CASE WHEN hour(ts) = 0 AND minute(ts) = 0 AND coalesce(s, 'unknown') <> 'before_open' THEN 'date_only_time' END, CASE WHEN s IS NULL THEN 'unknown_session' END, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend_event' END) AS timestamp_issues FROM e)
    SELECT event_id, timestamp_issues, CASE WHEN timestamp_issues = '' THEN 'ok' ELSE 'warn' END AS timestamp_status, timestamp_issues <> '' AS explanatory_only FROM i""",
)
def pj15_timestamp_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("event_time"), F.when(F.col("event_id") % 13 != 0, session_of(F.col("ts"))).alias("release_session"))
    return X.timestamp_readiness(e).select("event_id", "timestamp_issues", "timestamp_status", "explanatory_only")


_FILINGS = """WITH f AS (SELECT o_orderkey AS accession, o_custkey AS cik, CASE WHEN o_orderstatus = 'P' THEN '8-K/A' ELSE '8-K' END AS form, o_orderdate AS accepted_at, ['1.05', '8.01', ''][o_orderkey % 3 + 1] AS item, o_orderpriority AS event_type FROM orders),
j AS (SELECT a.accession AS amendment, a.item AS a_item, a.accepted_at AS a_at, o.accession AS original, o.accepted_at AS o_at, coalesce(a.item <> '' AND contains(o.item, a.item), false) AS i, coalesce(a.event_type = o.event_type, false) AS t
  FROM f a LEFT JOIN f o ON a.cik = o.cik AND o.form = '8-K' AND o.accepted_at < a.accepted_at WHERE a.form = '8-K/A'),
c AS (SELECT *, row_number() OVER (PARTITION BY amendment ORDER BY i DESC, t DESC, o_at DESC, original DESC) AS k FROM j),
chains AS (SELECT amendment, original, round(date_diff('second', o_at, a_at) / 86400, 4) AS days_after, CASE WHEN original IS NULL THEN 0.0 WHEN a_item <> '' THEN 0.92 ELSE 0.85 END::DOUBLE AS confidence FROM c WHERE k = 1)
"""


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base.table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("cik"), F.when(F.col("o_orderstatus") == "P", "8-K/A").otherwise("8-K").alias("form"), F.col("o_orderdate").alias("accepted_at"),
        F.expr("element_at(array('1.05', '8.01', ''), cast(o_orderkey % 3 as int) + 1)").alias("item"), F.col("o_orderpriority").alias("event_type"),
    )


@register("jn12_amendment_chains", _FILINGS + "SELECT * FROM chains")
def jn12_amendment_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-12: amendments and their originals."""
    return X.amendment_chains(_filings(spark, sf_dir))


@register(
    "jn13_amendment_flags",
    _FILINGS + """, p AS (SELECT original, count(*) AS amendments, min(days_after) AS first_after FROM chains WHERE original IS NOT NULL GROUP BY 1)
    SELECT accession, amendments IS NOT NULL AS amended_later, coalesce(amendments, 0) AS amendments, first_after FROM f LEFT JOIN p ON accession = original""",
)
def jn13_amendment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _filings(spark, sf_dir)
    return X.amendment_flags(f, X.amendment_chains(f)).select("accession", "amended_later", "amendments", "first_after")


@register(
    "au2_duplicate_audit",
    "WITH " + base.EVENTS + """ SELECT event_id, count(*) OVER w AS duplicate_count, row_number() OVER (w ORDER BY event_time, event_id) AS duplicate_place, first(event_id) OVER (w ORDER BY event_time, event_id) AS canonical,
    CASE WHEN count(*) OVER w = 1 THEN 'clear' WHEN row_number() OVER (w ORDER BY event_time, event_id) = 1 THEN 'primary' ELSE 'duplicate' END AS duplicate_status
    FROM evts WINDOW w AS (PARTITION BY ticker, event_type, date_trunc('month', event_time))""",
)
def au2_duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AU-1 to AU-7: key, size, first row and status of duplicate groups."""
    e = base.events(spark, sf_dir)
    out = X.duplicate_audit(e, [F.col("ticker"), F.col("event_type"), F.date_format("event_time", "yyyy-MM")], ["event_time", "event_id"])
    return out.select("event_id", "duplicate_count", "duplicate_place", "canonical", "duplicate_status")


@register(
    "wn19_occurrence_suffix",
    "SELECT conv_id::VARCHAR || CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN '__dup' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::VARCHAR ELSE '' END AS conv_id, turn FROM conversations",
)
def wn19_occurrence_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.occurrence_suffix(base.table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn")


@register(
    "pj14_normal_cdf",
    f"SELECT event_id, round(0.5 * (1 + {base.erf_sql('(value / 50 - 1) / sqrt(2.0)')}), 6) AS p, CASE WHEN value / 50 - 1 > 0.5 THEN 'high' WHEN value / 50 - 1 < -0.5 THEN 'low' ELSE 'mid' END AS side, "
    "CASE WHEN value <= 10 THEN 'tiny' WHEN value <= 40 THEN 'small' WHEN value <= 80 THEN 'medium' ELSE 'large' END AS bucket FROM events",
)
def pj14_normal_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-11, PJ-12, PJ-14: distribution function, flat band, right-closed buckets."""
    z = F.col("value") / 50 - 1
    return base.table(spark, sf_dir, "events").select(
        "event_id", F.round(normal_cdf(z), 6).alias("p"), direction(z, 0.5, "high", "low", "mid").alias("side"), right_closed_bucket(F.col("value"), (10, 40, 80), ("tiny", "small", "medium", "large")).alias("bucket")
    )


@register(
    "sc2_ticker_universe",
    "SELECT DISTINCT ticker FROM (SELECT c_mktsegment AS ticker FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT 'INDEX')",
)
def sc2_ticker_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-2: tickers, sector benchmarks and the index."""
    from afterbell.sources.events import ticker_universe

    rows = base.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("ticker"), F.lit(None).cast("string").alias("sector_benchmark"))
    rows = rows.unionAll(base.table(spark, sf_dir, "nation").select(F.lit(None).cast("string"), "n_name"))
    return ticker_universe(rows, "INDEX")


@register(
    "pj24_row_validation",
    """WITH i AS (SELECT o_orderkey, concat_ws(';', CASE WHEN o_totalprice > 400000 THEN 'large_amount' END, CASE WHEN o_orderpriority LIKE '%LOW%' THEN 'low_priority' END, CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 'late' END) AS issues FROM orders)
    SELECT issues, count(*) AS n, CASE WHEN issues = '' THEN 'ok' WHEN issues LIKE '%late%' THEN 'fail' ELSE 'warn' END AS status FROM i GROUP BY 1""",
)
def pj24_row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-24: issue lists by row rules."""
    found = issues((F.col("o_totalprice") > 400000, "large_amount"), (F.col("o_orderpriority").contains("LOW"), "low_priority"), (F.col("o_orderdate") >= "2001-01-01", "late"))
    rows = base.table(spark, sf_dir, "orders").select(F.array_join(found, ";").alias("issues"))
    status = F.when(F.col("issues") == "", "ok").when(F.col("issues").contains("late"), "fail").otherwise("warn")
    return rows.groupBy("issues").agg(F.count("*").alias("n")).withColumn("status", status)
