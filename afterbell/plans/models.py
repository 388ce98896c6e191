"""Models fitted by sums: held-out issuers and walk-forward, with one feature, so that SQL can solve each step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.operators import logistic as L
from afterbell.plans import base, registry
from afterbell.plans.backtest import PREDS, preds
from afterbell.plans.registry import register
from afterbell.plans.study import rounded, study_frame
from afterbell.sources.shared import written

ROWS = base.STUDY + """, r AS (SELECT event_id, ticker, event_type, CAST(reaction_start - DATE '1970-01-01' AS BIGINT) AS t, round(pre_20, 9) AS x, CASE WHEN car_1 > 0 THEN 1 ELSE 0 END AS y
  FROM study WHERE status = 'ok' AND car_1 IS NOT NULL AND pre_20 IS NOT NULL)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = study_frame(spark, sf_dir).where("status = 'ok' and car_1 is not null and pre_20 is not null")
    return s.select("event_id", F.col("ticker").cast("string").alias("ticker"), "event_type", "reaction_start", F.round("pre_20", 9).alias("x"), F.when(F.col("car_1") > 0, 1).otherwise(0).alias("y"))


_P = "(1 / (1 + exp(-greatest(least(w0 + w1 * x, 30), -30))))"
SUMS = "count(*) AS n, sum(y) AS n1, " + ", ".join(
    f"coalesce(sum({v}) FILTER (WHERE y = {c}), 0) AS {name}{c}" for c in (0, 1) for name, v in (("u", f"{_P} - {c}"), ("ux", f"({_P} - {c}) * x"), ("h", f"{_P} * (1 - {_P})"), ("hx", f"{_P} * (1 - {_P}) * x"), ("hxx", f"{_P} * (1 - {_P}) * x * x"), ("s", "x"), ("q", "x * x"))
)


def step_sql(sums: str, keys: str) -> str:
    """New w0, w1 of rows with :data:`SUMS` and old w0, w1."""
    return f"""(SELECT {keys}, n, n1, w0 - ((h11 * g0 - h01 * g1) / det) AS w0, w1 - ((h00 * g1 - h01 * g0) / det) AS w1 FROM (
      SELECT *, h11 * h00 - h01 * h01 AS det FROM (
        SELECT *, a0 * u0 + a1 * u1 AS g0, a0 * ux0 + a1 * ux1 + ridge * w1 AS g1, a0 * h0 + a1 * h1 + 1e-9 AS h00, a0 * hx0 + a1 * hx1 AS h01, a0 * hxx0 + a1 * hxx1 + ridge + 1e-9 AS h11 FROM (
          SELECT *, n / (2.0 * greatest(n - n1, 1)) AS a0, n / (2.0 * greatest(n1, 1)) AS a1, greatest((q0 + q1) / n - ((s0 + s1) / n) * ((s0 + s1) / n), 0) AS ridge FROM {sums}))))"""


_FULL = "".join(f", f{k + 1} AS (SELECT w0, w1 FROM {step_sql(f'(SELECT {SUMS}, any_value(w0) AS w0, any_value(w1) AS w1 FROM r, f{k})', '1 AS one')})" for k in range(4))
_OWN = [c + k for c in ("u", "ux", "h", "hx", "hxx", "s", "q") for k in ("0", "1")]
_EXACT = "".join(
    f", e{k + 1} AS (SELECT held, w0, w1 FROM {step_sql(f'(SELECT held, {SUMS}, any_value(w0) AS w0, any_value(w1) AS w1 FROM r JOIN e{k} ON r.ticker <> held GROUP BY held)', 'held')})" for k in range(2)
)


@register(
    "ud8_held_out_issuers",
    f"""{ROWS}, f0 AS (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1){_FULL},
    own AS (SELECT ticker, {SUMS} FROM r, f4 GROUP BY ticker),
    tot AS (SELECT sum(n) AS tn, sum(n1) AS tn1, {", ".join(f"sum({c}) AS t{c}" for c in _OWN)} FROM own),
    one AS (SELECT * FROM {step_sql(f"(SELECT ticker, tn - n AS n, tn1 - n1 AS n1, {', '.join(f't{c} - {c} AS {c}' for c in _OWN)}, w0, w1 FROM own, tot, f4)", "ticker")}),
    e0 AS (SELECT one.ticker AS held, w0, w1 FROM one JOIN own USING (ticker), tot WHERE own.n / tn >= 0.01){_EXACT},
    m AS (SELECT one.ticker, one.n, one.n1, coalesce(e2.w0, one.w0) AS w0, coalesce(e2.w1, one.w1) AS w1 FROM one LEFT JOIN e2 ON held = one.ticker),
    s AS (SELECT ticker, y, {_P} AS p FROM r JOIN m USING (ticker) WHERE m.n >= 40 AND m.n1 > 0 AND m.n1 < m.n)
    SELECT CAST(own.ticker AS VARCHAR) AS ticker, CAST(m.n AS BIGINT) AS train_n, own.n, round(own.n1 / own.n, 6) AS positive_rate, CASE WHEN m.n < 40 THEN 'skipped_insufficient_train_rows' WHEN m.n1 = 0 OR m.n1 = m.n THEN 'skipped_one_class_train' ELSE 'ok' END AS status,
      round(a.accuracy, 6) AS accuracy, round(a.brier, 6) AS brier, round(w1, 5) AS slope, round(own.n / tn, 6) AS share,
      concat_ws(';', CASE WHEN own.n1 = 0 OR own.n1 = own.n THEN 'one_class_test' END, CASE WHEN own.n / tn > 0.5 THEN 'dominant_issuer' END) AS warnings
    FROM own JOIN m USING (ticker) LEFT JOIN (SELECT ticker, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END) AS accuracy, avg((greatest(least(p, 1 - 1e-6), 1e-6) - y) ** 2) AS brier FROM s GROUP BY 1) a USING (ticker), tot""",
)
def ud8_held_out_issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD-8, AG-8: models without each issuer, from totals less its own sums, judged on it."""
    report, _ = L.held_out_issuers(rows(spark, sf_dir), "ticker", ["x"], "y", rounds=4, exact_rounds=2)
    return rounded(report.withColumn("slope", F.round(F.get("w", F.lit(0)), 5)).drop("w"))


_ANCHORS = "".join(
    f", a{k + 1} AS (SELECT b.event_type, b.b, coalesce(n.w0, 0) AS w0, coalesce(n.w1, 0) AS w1 FROM b LEFT JOIN "
    + step_sql(f"(SELECT a.event_type, a.b, {SUMS}, any_value(w0) AS w0, any_value(w1) AS w1 FROM r JOIN a{k} a ON r.event_type = a.event_type AND r.t + 5 < a.b * 64 GROUP BY ALL HAVING sum(y) > 0 AND sum(y) < count(*))", "event_type, b")
    + " n USING (event_type, b))"
    for k in range(3)
)


@register(
    "wn17_block_walk_forward",
    f"""{ROWS}, b AS (SELECT DISTINCT event_type, CAST(floor(t / 64.0) AS BIGINT) AS b FROM r), a0 AS (SELECT *, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1 FROM b){_ANCHORS},
    days AS (SELECT event_type, t AS day, CAST(floor(t / 64.0) AS BIGINT) AS b, count(*) AS c, sum(y) AS s FROM r GROUP BY ALL),
    sums AS (SELECT d.event_type, d.day, {SUMS}, any_value(w0) AS w0, any_value(w1) AS w1 FROM days d JOIN a3 USING (event_type, b) JOIN r ON r.event_type = d.event_type AND r.t + 5 < d.day GROUP BY ALL),
    models AS (SELECT * FROM {step_sql("sums", "event_type, day")}),
    base AS (SELECT event_type, day, sum(s) OVER w / sum(c) OVER w AS base FROM days WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT r.event_type, event_id, CAST(coalesce(m.n, 0) AS BIGINT) AS train_n, round(CASE WHEN m.n >= 40 AND m.n1 > 0 AND m.n1 < m.n THEN {_P} ELSE base END, 6) AS probability, CAST(y AS DOUBLE) AS target,
      CASE WHEN coalesce(m.n, 0) < 40 THEN 'skipped_not_enough_train' WHEN m.n1 = 0 OR m.n1 = m.n THEN 'one_class' ELSE 'ok' END AS status
    FROM r LEFT JOIN models m ON m.event_type = r.event_type AND m.day = r.t JOIN base ON base.event_type = r.event_type AND base.day = r.t""",
)
def wn17_block_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-17, ML-2, ML-3: purged walk-forward by event type, anchors by block and a step for each day."""
    return rounded(L.block_walk_forward(rows(spark, sf_dir), ["event_type"], "reaction_start", "event_id", ["x"], "y", rounds=3))


_NET = "CASE WHEN p >= 0.6 THEN {r} - 10 / 1e4 WHEN p <= 0.4 THEN -({r}) - 10 / 1e4 END"
_KINDS = "(VALUES ('peer', 0.5::DOUBLE), ('placebo', -0.25)) v(control, times)"


def _gates_sql() -> str:
    nulls = registry._ORACLES["ml5_null_shuffle"]
    return f"""{PREDS}, nulls AS (SELECT event_type, p_value FROM ({nulls})),
    b AS (SELECT event_type, greatest(1, ceil(round(least(greatest(p, 0), 1) * 10, 9))) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM preds GROUP BY 1, 2), e AS (SELECT event_type, sum(n * gap) / sum(n) AS ece FROM b GROUP BY 1),
    m AS (SELECT event_type, count(p) AS predictions, count(*) FILTER (WHERE p >= 0.6 OR p <= 0.4) AS trades, avg({_NET.format(r="(exp(ret) - 1)")}) AS net FROM preds GROUP BY 1),
    c AS (SELECT event_type, control, avg({_NET.format(r="(exp(ret * times) - 1)")}) AS net FROM preds, {_KINDS} GROUP BY 1, 2),
    g AS (
      SELECT event_type, 'minimum_predictions' AS gate, predictions::DOUBLE AS value, 30.0::DOUBLE AS threshold, predictions >= 30 AS passed FROM m
      UNION ALL SELECT event_type, 'minimum_trades', trades, 5, trades >= 5 FROM m UNION ALL SELECT event_type, 'calibration_ece', ece, 0.2, ece <= 0.2 FROM e
      UNION ALL SELECT event_type, 'null_shuffle_p_value', p_value, 0.1, p_value <= 0.1 FROM nulls UNION ALL SELECT event_type, 'positive_mean_net_event_return', net, 0, net > 0 FROM m
      UNION ALL SELECT event_type, control || '_control_not_stronger', c.net, 0.75 * m.net, c.net < 0.75 * m.net FROM c JOIN m USING (event_type))
    SELECT event_type, gate, round(value, 6) AS value, round(threshold, 6) AS threshold, passed, CASE WHEN bool_and(passed) OVER w THEN 'promising_needs_fresh_data'
      WHEN bool_or(NOT passed AND gate LIKE '%control_not_stronger') OVER w THEN 'failed_control_test' WHEN predictions < 30 THEN 'inconclusive_too_few_predictions' ELSE 'not_promising_yet' END AS decision
    FROM g JOIN m USING (event_type) WINDOW w AS (PARTITION BY event_type)"""


@register("ml8_signal_gates", _gates_sql())
def ml8_signal_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-8, ML-9: gates of a signal by event type, with controls of scaled returns, and the decision."""
    from afterbell.operators.gates import signal_gates

    p = written(preds(spark, sf_dir), "preds")  # the signal and its controls read them
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("control"), F.lit(t).alias("times")) for c, t in (("peer", 0.5), ("placebo", -0.25))]))
    controls = p.withColumn("k", kinds).select("event_type", "reaction_start", "event_id", "p", "y", (F.col("ret") * F.col("k.times")).alias("ret"), F.col("k.control").alias("control"))
    return rounded(signal_gates(p, controls, "p", "y", "ret", "event_id", ["event_type"], ["reaction_start", "event_id"], iterations=20))
