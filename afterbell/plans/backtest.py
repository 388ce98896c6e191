"""Backtest queries: predictions are a fixed logistic of the pre-event run-up, targets the sign of the one-day abnormal return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.operators import backtest as B
from afterbell.plans import base
from afterbell.plans.registry import register
from afterbell.plans.study import rounded, study_frame

PREDS = base.STUDY + """, preds AS (SELECT event_id, ticker, event_type, reaction_start, round(1 / (1 + exp(-2 * pre_20)), 6) AS p, CASE WHEN car_1 > 0 THEN 1 ELSE 0 END AS y, round(car_1, 9) AS ret
  FROM study WHERE status = 'ok' AND car_1 IS NOT NULL)
"""
KEYS, ORDER = ["event_type"], ["reaction_start", "event_id"]
_TRADES = """, s AS (SELECT *, CASE WHEN p >= 0.6 THEN 1 WHEN p <= 0.4 THEN -1 ELSE 0 END AS side, exp(ret) - 1 AS gross FROM preds)
"""


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = study_frame(spark, sf_dir).where("status = 'ok' and car_1 is not null")
    p = F.round(1 / (1 + F.exp(-2 * F.col("pre_20"))), 6)
    return s.select("event_id", "ticker", "event_type", "reaction_start", p.alias("p"), F.when(F.col("car_1") > 0, 1).otherwise(0).alias("y"), F.round("car_1", 9).alias("ret"))


@register(
    "ag11_calibration",
    PREDS
    + """, b AS (SELECT CAST(greatest(1, ceil(round(least(greatest(p, 0), 1) * 10, 9))) AS INTEGER) AS bin, p, y FROM preds),
    s AS (SELECT bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM b GROUP BY 1),
    f AS (SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_p, mean_y, abs(mean_p - mean_y) AS gap FROM (SELECT unnest(range(1, 11)) AS bin) r LEFT JOIN s USING (bin))
    SELECT bin, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y, round(gap, 6) AS gap, round(sum(coalesce(n * gap, 0)) OVER () / sum(n) OVER (), 6) AS ece FROM f""",
)
def ag11_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-11: calibration bins with empty ones, and the expected calibration error."""
    return rounded(B.calibration(preds(spark, sf_dir), "p", "y"))


@register(
    "ag12_classification_metrics",
    PREDS
    + """, q AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS c, CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END AS hit FROM preds),
    a AS (SELECT a.event_type, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM preds a JOIN preds b ON a.event_type = b.event_type AND a.y = 1 AND b.y = 0 GROUP BY 1)
    SELECT event_type, count(*) AS n, round(avg(hit), 6) AS accuracy, round((avg(hit) FILTER (WHERE y = 1) + avg(hit) FILTER (WHERE y = 0)) / 2, 6) AS balanced_accuracy, round(avg((p - y) * (p - y)), 6) AS brier,
      round(avg(-CASE WHEN y = 1 THEN ln(c) ELSE ln(1 - c) END), 6) AS log_loss, round(any_value(auc), 6) AS roc_auc FROM q JOIN a USING (event_type) GROUP BY 1""",
)
def ag12_classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.classification_metrics(preds(spark, sf_dir), "p", "y", KEYS))


_EQUITY = """, n AS (SELECT *, side * gross - 10 / 1e4 AS net FROM s WHERE side <> 0),
e AS (SELECT *, exp(sum(ln(1 + net)) OVER w) AS equity FROM n WINDOW w AS (PARTITION BY event_type ORDER BY reaction_start, event_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, equity / greatest(max(equity) OVER w, 1.0) - 1 AS drawdown FROM e WINDOW w AS (PARTITION BY event_type ORDER BY reaction_start, event_id ROWS UNBOUNDED PRECEDING))
"""


def _preds_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns that leave 1 + net above 0 on both sides, so that a sum of logs can stand for the product."""
    return preds(spark, sf_dir).withColumn("ret", F.round(F.col("ret") / 20, 9))


_SAFE = PREDS.replace("round(car_1, 9) AS ret", "round(round(car_1, 9) / 20, 9) AS ret")


_SUMMARY = (
    _SAFE + _TRADES + _EQUITY
    + """SELECT event_type, count(*) AS trades, round(avg(gross), 6) AS mean_gross, round(avg(net), 6) AS mean_net, round(avg(CAST(net > 0 AS DOUBLE)), 6) AS hit_rate,
      round(CASE WHEN count(*) > 1 THEN avg(net) / nullif(stddev_samp(net), 0) * sqrt(count(*)) END, 4) AS event_sharpe, round(min(drawdown), 6) AS max_drawdown FROM d GROUP BY 1"""
)


@register("ml4_research_backtest", _SUMMARY)
def ml4_research_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-4: the summary of a whole research backtest."""
    parts = B.research_backtest(_preds_safe(spark, sf_dir), "p", "y", "ret", KEYS, ORDER)
    return rounded(parts["summary"].withColumn("event_sharpe", F.round("event_sharpe", 4)))


@register("wn12_strategy_summary", _SUMMARY)
def wn12_strategy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-12: trades with equity curve, summed up by strategy."""
    out = B.strategy_summary(B.strategy(_preds_safe(spark, sf_dir), "p", "ret", KEYS, ORDER), KEYS)
    return rounded(out.withColumn("event_sharpe", F.round("event_sharpe", 4)))


@register(
    "wn12_equity_curve",
    _SAFE + _TRADES + _EQUITY + "SELECT event_type, event_id, side AS position, round(net, 6) AS net, round(equity, 5) AS equity, round(drawdown, 5) AS drawdown FROM d",
)
def wn12_equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.strategy(_preds_safe(spark, sf_dir), "p", "ret", KEYS, ORDER)
    return t.select("event_type", "event_id", "position", F.round("net", 6).alias("net"), F.round("equity", 5).alias("equity"), F.round("drawdown", 5).alias("drawdown"))


@register(
    "wn13_cost_grid",
    _SAFE + _TRADES
    + """, c AS (SELECT s.*, cost_bps, side * gross - cost_bps / 1e4 AS net FROM s, (VALUES (5.0::DOUBLE), (25.0), (50.0), (100.0)) g(cost_bps) WHERE side <> 0),
    e AS (SELECT *, exp(sum(ln(1 + net)) OVER w) AS equity FROM c WINDOW w AS (PARTITION BY event_type, cost_bps ORDER BY reaction_start, event_id ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, equity / greatest(max(equity) OVER w, 1.0) - 1 AS drawdown FROM e WINDOW w AS (PARTITION BY event_type, cost_bps ORDER BY reaction_start, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_type, cost_bps, count(*) AS trades, round(avg(gross), 6) AS mean_gross, round(avg(net), 6) AS mean_net, round(avg(CAST(net > 0 AS DOUBLE)), 6) AS hit_rate,
      round(CASE WHEN count(*) > 1 THEN avg(net) / nullif(stddev_samp(net), 0) * sqrt(count(*)) END, 4) AS event_sharpe, round(min(drawdown), 5) AS max_drawdown FROM d GROUP BY 1, 2""",
)
def wn13_cost_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.cost_grid(_preds_safe(spark, sf_dir), "p", "ret", KEYS, ORDER)
    return rounded(out.withColumn("event_sharpe", F.round("event_sharpe", 4)).withColumn("max_drawdown", F.round("max_drawdown", 5)))


@register(
    "wn15_nested_thresholds",
    PREDS
    + """, r AS (SELECT *, count(p) OVER (PARTITION BY event_type ORDER BY reaction_start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM preds),
    c AS (SELECT r.*, t, CASE WHEN p >= t THEN 1 WHEN p <= 1 - t THEN -1 ELSE 0 END AS side FROM r, (VALUES (0.5::DOUBLE), (0.55), (0.6), (0.65), (0.7)) g(t)),
    n AS (SELECT *, CASE WHEN side <> 0 THEN side * (exp(ret) - 1) - 10 / 1e4 END AS net FROM c),
    m AS (SELECT *, count(net) OVER w AS k, round(avg(net) OVER w, 12) AS mean FROM n WINDOW w AS (PARTITION BY event_type, t ORDER BY reaction_start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY (k > 0) DESC, mean DESC NULLS LAST, k DESC, t) AS best FROM m)
    SELECT event_type, CAST(reaction_start AS VARCHAR) AS reaction_start, event_id, prior AS prior_rows, CASE WHEN prior >= 30 AND k > 0 THEN t ELSE 0.6 END AS threshold,
      CASE WHEN prior < 30 THEN 'default_not_enough_prior_rows' WHEN k = 0 THEN 'default_no_candidate_trades' ELSE 'selected' END AS status FROM b WHERE best = 1""",
)
def wn15_nested_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-15: the threshold each row would have been given by the rows before it."""
    return B.nested_thresholds(preds(spark, sf_dir), "p", "ret", KEYS, ORDER).withColumn("reaction_start", F.col("reaction_start").cast("string"))


def _once(place: str, name: str) -> str:
    """One pass of the permutation over a place: four rounds, unrolled."""
    low, high = f"({place} // b)", f"({place} % b)"

    def mix(x: str, turn: int) -> str:
        t = f"(({x} * {B.TIMES} + k * {B.BY_KEY} + {turn * B.BY_ROUND + 1}) % {B.PRIME})"
        return f"(({t} * {t} + {x}) % {B.PRIME})"

    for turn in range(1, B.ROUNDS + 1):
        if turn % 2:
            low = f"(({low} + {mix(high, turn)}) % a)"
        else:
            high = f"(({high} + {mix(low, turn)}) % b)"
    return f"({low} * b + {high})"


@register(
    "ml5_null_shuffle",
    PREDS + _TRADES
    + f""", r AS (SELECT event_type, event_id, side, gross, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM s),
    g AS (SELECT *, greatest(CAST(floor(sqrt(n)) AS BIGINT), 1) AS a FROM r), t AS (SELECT g.*, CAST(ceil(n / a) AS BIGINT) AS b, k FROM g, (SELECT unnest(range(1, 21)) AS k) WHERE side <> 0),
    m AS (SELECT event_type, k, side, list_reduce(list_prepend({_once("r", "r")}, range({B.WALK - 1})), lambda x, i: CASE WHEN x < n THEN x ELSE {_once("x", "x")} END) AS r FROM t),
    z AS (SELECT m.event_type, k, avg(m.side * r.gross - 10 / 1e4) AS null_net FROM m JOIN r USING (event_type, r) GROUP BY 1, 2),
    a AS (SELECT event_type, count(*) AS n, avg(CASE WHEN side <> 0 THEN side * gross - 10 / 1e4 END) AS actual FROM r GROUP BY 1)
    SELECT event_type, n, round(actual, 6) AS actual, round(avg(null_net), 6) AS null_mean, round(stddev_samp(null_net), 6) AS null_std, round((actual - avg(null_net)) / stddev_samp(null_net), 4) AS z,
      round((sum(CASE WHEN round(null_net, 12) >= round(actual, 12) THEN 1 ELSE 0 END) + 1) / (count(*) + 1), 6) AS p_value FROM z JOIN a USING (event_type) GROUP BY 1, 2, actual""",
)
def ml5_null_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-5: shuffled returns, 20 iterations."""
    out = rounded(B.null_shuffle(preds(spark, sf_dir), "p", "ret", "event_id", KEYS, iterations=20))
    return out.withColumn("z", F.round("z", 4))


@register(
    "ml7_peer_controls",
    "WITH " + base.EVENTS
    + """, t AS (SELECT DISTINCT ticker FROM evts), p AS (SELECT ticker, coalesce(lead(ticker) OVER (ORDER BY ticker), first(ticker) OVER (ORDER BY ticker)) AS peer FROM t)
    SELECT event_id::VARCHAR || '__peer_' || peer::VARCHAR AS event_id, peer AS ticker, event_time, 'peer_control' AS event_type FROM evts JOIN p USING (ticker) WHERE peer <> ticker""",
)
def ml7_peer_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-7, JN-18: events at the next ticker of the ring."""
    e = base.events(spark, sf_dir)
    return B.peer_controls(e, B.ring_peers(e.select("ticker")))


_FREE = "WITH " + base.BARS + ", " + base.EVENTS + """,
free AS (SELECT ticker, d FROM bars b WHERE NOT EXISTS (SELECT 1 FROM evts e WHERE e.ticker = b.ticker AND abs(CAST(e.event_time AS DATE) - b.d) <= 10))
"""


@register("jn17_free_days", _FREE + "SELECT ticker, CAST(d AS VARCHAR) AS d FROM free")
def jn17_free_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-17: bars away from every event of their ticker."""
    return B.free_days(base.bars(spark, sf_dir), base.events(spark, sf_dir)).select("ticker", F.col("d").cast("string").alias("d"))


@register(
    "ml6_random_placebos",
    _FREE
    + """, days AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY md5('42:' || ticker::VARCHAR || ':' || CAST(d AS VARCHAR)), d) - 1 AS r, count(*) OVER (PARTITION BY ticker) AS n FROM free),
    a AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY md5('42:' || event_id::VARCHAR), event_id) - 1 AS k FROM evts)
    SELECT a.event_id::VARCHAR || '__placebo01' AS event_id, a.ticker, CAST(days.d AS VARCHAR) AS placebo_day, 'placebo' AS event_type, 'non_event_control' AS event_subtype
    FROM a JOIN days ON a.ticker = days.ticker AND a.k % days.n = days.r""",
)
def ml6_random_placebos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-6: placebo events at hashed free days."""
    e = base.events(spark, sf_dir)
    out = B.random_placebos(e, B.free_days(base.bars(spark, sf_dir), e))
    return out.withColumn("placebo_day", F.col("placebo_day").cast("string"))


@register(
    "wn18_chronological_split",
    PREDS
    + """, r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY reaction_start, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM preds)
    SELECT event_type, event_id, CASE WHEN k <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def wn18_chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chronological_split(preds(spark, sf_dir), KEYS, ORDER).select("event_type", "event_id", "split")


@register("wn17_purged_walk_forward")
def wn17_purged_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-17, ML-2, ML-3: purged expanding logistic model by ticker; trained in Python, so without SQL."""
    s = study_frame(spark, sf_dir).where("status = 'ok' and car_1 is not null").withColumn("y", F.when(F.col("car_1") > 0, 1.0).otherwise(0.0))
    features = ["materiality", "pre_5", "pre_20", "pre_vol_20", "beta"]
    return B.purged_walk_forward(s.withColumn("reaction_start", F.col("reaction_start").cast("timestamp")), "ticker", "reaction_start", "event_id", features, "y")
