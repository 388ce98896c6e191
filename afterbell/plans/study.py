"""Event study queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.operators import study as S
from afterbell.operators.windows import sparse_returns
from afterbell.plans import base
from afterbell.plans.registry import register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` digits, so that engines agree beyond the order of their sums."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def study_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = S.market_rows(sparse_returns(base.bars(spark, sf_dir)), base.benchmark_returns(spark, sf_dir))
    return S.event_study(base.events(spark, sf_dir), market)


def _ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_frame(spark, sf_dir).where("status = 'ok' and car_3 is not null")


_RATES = """SELECT event_type, count(*) AS n, round(avg(CAST(car_1 > 0 AS DOUBLE)), 6) AS positive_rate, round(avg(CAST(significant_1 AS DOUBLE)), 6) AS significant_rate,
  round(avg(car_1), 6) AS mean_car, round(median(car_1), 6) AS median_car, round(stddev_samp(car_1), 6) AS std_car,
  round(CASE WHEN count(*) > 1 THEN stddev_samp(car_1) / sqrt(count(*)) END, 6) AS stderr_car, round(avg(exp(car_1) - 1), 6) AS mean_simple,
  round(avg(z_1), 6) AS mean_z, round(avg(car_1) / nullif(CASE WHEN count(*) > 1 THEN stddev_samp(car_1) / sqrt(count(*)) END, 0), 6) AS t_stat
FROM study WHERE status = 'ok' AND car_1 IS NOT NULL GROUP BY 1 HAVING count(*) >= 5"""


@register("event_study_base_rates", base.STUDY + _RATES)
def event_study_base_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-1 over WN-1 and WN-2: base rates of the one-day abnormal return by event type."""
    return rounded(S.base_rates(study_frame(spark, sf_dir), ["event_type"], 1, least=5))


_H = ", ".join(
    f"round(car_{h}, 6) AS car_{h}, round(z_{h}, 5) AS z_{h}, round({base.p_sql(f'z_{h}')}, 5) AS p_{h}, significant_{h}, "
    f"CASE WHEN car_{h} IS NULL THEN 'unknown' WHEN car_{h} > 0.002 THEN 'positive' WHEN car_{h} < -0.002 THEN 'negative' ELSE 'flat' END AS direction_{h}"
    for h in S.HORIZONS
)


@register("wn1_event_study", base.STUDY + f"SELECT event_id, ticker, event_type, status, CAST(reaction_start AS VARCHAR) AS reaction_start, coalesce(est_n, 0) AS est_n, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(resid_vol, 6) AS resid_vol, {_H} FROM study")
def wn1_event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-1, WN-2, JN-1: every event with its status, market model and abnormal returns."""
    s = study_frame(spark, sf_dir)
    columns = ["event_id", "ticker", "event_type", "status", F.col("reaction_start").cast("string").alias("reaction_start"), F.coalesce("est_n", F.lit(0)).alias("est_n")]
    columns += [F.round(c, 6).alias(c) for c in ("alpha", "beta", "resid_vol")]
    for h in S.HORIZONS:
        columns += [F.round(f"car_{h}", 6).alias(f"car_{h}"), F.round(f"z_{h}", 5).alias(f"z_{h}"), F.round(f"p_{h}", 5).alias(f"p_{h}"), f"significant_{h}", f"direction_{h}"]
    return s.select(*columns)


@register(
    "wn3_pre_event_runup",
    base.STUDY + "SELECT event_id, round(pre_5, 6) AS pre_5, round(pre_20, 6) AS pre_20, round(pre_vol_20, 6) AS pre_vol_20 FROM study WHERE reaction_start IS NOT NULL",
)
def wn3_pre_event_runup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-3: returns and deviation over the rows before the reaction day."""
    return rounded(study_frame(spark, sf_dir).where("reaction_start is not null").select("event_id", "pre_5", "pre_20", "pre_vol_20"))


@register(
    "ag2_one_way_marginals",
    base.STUDY
    + """, l AS (SELECT event_type, lower(trim(event_subtype)) AS event_subtype, release_session, h.horizon, CASE h.horizon WHEN 1 THEN car_1 WHEN 3 THEN car_3 ELSE car_10 END AS car
      FROM study, (VALUES (1), (3), (10)) h(horizon) WHERE status = 'ok'),
    g AS (SELECT 'all' AS group_column, 'all' AS group_value, horizon, car FROM l UNION ALL SELECT 'event_type', event_type, horizon, car FROM l
      UNION ALL SELECT 'event_subtype', event_subtype, horizon, car FROM l UNION ALL SELECT 'release_session', release_session, horizon, car FROM l)
    SELECT group_column, group_value, horizon, count(*) AS n, round(avg(car), 6) AS mean_car, round(median(car), 6) AS median_car,
      round(avg(CAST(car > 0 AS DOUBLE)), 6) AS positive_rate FROM g WHERE car IS NOT NULL GROUP BY 1, 2, 3""",
)
def ag2_one_way_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.one_way_marginals(study_frame(spark, sf_dir), ["event_type", "event_subtype", "release_session"]))


@register(
    "ag3_return_summary",
    base.STUDY
    + """SELECT release_session, count(*) AS n, round(avg(car_3), 6) AS mean_log, round(median(car_3), 6) AS median_log, round(avg(exp(car_3) - 1), 6) AS mean_simple,
      round(avg(CAST(car_3 > 0 AS DOUBLE)), 6) AS positive_rate, round(avg(abs(car_3)), 6) AS mean_absolute FROM study WHERE status = 'ok' AND car_3 IS NOT NULL GROUP BY 1""",
)
def ag3_return_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("car_3")
    return rounded(
        _ok(spark, sf_dir).groupBy("release_session").agg(
            F.count("*").alias("n"), F.avg(c).alias("mean_log"), F.median(c).alias("median_log"), F.avg(F.expm1(c)).alias("mean_simple"),
            F.avg((c > 0).cast("double")).alias("positive_rate"), F.avg(F.abs(c)).alias("mean_absolute"),
        )
    )


@register(
    "ag4_hypotheses",
    base.STUDY
    + """, h AS (SELECT 'urgent_up' AS hypothesis, 1 AS side, car_3 FROM study WHERE status = 'ok' AND event_type = '1-urgent'
      UNION ALL SELECT 'material_down', -1, car_3 FROM study WHERE status = 'ok' AND materiality >= 0.5 UNION ALL SELECT 'late_up', 1, car_3 FROM study WHERE status = 'ok' AND release_session = 'after_close')
    SELECT hypothesis, count(*) AS n, round(avg(car_3), 6) AS mean_value, round(avg(CAST(car_3 > 0 AS DOUBLE)), 6) AS positive_rate,
      round(avg(CAST(car_3 * side > 0 AS DOUBLE)), 6) AS alignment_rate FROM h WHERE car_3 IS NOT NULL GROUP BY 1""",
)
def ag4_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-4, PJ-20: named masks with the side they expect."""
    masks = {"urgent_up": F.col("event_type") == "1-urgent", "material_down": F.col("materiality") >= 0.5, "late_up": F.col("release_session") == "after_close"}
    return rounded(S.hypothesis_table(_ok(spark, sf_dir), "car_3", masks, {"urgent_up": 1, "material_down": -1, "late_up": 1}))


@register(
    "ag5_threshold_sensitivity",
    base.STUDY
    + """SELECT t.threshold, count(*) AS n, round(avg(car_3), 6) AS mean_value, round(avg(CAST(car_3 > 0 AS DOUBLE)), 6) AS positive_rate
      FROM study, (VALUES (0.0::DOUBLE), (0.1), (0.25), (0.5), (0.75)) t(threshold) WHERE status = 'ok' AND car_3 IS NOT NULL AND materiality >= t.threshold GROUP BY 1""",
)
def ag5_threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.threshold_sensitivity(_ok(spark, sf_dir), "materiality", "car_3", (0, 0.1, 0.25, 0.5, 0.75)))


@register(
    "ag6_winsorised_mean",
    base.STUDY
    + """, q AS (SELECT event_type, quantile_cont(car_3, 0.05) AS lo, quantile_cont(car_3, 0.95) AS hi FROM study WHERE status = 'ok' AND car_3 IS NOT NULL GROUP BY 1)
    SELECT event_type, count(*) AS n, round(avg(least(greatest(car_3, lo), hi)), 6) AS winsorised_mean FROM study JOIN q USING (event_type) WHERE status = 'ok' AND car_3 IS NOT NULL GROUP BY 1""",
)
def ag6_winsorised_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.winsorised_mean(_ok(spark, sf_dir), "car_3", ["event_type"]))


@register(
    "ag7_leave_one_out",
    base.STUDY
    + """, o AS (SELECT event_type, car_3, (sum(car_3) OVER p - car_3) / (count(*) OVER p - 1) AS m, count(*) OVER p AS n FROM study WHERE status = 'ok' AND car_3 IS NOT NULL WINDOW p AS (PARTITION BY event_type))
    SELECT event_type, n, round(min(m), 6) AS least_mean, round(max(m), 6) AS largest_mean FROM o GROUP BY 1, 2""",
)
def ag7_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.leave_one_out_range(_ok(spark, sf_dir), "car_3", ["event_type"]))


@register(
    "ag8_leave_one_group_out",
    base.STUDY
    + """, s AS (SELECT ticker, car_3 FROM study WHERE status = 'ok' AND car_3 IS NOT NULL), k AS (SELECT DISTINCT ticker FROM s)
    SELECT k.ticker AS removed, count(*) AS n, round(avg(car_3), 6) AS mean_left, round(avg(CAST(car_3 > 0 AS DOUBLE)), 6) AS positive_rate FROM k JOIN s ON s.ticker <> k.ticker GROUP BY 1""",
)
def ag8_leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.leave_one_group_out(_ok(spark, sf_dir), "car_3", "ticker"))


@register(
    "ag9_top_k_exclusion",
    base.STUDY
    + """, r AS (SELECT event_type, car_3, row_number() OVER (PARTITION BY event_type ORDER BY abs(car_3) DESC, event_id) AS r FROM study WHERE status = 'ok' AND car_3 IS NOT NULL)
    SELECT event_type, count(*) AS n, """
    + ", ".join(
        f"round(avg(car_3) FILTER (WHERE r > {k}), 6) AS mean_without_{k}, round(coalesce(sum(abs(car_3)) FILTER (WHERE r <= {k}), 0) / sum(abs(car_3)), 6) AS share_top_{k}"
        for k in (0, 1, 3, 5)
    )
    + " FROM r GROUP BY 1",
)
def ag9_top_k_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.top_k_exclusion(_ok(spark, sf_dir), "car_3", ["event_type"], "event_id"))


@register(
    "ag10_concentration",
    base.STUDY
    + """, g AS (SELECT ticker, count(*) AS n, sum(car_3) AS total, sum(abs(car_3)) AS absolute FROM study WHERE status = 'ok' AND car_3 IS NOT NULL GROUP BY 1),
    s AS (SELECT *, absolute / sum(absolute) OVER () AS share FROM g)
    SELECT ticker, n, round(total, 6) AS total, round(absolute, 6) AS absolute, round(share, 6) AS share, row_number() OVER (ORDER BY share DESC, ticker) AS rank,
      round(sum(share) OVER (ORDER BY share DESC, ticker ROWS UNBOUNDED PRECEDING), 6) AS top_share,
      CASE WHEN share > 0.75 THEN 'dominant' WHEN share > 0.5 THEN 'concentrated' ELSE 'none' END AS warning FROM s""",
)
def ag10_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.concentration(_ok(spark, sf_dir), "car_3", "ticker"))
