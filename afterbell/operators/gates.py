"""Gates that a signal has to pass before anyone believes it, and the decision that follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from afterbell.operators import backtest as B
from afterbell.sources.shared import written

#: Limits of the gates.
LIMITS = {"predictions": 30, "trades": 5, "ece": 0.20, "p_value": 0.10, "control": 0.75}


def calibration_error(preds: DataFrame, p: str, y: str, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Expected calibration error by key over equal-width bins (a, b], the first with 0."""
    clipped = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    bin_ = F.greatest(F.lit(1), F.ceil(F.round(clipped * bins, 9)))
    stats = preds.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, bin_.alias("_bin")).agg(F.count("*").alias("_n"), F.abs(F.avg(clipped) - F.avg(y)).alias("_gap"))
    return stats.groupBy(*keys).agg((F.sum(F.col("_n") * F.col("_gap")) / F.sum("_n")).alias("ece"))


def signal_gates(
    preds: DataFrame, controls: DataFrame, p: str, y: str, ret: str, row_id: str, keys: list[str], order: list[str], iterations: int = 500, long: float = 0.6, cost_bps: float = 10.0, limits: dict[str, float] | None = None
) -> DataFrame:
    """One row per key and gate: gate, value, threshold, passed, and the key's decision.

    Gates: predictions, trades, calibration error, p-value of the shuffled returns, mean net return above 0, and for each kind of
    ``controls`` (the columns of preds and ``control``) a mean net return below a share of the signal's own. Decision: all passed,
    ``promising_needs_fresh_data``; a control as strong, ``failed_control_test``; too few predictions, ``inconclusive_too_few_predictions``; else
    ``not_promising_yet``. A missing value passes nothing.
    """
    at = LIMITS | (limits or {})
    rows = written(preds.select(*dict.fromkeys([*keys, *order, row_id, p, y, ret])), "gate-rows")
    net = F.avg(F.when(F.col("_side") != 0, F.col("_side") * F.expm1(ret) - cost_bps / 1e4)).alias("net")

    def traded(df: DataFrame, by: list[str]) -> DataFrame:
        side = B.positions(F.col(p), F.lit(long), F.lit(1 - long))
        return df.where(F.col(ret).isNotNull()).withColumn("_side", side).groupBy(*by).agg(F.sum((F.col("_side") != 0).cast("long")).alias("trades"), net)

    made = rows.groupBy(*keys).agg(F.count(p).alias("predictions"))
    nulls = B.null_shuffle(rows, p, ret, row_id, keys, iterations, long, cost_bps=cost_bps).select(*keys, "p_value")
    one = made.join(traded(rows, keys), keys, "left").join(calibration_error(rows, p, y, keys), keys, "left").join(nulls, keys, "left")
    against = traded(controls, [*keys, "control"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("control", "net"))).alias("_controls"))  # a few kinds
    gate = lambda name, value, threshold, passed: F.struct(F.lit(name).alias("gate") if isinstance(name, str) else name.alias("gate"), value.cast("double").alias("value"), threshold.cast("double").alias("threshold"), F.coalesce(passed, F.lit(False)).alias("passed"))
    limit = lambda name: F.lit(float(at[name]))
    fixed = F.array(
        gate("minimum_predictions", F.col("predictions"), limit("predictions"), F.col("predictions") >= limit("predictions")),
        gate("minimum_trades", F.coalesce("trades", F.lit(0)), limit("trades"), F.col("trades") >= limit("trades")),
        gate("calibration_ece", F.col("ece"), limit("ece"), F.col("ece") <= limit("ece")),
        gate("null_shuffle_p_value", F.col("p_value"), limit("p_value"), F.col("p_value") <= limit("p_value")),
        gate("positive_mean_net_event_return", F.col("net"), F.lit(0.0), F.col("net") > 0),
    )
    own = limit("control") * F.col("net")
    weaker: Column = F.transform(F.coalesce("_controls", F.array().cast("array<struct<control:string,net:double>>")), lambda c: gate(F.concat(c["control"], F.lit("_control_not_stronger")), c["net"], own, c["net"] < own))
    judged = one.join(against, keys, "left").select(*keys, "predictions", F.concat(fixed, weaker).alias("_gates"))
    decision = (
        F.when(F.forall("_gates", lambda g: g["passed"]), "promising_needs_fresh_data")
        .when(F.exists("_gates", lambda g: g["gate"].endswith("control_not_stronger") & ~g["passed"]), "failed_control_test")
        .when(F.col("predictions") < limit("predictions"), "inconclusive_too_few_predictions")
        .otherwise("not_promising_yet")
    )
    return judged.select(*keys, decision.alias("decision"), F.explode("_gates").alias("g")).select(*keys, "g.*", "decision")
