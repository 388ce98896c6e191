import random

from pyspark.sql import functions as F

from afterbell.operators.gates import signal_gates


def rows(spark, n, edge, seed=1):
    r = random.Random(seed)
    made = []
    for i in range(n):
        p = r.choice((0.2, 0.5, 0.8))
        ret = edge * (1 if p > 0.5 else -1 if p < 0.5 else 0) + r.gauss(0, 0.01)
        made.append(("k", i, p, int(ret > 0), ret))
    return spark.createDataFrame(made, "k string, i long, p double, y int, ret double")


def decide(spark, preds, controls):
    out = signal_gates(preds, controls, "p", "y", "ret", "i", ["k"], ["i"], iterations=60, limits={"ece": 0.4}).collect()
    return {o.decision for o in out}, {o.gate: o.passed for o in out}


def test_decisions(spark):
    strong = rows(spark, 300, 0.02)
    weak = strong.withColumn("ret", F.col("ret") * 0.1).withColumn("control", F.lit("placebo"))
    alike = strong.withColumn("control", F.lit("peer"))
    assert decide(spark, strong, weak) == ({"promising_needs_fresh_data"}, {g: True for g in ("minimum_predictions", "minimum_trades", "calibration_ece", "null_shuffle_p_value", "positive_mean_net_event_return", "placebo_control_not_stronger")})
    found, gates = decide(spark, strong, weak.unionByName(alike))
    assert found == {"failed_control_test"} and not gates["peer_control_not_stronger"] and gates["placebo_control_not_stronger"]
    assert decide(spark, rows(spark, 12, 0.02), weak.limit(0))[0] == {"inconclusive_too_few_predictions"}
    assert decide(spark, rows(spark, 300, -0.02), weak.limit(0))[0] == {"not_promising_yet"}
