"""Exact quantiles of groups of any size: an approximate pass gives a narrow range of values, a counting pass settles the rank inside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the approximate pass (ranks are off by at most n / ACCURACY), and the room left on either side of a quantile.
ACCURACY, ROOM = 10_000, 3e-4


def value_range(value: str, q: float) -> Column:
    """Aggregate: two values of the group between which the quantile lies."""
    return F.percentile_approx(value, F.array(F.lit(max(0.0, q - ROOM)), F.lit(min(1.0, q + ROOM))), F.lit(ACCURACY))


def with_quantile(stats: DataFrame, rows: DataFrame, value: str, by: Sequence[str], q: float, name: str, n: str, between: str) -> DataFrame:
    """``stats`` (one row per group of ``by``) with the quantile ``name``, linear between ranks, in place of ``between`` (:func:`value_range`).

    ``n`` is the number of rows with a value. Rows below the range count as one, rows inside it by value, with
    map-side sums, so no group is held anywhere; a window runs over the few values of the range.
    """
    low, high = F.col("_q_between")[0], F.col("_q_between")[1]
    asked = stats.select(*[F.col(c).alias(f"_q_{c}") for c in by], F.col(n).alias("_q_n"), F.col(between).alias("_q_between"))
    same = [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by]
    on = same[0]
    for s in same[1:]:
        on = on & s
    few = F.col("_q_n") <= ACCURACY  # all values then; above, ROOM is at least two ranks more than the approximate pass may be off
    near = rows.select(*by, F.col(value).alias("_q_v")).join(asked, on).where(F.col("_q_v").isNotNull() & (few | (F.col("_q_v") <= high)))
    inside = few | (F.col("_q_v") >= low)
    keys = [f"_q_{c}" for c in by]
    counted = near.groupBy(*keys, "_q_n", inside.alias("_q_inside"), F.when(inside, F.col("_q_v")).alias("_q_v")).agg(F.count("*").alias("_q_c"))
    upto = F.sum("_q_c").over(Window.partitionBy(*keys).orderBy("_q_inside", "_q_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = q * (F.col("_q_n") - 1)
    found = counted.withColumn("_q_upto", upto).groupBy(*keys, "_q_n").agg(
        *[F.min(F.when(F.col("_q_inside") & (F.col("_q_upto") > edge(place)), F.col("_q_v"))).alias(a) for a, edge in (("_q_low", F.floor), ("_q_high", F.ceil))]
    )
    part = place - F.floor(place)
    settled = found.select(*keys, (F.col("_q_low") * (1 - part) + F.col("_q_high") * part).alias(name))
    return stats.drop(between).join(settled, on, "left").drop(*keys)
