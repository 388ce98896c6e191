"""Running values in one order over many tasks: sums, products, extremes and ranks of keys of any size, by a two-level scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from afterbell.sources.shared import written

#: Kind of a running value: its aggregate, how two are put together, and the value of no rows.
KINDS = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "count": (F.count, lambda a, b: a + b, 0),
    "product": (F.product, lambda a, b: a * b, 1.0),
    "max": (F.max, lambda a, b: F.greatest(a, b), None),  # greatest and least pass over NULL
    "min": (F.min, lambda a, b: F.least(a, b), None),
}


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Rows in ranges of (keys, order), written, with the range's number as ``_range``: a large key spans many, small keys share one.

    The order has to be total: rows that are equal in all of it would have no defined place.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = written(df, "unranged")  # bounds of ranges are drawn from a pass of their own: what is behind the rows is computed once
    return written(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """``rows`` of :func:`ranged` with a running value for each name: (kind, column), up to each row or before it.

    Inside a range a window runs as usual; each range has one summary row per key, and a running value of the summaries before
    is put together with the own one. So a task sorts one range, and a key's summaries are as many as its ranges.
    Before the first row sums and counts are 0, products 1, extremes NULL.

    Key and range are one struct, which is equal where keys are NULL too: window and join need the rows dealt by the same column, once. A
    null-safe join of each key would deal them anew, by other expressions.
    """
    rows, columns = rows.withColumn("_in", F.struct(*keys, "_range")), rows.columns
    inside = Window.partitionBy("_in").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = rows.withColumns({f"_own_{n}": KINDS[kind][0](c).over(inside) for n, (kind, c) in values.items()})
    summaries = rows.groupBy("_in").agg(*[KINDS[kind][0](c).alias(f"_all_{n}") for n, (kind, c) in values.items()])
    earlier = Window.partitionBy(*([F.col("_in")[k] for k in keys] or [F.lit(0)])).orderBy(F.col("_in")["_range"]).rowsBetween(Window.unboundedPreceding, -1)  # a key's ranges
    together = {"count": F.sum}
    before = summaries.select(F.col("_in").alias("_before"), *[together.get(kind, KINDS[kind][0])(f"_all_{n}").over(earlier).alias(f"_before_{n}") for n, (kind, _) in values.items()])

    def put(n: str, kind: str) -> Column:
        a, b = F.col(f"_before_{n}"), F.col(f"_own_{n}")
        none = KINDS[kind][2]
        return KINDS[kind][1](a, b) if none is None else KINDS[kind][1](F.coalesce(a, F.lit(none)), F.coalesce(b, F.lit(none)))

    return own.join(before, F.col("_in") == F.col("_before")).select(*[F.col(c) for c in columns], *[put(n, kind).alias(n) for n, (kind, _) in values.items()])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """:func:`ranged` and :func:`scan` in one."""
    return scan(ranged(df, keys, order), keys, order, values, inclusive).drop("_range")


def drawdown(df: DataFrame, net: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """equity (running product of 1 + net), peak (at least 1) and drawdown, per key in order; two scans over the same ranges."""
    rows = ranged(df, keys, order)
    rows = written(scan(rows, keys, order, {"equity": ("product", 1 + F.coalesce(F.col(net), F.lit(0.0)))}), "equity")
    rows = scan(rows, keys, order, {"peak": ("max", F.col("equity"))}).withColumn("peak", F.greatest("peak", F.lit(1.0)))
    return rows.withColumn("drawdown", F.col("equity") / F.col("peak") - 1).drop("_range")


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Rows with their number from 1 in an order over the whole table."""
    return running(df, [], order, {name: ("count", F.lit(1))})
