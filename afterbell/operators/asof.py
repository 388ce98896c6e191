"""As-of joins by union and window: one sort per key, no Cartesian product, no broadcast of bars.

All helpers take ``facts`` (the dated side) and ``probes`` (the asking side) and a key. Keys that
hold most rows make long window partitions, so ``facts`` should be at a keyed grain (ticker, date);
within a partition Spark spills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SIDE, _AT, _FACT, _FOUND = "_side", "_at", "_fact_", "_found_"


def _merged(probes: DataFrame, facts: DataFrame, key: Sequence[str], probe_at: Column, fact_at: Column, carry: Sequence[str]) -> DataFrame:
    """Both sides under one schema: key, time, side (0 probe, 1 fact), the fact's columns or the probe's.

    Each side is dealt by key before the union, which keeps that for the window after it. A side that is dealt by key already, as
    facts out of a window are, stays where it is; dealt after the union, all of its rows would be shuffled again. A fact's columns are
    apart, so that those that nobody reads are dropped in front of the sort.
    """
    own = F.struct(*[F.col(c) for c in probes.columns])
    p = probes.select(*key, probe_at.alias(_AT), F.lit(0).alias(_SIDE), *[F.lit(None).cast(facts.schema[c].dataType).alias(_FACT + c) for c in carry], own.alias("_probe"))
    f = facts.select(*key, fact_at.alias(_AT), F.lit(1).alias(_SIDE), *[F.col(c).alias(_FACT + c) for c in carry], F.lit(None).cast(probes.select(own.alias("x")).schema[0].dataType).alias("_probe"))
    f = f.where(F.col(_AT).isNotNull())
    return p.repartition(*key).unionByName(f.repartition(*key)) if key else p.unionByName(f)


def _last_fact(c: str) -> Column:
    """A column of the last fact so far, which may be NULL in it: hence in a struct, which is NULL for probes only."""
    return F.last(F.when(F.col(_SIDE) == 1, F.struct(F.col(_FACT + c).alias("v"))), ignorenulls=True)


def asof_forward(
    probes: DataFrame, facts: DataFrame, key: Sequence[str], probe_at: Column, fact_at: Column, carry: Sequence[str], strict: Column | bool = False, known: str | None = None
) -> DataFrame:
    """Each probe with the first fact at or after its time (after it where ``strict``); NULLs if there is none or the probe has no time.

    ``known`` names a column that says whether the key has any fact, from the same partitions.
    """
    order = _tie(strict, probe_first=True)
    merged = _merged(probes.withColumn("_strict", F.lit(strict) if isinstance(strict, bool) else strict), facts, key, probe_at, fact_at, carry)
    # from the last row back to the first: a running value, where a frame up to the end would be read anew for each row
    w = Window.partitionBy(*key).orderBy(F.desc(_AT), order.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _result(merged.withColumns({_FOUND + c: F.when(F.col(_AT).isNotNull(), _last_fact(c).over(w)) for c in carry}), probes, carry, key, known)


def asof_backward(
    probes: DataFrame, facts: DataFrame, key: Sequence[str], probe_at: Column, fact_at: Column, carry: Sequence[str], strict: Column | bool = False
) -> DataFrame:
    """Each probe with the last fact at or before its time (before it where ``strict``); NULLs if there is none."""
    order = _tie(strict, probe_first=False)
    merged = _merged(probes.withColumn("_strict", F.lit(strict) if isinstance(strict, bool) else strict), facts, key, probe_at, fact_at, carry)
    w = Window.partitionBy(*key).orderBy(_AT, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _result(merged.withColumns({_FOUND + c: _last_fact(c).over(w) for c in carry}), probes, carry)


def _tie(strict: Column | bool, probe_first: bool) -> Column:
    """Place among equal times: facts 1; probes on the near side (0 or 2), strict probes on the far one."""
    near, far = (0, 2) if probe_first else (2, 0)
    return F.when(F.col(_SIDE) == 1, 1).when(F.col("_probe._strict"), far).otherwise(near)


def _result(merged: DataFrame, probes: DataFrame, carry: Sequence[str], key: Sequence[str] = (), known: str | None = None) -> DataFrame:
    columns = [F.col("_probe")[c].alias(c) for c in probes.columns] + [F.col(_FOUND + c)["v"].alias(c) for c in carry]
    if known:
        merged = merged.withColumn("_known", F.max(_SIDE).over(Window.partitionBy(*key)) == 1)
        columns.append(F.col("_known").alias(known))
    return merged.where(F.col(_SIDE) == 0).select(*columns)


def nearest_ranked(probes: DataFrame, facts: DataFrame, on: Column, probe_id: Sequence[str], ranking: Sequence[Column], carry: Sequence[str]) -> DataFrame:
    """Each probe with the fact of least ranking among those that ``on`` admits; ``on`` must hold an equality so that the join is hashed.

    Probes without an admitted fact keep NULLs.
    """
    joined = probes.join(facts, on, "left")
    w = Window.partitionBy(*[probes[c] for c in probe_id]).orderBy(*ranking)
    return joined.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select(*[probes[c] for c in probes.columns], *[facts[c] for c in carry])
