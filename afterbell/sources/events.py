"""The event table: scan with validation, defaults and normalisation; templates; universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.functions.exprs import norm

REQUIRED = ("event_id", "ticker", "event_time", "event_type", "summary")
SESSIONS = ("before_open", "intraday", "after_close", "unknown")
#: Optional columns and their defaults.
OPTIONAL = {
    "event_subtype": "unknown", "event_family": "unknown", "source_type": "unknown", "source_url": "", "release_session": "unknown", "expectedness": "unknown",
    "surprise_direction": "unknown", "surprise_magnitude": "unknown", "sector_benchmark": "", "notes": "",
}


def load_events(raw: DataFrame) -> DataFrame:
    """Validated events: required columns, unique ids, times that parse, known sessions; categories in lower case.

    Further columns pass through. Anything invalid raises with up to five examples.
    """
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"events lack the columns {missing}")
    df = raw
    for c, default in OPTIONAL.items():
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in df.columns else F.lit(default))
    df = df.withColumn("materiality", F.least(F.greatest(F.coalesce(F.col("materiality").try_cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0)) if "materiality" in df.columns else F.lit(0.5))
    df = df.withColumns({"_raw_time": F.col("event_time").cast("string"), "event_time": F.try_to_timestamp(F.col("event_time").cast("string"))})
    for c in ("event_type", "event_subtype", "event_family", "source_type", "release_session", "expectedness", "surprise_direction", "surprise_magnitude"):
        df = df.withColumn(c, norm(F.col(c)))
    df = df.withColumn("ticker", F.upper(F.trim("ticker")))

    def stop(bad: DataFrame, what: str) -> None:
        found = bad.limit(5).collect()  # at most five rows
        if found:
            raise ValueError(f"{what}: {[r[0] for r in found]}")

    stop(df.groupBy("event_id").count().where("count > 1").select("event_id"), "repeated event_id")
    stop(df.where(F.col("event_time").isNull()).select("_raw_time"), "event_time that can't be read")
    stop(df.where(~F.col("release_session").isin(*SESSIONS)).select("release_session"), "unknown release_session")
    return df.drop("_raw_time")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return load_events(spark.read.options(header=True, multiLine=True, escape='"').csv(path))


def ticker_universe(events: DataFrame, benchmark: str) -> DataFrame:
    """Distinct tickers, sector benchmarks and the benchmark; blanks aside."""
    every = events.select("ticker").unionAll(events.select(F.col("sector_benchmark"))).unionAll(events.sparkSession.createDataFrame([(benchmark,)], "ticker string"))
    return every.where(F.trim("ticker") != "").distinct()


def template(events: DataFrame, columns: dict[str, str], each: list[str] | None = None, name: str = "metric") -> DataFrame:
    """A table to fill in: one row per event (times each of the given values), with typed empty columns."""
    rows = events.select("event_id", "ticker")
    if each:
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in each])))
    return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items()])
