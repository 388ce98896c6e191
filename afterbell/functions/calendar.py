"""Trading days by rule, as a dimension table that other tables join by date."""

from __future__ import annotations

from datetime import date, timedelta

from dateutil.easter import easter
from dateutil.relativedelta import MO, TH, relativedelta
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def market_holidays(year: int) -> list[date]:
    """Full-day closures of the New York exchanges under today's rules; fixed dates on a weekend move to the nearest weekday."""

    def observed(month: int, day: int) -> date:
        d = date(year, month, day)
        return d + timedelta(days={5: -1, 6: 1}.get(d.weekday(), 0))

    def nth(month: int, weekday) -> date:
        return date(year, month, 1) + relativedelta(weekday=weekday)

    return sorted(
        {
            observed(1, 1), observed(6, 19), observed(7, 4), observed(12, 25), easter(year) - timedelta(days=2),
            nth(1, MO(3)), nth(2, MO(3)), nth(9, MO(1)), nth(11, TH(4)), date(year, 5, 31) + relativedelta(weekday=MO(-1)),
        }
    )


def calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Every date with is_trading, same_or_next, next_day and previous_day trading days. A few hundred rows a year."""
    holidays = [d for y in range(first_year, last_year + 1) for d in market_holidays(y)]
    days = spark.range(1).select(F.explode(F.sequence(F.lit(date(first_year, 1, 1)), F.lit(date(last_year, 12, 31)))).alias("day"))
    rows = days.withColumn("is_trading", (F.weekday("day") < 5) & ~F.col("day").isin(holidays))
    own = F.when(F.col("is_trading"), F.col("day"))
    w = Window.orderBy("day")  # one row per date
    ahead, after, behind = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("day", "is_trading", F.first(own, ignorenulls=True).over(ahead).alias("same_or_next"), F.first(own, ignorenulls=True).over(after).alias("next_day"), F.last(own, ignorenulls=True).over(behind).alias("previous_day"))


def to_eastern(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "America/New_York")


def timestamp_audit(events: DataFrame, cal: DataFrame, has_intraday_prices: bool = False) -> DataFrame:
    """Selected time, session, first tradable day, confidence and status of each event.

    events: acceptance_time and event_time (timestamps, exchange time), date_only (whether the
    selected time has no clock), reaction_start (date or NULL). The acceptance time counts before the
    event's. Status: ok, ambiguous, missing_timestamp, invalid_reaction_window (starts before the
    first tradable day).
    """
    selected = F.coalesce("acceptance_time", "event_time")
    rows = events.withColumns({"selected_time": selected, "time_source": F.when(F.col("acceptance_time").isNotNull(), "acceptance").when(F.col("event_time").isNotNull(), "event").otherwise("none")})
    minute = F.hour("selected_time") * 60 + F.minute("selected_time")
    session = F.when(F.col("selected_time").isNull(), "missing").when(F.col("date_only"), "ambiguous").when(minute < 570, "before_open").when(minute >= 960, "after_close").otherwise("intraday")
    rows = rows.withColumn("session", session).withColumn("_day", F.col("selected_time").cast("date"))
    joined = rows.join(F.broadcast(cal.withColumnRenamed("day", "_day")), "_day", "left")  # the calendar has a fixed size
    intraday = F.col("session") == "intraday"
    day = F.when(F.col("session") == "before_open", F.col("same_or_next")).when(intraday & F.lit(has_intraday_prices), F.col("_day")).otherwise(F.col("next_day"))
    base = F.when(F.col("time_source") == "acceptance", 0.95).otherwise(0.80)
    late = F.coalesce(F.col("reaction_start") < F.col("first_tradable"), F.lit(False))
    out = joined.withColumn("first_tradable", F.when(F.col("session") != "missing", day))
    status = F.when(F.col("session") == "missing", "missing_timestamp").when(late, "invalid_reaction_window")
    confidence = F.when(F.col("session") == "missing", 0.0).when(late, 0.10).when(F.col("session") == "ambiguous", 0.20)
    if has_intraday_prices:
        confidence = confidence.when(intraday, F.least(base, F.lit(0.75)))
    else:
        status, confidence = status.when(intraday, "ambiguous"), confidence.when(intraday, 0.40)
    status = status.when(F.col("session") == "ambiguous", "ambiguous").otherwise("ok")
    return out.withColumns({"status": status, "confidence": confidence.otherwise(base)}).drop("_day", "is_trading", "same_or_next", "next_day", "previous_day")
