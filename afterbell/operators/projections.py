"""Derived columns, merges and small joins around the event table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from afterbell.functions.exprs import blank_to_null, issues, labels_above, norm
from afterbell.operators.asof import asof_forward


def rename_aliases(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Copies of source columns under their known names, where these aren't there yet; repeated column names keep their first."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        seen[c] = seen.get(c, 0) + 1
        names.append(c if seen[c] == 1 else f"_again{seen[c]}_{c}")
    out = df.toDF(*names)
    out = out.drop(*[n for n in names if n.startswith("_again")])
    for source, target in aliases.items():
        if source in out.columns and target not in out.columns:
            out = out.withColumn(target, F.col(source))
    return out


def merge_release_times(events: DataFrame, exact: DataFrame, require: bool = False) -> DataFrame:
    """Events with their exact release time and session where one is known; ``require`` raises if an event has none."""
    side = exact.groupBy("event_id").agg(F.max_by(F.struct("exact_release_time", "release_session"), "exact_release_time").alias("_x"))
    joined = events.join(side, "event_id", "left")
    if require:
        lost = joined.where(F.col("_x").isNull()).select("event_id").limit(5).collect()  # at most five rows
        if lost:
            raise ValueError(f"events without an exact release time: {[r[0] for r in lost]}")
    return joined.withColumns(
        {
            "event_time": F.coalesce(F.col("_x.exact_release_time"), F.col("event_time")),
            "release_session": F.coalesce(blank_to_null(F.col("_x.release_session"), ("unknown",)), F.col("release_session")),
            "release_time_exact": F.col("_x").isNotNull(),
        }
    ).drop("_x")


def surprise_labels(pct: Column) -> Column:
    """Struct of expectedness and magnitude at .02, .08 and .20."""
    size = F.abs(pct)
    return F.struct(
        F.when(pct.isNull(), "unknown").when(size < 0.02, "expected").otherwise("unexpected").alias("expectedness"),
        labels_above(size, ((0.20, "large"), (0.08, "medium"), (0.02, "small")), "none").alias("magnitude"),
    )


def best_amount(candidates: Sequence[tuple[str, Column]]) -> Column:
    """Struct of the first positive amount in order of precedence and its name."""
    first = F.coalesce(*[F.when(c > 0, F.struct(c.cast("double").alias("amount"), F.lit(n).alias("source"))) for n, c in candidates])
    return F.coalesce(first, F.struct(F.lit(None).cast("double").alias("amount"), F.lit("none").alias("source")))


def link_mentions(events: DataFrame, links: DataFrame) -> DataFrame:
    """Links of an event with what of it their text mentions: ticker, amount, agency, keyword; confidence by the number of kinds.

    events: event_id, ticker, amount_token, agency, keywords (array). links: event_id, link_text.
    """
    text = F.lower(F.col("link_text"))
    said = lambda c: F.coalesce(text.contains(F.lower(c)) & (F.trim(c) != ""), F.lit(False))
    joined = events.join(links, "event_id")
    kinds = issues((said(F.col("ticker")), "ticker"), (said(F.col("amount_token")), "amount"), (said(F.col("agency")), "agency"), (F.exists("keywords", lambda k: text.contains(F.lower(k))), "keyword"))
    out = joined.withColumn("mentions", F.array_join(kinds, ";"))
    n = F.size(kinds)
    return out.withColumn("link_confidence", F.when(n >= 3, 0.9).when(n == 2, 0.7).when(n == 1, 0.4).otherwise(0.0))


def priority(parts: Mapping[str, tuple[Column, float]], clip: float = 0.25) -> Column:
    """Weighted sum of parts, each clipped to ``clip``."""
    return sum((F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) * w, F.lit(clip)) for c, w in parts.values()), F.lit(0.0))


def source_groups(docs: DataFrame) -> DataFrame:
    """Sources per event: number, sorted distinct types, first time of the official ones, distinct hashes."""
    return docs.groupBy("event_id").agg(
        F.count("*").alias("sources"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("source_types"),
        F.min(F.when(F.col("official"), F.col("published_at"))).alias("first_official"), F.count_distinct("content_hash").alias("distinct_contents"),
    )


def modal_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key (ties: the lesser), its share, and the median of its lengths."""
    per = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return per.groupBy(key).agg(F.min_by(value, F.struct((-F.col("_n")).alias("a"), F.col(value).alias("b"))).alias("modal"), F.max("_n").alias("modal_count"), F.sum("_n").alias("n"))


def next_open_frame(events: DataFrame, bars: DataFrame, hold: int = 3) -> DataFrame:
    """Entry at the first bar after an intraday or after-close release (on the day itself before the open), exit ``hold`` bars on."""
    w = Window.partitionBy("ticker").orderBy("d")
    rows = bars.select("ticker", "d", F.col("price").alias("entry_price"), F.lead("price", hold).over(w).alias("exit_price"), F.lead("d", hold).over(w).alias("exit_day"))
    probes = events.withColumn("_day", F.col("event_time").cast("date"))
    out = asof_forward(probes, rows, ["ticker"], F.col("_day"), F.col("d"), ["d", "entry_price", "exit_price", "exit_day"], strict=F.col("release_session") != "before_open")
    return out.withColumnRenamed("d", "entry_day").withColumn("trade_return", F.try_divide(F.col("exit_price"), F.col("entry_price")) - 1).drop("_day")


def last_per_key(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def event_review_queue(events: DataFrame, counts: DataFrame, least_facts: int = 3, least_confidence: float = 0.8) -> DataFrame:
    """Events with evidence status, automatic acceptance and priority. counts: fact_count, evidence_count, mean_confidence per event."""
    j = events.join(counts, "event_id", "left").fillna({"fact_count": 0, "evidence_count": 0})
    evidence = F.when(F.col("evidence_count") == 0, "missing").when(F.col("evidence_count") < F.col("fact_count"), "partial").otherwise("complete")
    auto = (F.col("evidence_count") > 0) & (F.col("fact_count") >= least_facts) & F.coalesce(F.col("mean_confidence") >= least_confidence, F.lit(False))
    return j.withColumns(
        {"evidence_status": evidence, "review_status": F.when(auto, "auto_accepted").otherwise("needs_review"), "review_priority": F.when(auto, "low").when(F.col("evidence_count") == 0, "high").otherwise("medium")}
    )


def feature_availability(df: DataFrame, numeric: Sequence[str], risky: Sequence[str] = ()) -> DataFrame:
    """One row per numeric feature: known values, whether it is used (some known, not risky). One pass over the data."""
    counts = df.agg(*[F.count(c).alias(c) for c in numeric], F.count("*").alias("_all"))
    long = counts.select("_all", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("known")) for c in numeric])).alias("x")).select("x.*", F.col("_all").alias("rows"))
    return long.withColumn("used", (F.col("known") > 0) & ~F.col("feature").isin(*risky) if risky else F.col("known") > 0)


def fiscal_quarter_before(period: Column) -> Column:
    """``2024Q1`` becomes ``2023Q4``; NULL for other texts."""
    year, quarter = F.regexp_extract(period, r"^(\d{4})Q([1-4])$", 1), F.regexp_extract(period, r"^(\d{4})Q([1-4])$", 2)
    y, q = year.try_cast("int"), quarter.try_cast("int")
    return F.when(q == 1, F.concat((y - 1).cast("string"), F.lit("Q4"))).when(q > 1, F.concat(year, F.lit("Q"), (q - 1).cast("string")))


def raw_session(raw: Column) -> Column:
    """Session of a raw time text: a date without a clock is ambiguous, an unreadable text missing."""
    ts = F.try_to_timestamp(raw)
    minute = F.hour(ts) * 60 + F.minute(ts)
    return F.when(ts.isNull(), "missing").when(raw.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$"), "ambiguous").when(minute < 570, "before_open").when(minute >= 960, "after_close").otherwise("intraday")


def role_facts(segments: DataFrame) -> DataFrame:
    """Facts by the words of a segment: metric (revenue, eps, margin) and role (consensus, guidance, forward, actual), with the first number.

    Confidence is .6, more with a role word and with a unit, at most .95.
    """
    low = F.lower(F.col("segment"))
    metric = F.when(low.rlike(r"revenue|sales"), "revenue").when(low.rlike(r"\beps\b|per share"), "eps").when(low.rlike("margin"), "gross_margin")
    role = F.when(low.rlike("consensus|expected by analysts"), "consensus").when(low.rlike("guidance|outlook|expects"), "guidance").when(low.rlike("next year|long-term"), "forward").otherwise("actual")
    number = F.regexp_extract(F.col("segment"), r"([0-9]+(?:\.[0-9]+)?)", 1)
    unit = F.when(low.rlike("million|billion"), "usd").when(low.contains("%"), "fraction").otherwise("none")
    value = number.try_cast("double") * F.when(low.contains("billion"), 1e9).when(low.contains("million"), 1e6).when(low.contains("%"), 0.01).otherwise(1.0)
    confidence = F.least(0.6 + F.when(role != "actual", 0.15).otherwise(0.0) + F.when(unit != "none", 0.15).otherwise(0.0), F.lit(0.95))
    prior_dated = low.rlike("previously announced|prior offering|as of the date of")
    return segments.where(metric.isNotNull() & (number != "") & ~prior_dated).select("*", F.concat_ws("_", metric, role).alias("fact_name"), value.alias("value"), unit.alias("unit"), confidence.alias("confidence"))


def scalar_fields(text: Column) -> dict[str, Column]:
    """Single values that documents state: ownership percent, shares, trial id, p-value, vote."""
    t = F.lower(text)
    number = lambda pattern: F.regexp_replace(F.regexp_extract(t, pattern, 1), ",", "").try_cast("double")
    return {
        "ownership_pct": number(r"([0-9]+(?:\.[0-9]+)?)\s?% of (?:the )?(?:outstanding|common|shares)") / 100,
        "shares_owned": number(r"([0-9][0-9,]*) shares"),
        "trial_id": F.nullif(F.upper(F.regexp_extract(t, r"(nct[0-9]{8})", 1)), F.lit("")),
        "p_value": number(r"p\s?[<=]\s?(0?\.[0-9]+)"),
        "votes_for": number(r"voted ([0-9]+) to [0-9]+"),
    }


def compare_controls(main: DataFrame, controls: DataFrame, value: str, least: int = 20) -> DataFrame:
    """Mean of the events against that of each control kind: difference, ratio of sizes, and whether the events stand out."""
    m = main.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    c = controls.where(F.col(value).isNotNull()).groupBy("control").agg(F.count("*").alias("control_n"), F.avg(value).alias("control_mean"))
    joined = c.join(F.broadcast(m))  # one row
    stands = (F.col("n") >= least) & (F.col("control_n") >= least) & (F.abs(F.col("mean")) > 2 * F.abs(F.col("control_mean")))
    return joined.withColumn("difference", F.col("mean") - F.col("control_mean")).withColumn("verdict", F.when(stands, "distinct").when((F.col("n") < least) | (F.col("control_n") < least), "too_few").otherwise("not_distinct"))


def normalised_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: norm(F.col(c)) for c in columns})
