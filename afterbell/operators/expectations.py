"""Expectations: surprise features, revisions, implied moves, context look-ups and the guidance bridge."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from afterbell.functions.exprs import count_known, direction, horizontal_mean, issues, labels_above, safe_pct_delta
from afterbell.operators.asof import asof_backward


def surprise_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Score from (actual, expected) pairs: mean of tanh(pct / 0.05) over the known ones, with direction and magnitude.

    Direction is that of the plain mean beyond +-0.005; magnitude is large from |score| .65, medium from .25.
    """
    pcts = [safe_pct_delta(F.col(a), F.col(e)) for a, e in pairs]
    score = horizontal_mean([F.tanh(p / 0.05) for p in pcts])
    mean = horizontal_mean(pcts)
    size = F.abs(score)
    return df.withColumns(
        {
            "surprise_score": score,
            "surprise_signals": count_known(pcts),
            "surprise_direction": direction(mean, 0.005, "positive", "negative", "mixed"),
            "surprise_magnitude": labels_above(size, ((0.65, "large"), (0.25, "medium")), "small"),
            "surprise_max_abs_pct": F.greatest(*[F.abs(p) for p in pcts]) if len(pcts) > 1 else F.abs(pcts[0]),
        }
    )


def leaks(expectations: DataFrame, events: DataFrame) -> DataFrame:
    """Expectations dated after their event, at which a run has to stop."""
    return expectations.join(events.select("event_id", "event_time"), "event_id").where(F.col("asof_time") > F.col("event_time"))


def raise_on_leaks(expectations: DataFrame, events: DataFrame) -> DataFrame:
    found = leaks(expectations, events).limit(5).collect()  # at most 5 rows
    if found:
        raise ValueError("expectations from after their event: " + ", ".join(str(r.event_id) for r in found))
    return expectations


def context_lookup(events: DataFrame, context: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Context of each event: the row that names the event, else the latest row of its ticker at or before the event.

    context: event_id (may be NULL), ticker, asof_date and the carried columns. Of several rows that
    name an event the latest counts. ``context_match`` says which kind was found.
    """
    exact = (
        context.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.max_by(F.struct(*carry), F.struct("asof_date", *carry)).alias("_exact"))
    )
    dated = context.where(F.col("asof_date").isNotNull()).groupBy("ticker", "asof_date").agg(F.max(F.struct(*carry)).alias("_dated"))
    found = asof_backward(events, dated, ["ticker"], F.col("event_time").cast("date"), F.col("asof_date"), ["_dated", "asof_date"])
    joined = found.join(exact, "event_id", "left")
    out = joined.select(
        *events.columns,
        *[F.when(F.col("_exact").isNotNull(), F.col("_exact")[c]).otherwise(F.col("_dated")[c]).alias(c) for c in carry],
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_dated").isNotNull(), "asof").otherwise("none").alias("context_match"),
    )
    return out


def revisions(events: DataFrame, estimates: DataFrame, window_days: int | Sequence[int] = 30, age_days: int = 370) -> DataFrame:
    """Analyst revisions before each event: latest estimate per (metric, analyst) now and ``window_days`` before.

    estimates: ticker, estimate_time, analyst_id, metric, estimate_value; event_id is the key of
    events. Several windows give rows for each, with window_days. Estimates and the different event times of a ticker
    are shuffled once; a task looks up each analyst's values by their place in the sorted times, so what grows with
    times and analysts is never shuffled.
    """
    windows = [window_days] if isinstance(window_days, int) else list(window_days)
    second = F.unix_timestamp("estimate_time").alias("_at")
    facts = estimates.where(F.col("estimate_time").isNotNull() & F.col("ticker").isNotNull()).groupBy("ticker", "metric", "analyst_id", second).agg(F.max_by("estimate_value", F.struct("estimate_time", "estimate_value")).alias("_v"))
    facts = facts.select("ticker", F.struct("metric", "analyst_id").alias("_series"), "metric", "_at", F.col("_v").cast("double").alias("_v"))
    times = events.where("event_time is not null and ticker is not null").select("ticker", F.unix_timestamp("event_time").alias("_at")).distinct()
    types = dict(facts.dtypes)
    schema = f"ticker {types['ticker']}, _second long, metric {types['metric']}, window_days int, analysts long, consensus double, matched long, revised long, mean_revision double, median_revision double, pct_up double, pct_down double, dispersion double"
    found = times.groupBy("ticker").cogroup(facts.groupBy("ticker")).applyInArrow(_revised(windows, age_days * 86400), schema)
    if isinstance(window_days, int):
        found = found.drop("window_days")
    asked = events.select("event_id", "ticker", F.unix_timestamp("event_time").alias("_second"))
    return asked.join(found, ["ticker", "_second"]).drop("ticker", "_second")


#: Times of a ticker that are looked up at once.
TIMES = 4_096


def _revised(windows: list[int], age: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A ticker's figures by event time, metric and window; estimates may be unknown, and analysts without one now are left out."""
    names = ["ticker", "_second", "metric", "window_days", "analysts", "consensus", "matched", "revised", "mean_revision", "median_revision", "pct_up", "pct_down", "dispersion"]

    def latest(at: np.ndarray, value: np.ndarray, when: np.ndarray, known_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last value up to each time, NaN without one; and whether it is young enough at ``known_by``."""
        place = np.searchsorted(at, when, side="right") - 1
        young = (place >= 0) & (known_by - at[place] <= age)
        return np.where(young, value[place], np.nan), young

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if not left.num_rows or not right.num_rows:
            left = left.slice(0, 0)
            right = right.slice(0, 0)
        when = np.sort(left.column("_at").to_numpy())
        order = pc.sort_indices(right, [("_at", "ascending")])
        right = right.take(order) if right.num_rows else right
        at, value = right.column("_at").to_numpy(), right.column("_v").to_numpy()
        code, series = {}, np.empty(right.num_rows, np.int64)
        for i, r in enumerate(right.column("_series").to_pylist()):
            series[i] = code.setdefault((r["metric"], r["analyst_id"]), len(code))
        metrics: dict[object, list[int]] = {}
        for (metric, _), c in code.items():
            metrics.setdefault(metric, []).append(c)
        rows = np.argsort(series, kind="stable")
        ends = np.searchsorted(series[rows], np.arange(len(code) + 1))
        own = [rows[ends[c] : ends[c + 1]] for c in range(len(code))]
        for low in range(0, len(when), TIMES):
            t = when[low : low + TIMES]
            for metric, codes in metrics.items():
                pairs = [latest(at[own[c]], value[own[c]], t, t) for c in codes]
                now, here = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
                now[~here] = np.nan
                n = here.sum(axis=0)
                for w in windows:
                    # an old value counts for what was known of it at the event
                    then = np.array([latest(at[own[c]], value[own[c]], t - w * 86400, t)[0] for c in codes])
                    then[~here] = np.nan
                    delta = now - then
                    both = ~np.isnan(then)
                    with np.errstate(all="ignore"), warnings.catch_warnings():
                        warnings.simplefilter("ignore", RuntimeWarning)  # of columns without a value
                        m, k = both.sum(axis=0), (~np.isnan(now)).sum(axis=0)
                        spread = np.where(n > 1, np.nanstd(now, axis=0, ddof=1), 0.0)
                        moved = (~np.isnan(delta)).sum(axis=0)
                        up, down = (delta > 0).sum(axis=0) / moved, (delta < 0).sum(axis=0) / moved
                        figures = (n, np.where(k > 0, np.nanmean(now, axis=0), np.nan), m, (np.abs(delta) > 1e-12).sum(axis=0), np.nanmean(delta, axis=0), np.nanmedian(delta, axis=0), up, down, spread)
                    told = n > 0
                    parts.append((t[told], [metric] * int(told.sum()), np.full(int(told.sum()), w, np.int32), *[f[told] for f in figures]))
        ticker = left.column("ticker") if left.num_rows else right.column("ticker")
        count = sum(len(p[0]) for p in parts)
        key = pa.array([ticker[0].as_py()] * count if count else [], ticker.type)
        joined = lambda i, kind, dtype: pa.array(np.concatenate([p[i] for p in parts]).astype(dtype) if parts else np.zeros(0, dtype), kind, from_pandas=True)  # noqa: E731  NaN is unknown
        kinds = [(pa.int64(), np.int64), None, (pa.int32(), np.int32), (pa.int64(), np.int64), (pa.float64(), float), (pa.int64(), np.int64), (pa.int64(), np.int64), *[(pa.float64(), float)] * 5]
        columns = [pa.array([m for p in parts for m in p[1]], right.column("metric").type) if k is None else joined(i, *k) for i, k in enumerate(kinds)]
        return pa.Table.from_arrays([key, *columns], names=names)

    return run


def _named_revisions(events: DataFrame, estimates: DataFrame, window_days: int, age_days: int) -> DataFrame:
    """:func:`revisions` of pools of few estimates, by as-of steps: one event and those that name it would make a group of its own for every event."""
    second = F.unix_timestamp("estimate_time").alias("_at")
    series = ["ticker", "metric", "analyst_id"]
    facts = estimates.groupBy(*series, second).agg(F.max_by("estimate_value", F.struct("estimate_time", "estimate_value")).alias("_v"))
    facts = facts.withColumnRenamed("_at", "_t")
    times = events.where("event_time is not null").select("ticker", F.unix_timestamp("event_time").alias("_second")).distinct()
    probes = times.join(facts.select(*series).distinct(), "ticker")
    late = asof_backward(probes, facts, series, F.col("_second"), F.col("_t"), ["_v", "_t"])
    late = late.where(F.col("_second") - F.col("_t") <= age_days * 86400).withColumnsRenamed({"_v": "_now", "_t": "_now_at"})
    both = asof_backward(late, facts, series, F.col("_second") - window_days * 86400, F.col("_t"), ["_v", "_t"])
    both = both.withColumn("_then", F.when(F.col("_second") - F.col("_t") <= age_days * 86400, F.col("_v")))
    delta = F.col("_now") - F.col("_then")
    matched = F.col("_then").isNotNull()
    found = both.groupBy("ticker", "_second", "metric").agg(
        F.count("*").alias("analysts"), F.avg("_now").alias("consensus"), F.sum(matched.cast("long")).alias("matched"),
        F.sum(F.coalesce(F.abs(delta) > 1e-12, F.lit(False)).cast("long")).alias("revised"),
        F.avg(delta).alias("mean_revision"), F.median(delta).alias("median_revision"), F.avg(F.when(matched, (delta > 0).cast("double"))).alias("pct_up"), F.avg(F.when(matched, (delta < 0).cast("double"))).alias("pct_down"),
        F.when(F.count("*") > 1, F.stddev_samp("_now")).otherwise(0.0).alias("dispersion"),
    )
    asked = events.select("event_id", "ticker", F.unix_timestamp("event_time").alias("_second"))
    return asked.join(found, ["ticker", "_second"]).drop("ticker", "_second")


def revision_features(events: DataFrame, estimates: DataFrame, metrics: Sequence[str], windows: Sequence[int] = (7, 30), age_days: int = 370) -> DataFrame:
    """:func:`revisions` over several windows, with estimates that name an event, medians, and a row for each event that has none.

    An event that estimates of its ticker name by event_id has these alone, others have all of their
    ticker. Columns: event_id, status (ok or skipped), reason, metric, window_days and the figures of
    revisions, with consensus and median_revision.
    """
    named = estimates.where(F.col("event_id").isNotNull()).select(F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("_pool"), "ticker", "event_id").distinct()
    own = named.select("event_id", "ticker", F.col("_pool").alias("_own"))
    asked = events.select("event_id", "ticker", "event_time").join(own, ["event_id", "ticker"], "left")
    asked = asked.select("event_id", F.coalesce("_own", F.concat(F.lit("ticker "), F.col("ticker").cast("string"))).alias("ticker"), "event_time")
    pools = F.array_compact(F.array(F.concat(F.lit("ticker "), F.col("ticker").cast("string")), F.concat(F.lit("event "), F.col("event_id").cast("string"))))
    dealt = estimates.withColumn("ticker", F.explode(pools)).withColumn("analyst_id", F.coalesce(F.col("analyst_id").cast("string"), F.lit("unknown")))
    wanted = dealt.where(F.col("metric").isin(*metrics) & F.col("estimate_time").isNotNull() & F.col("estimate_value").isNotNull())
    by_name = F.col("ticker").startswith("event ")
    found = revisions(asked.where(~by_name), wanted.where(~by_name), list(windows), age_days)
    for w in windows:
        found = found.unionByName(_named_revisions(asked.where(by_name), wanted.where(by_name), w, age_days).withColumn("window_days", F.lit(w)))
    any_of = asof_backward(
        asked, dealt.where(F.col("estimate_time").isNotNull()).select("ticker", F.col("estimate_time").alias("_any")).distinct(), ["ticker"], F.col("event_time"), F.col("_any"), ["_any"]
    ).select("event_id", (F.unix_timestamp("event_time") - F.unix_timestamp("_any") <= age_days * 86400).alias("_any"))
    joined = any_of.join(found, "event_id", "left")
    ok = F.col("metric").isNotNull()
    reason = F.when(ok, "").when(F.coalesce("_any", F.lit(False)), "no requested metric estimates").otherwise("no pre-event estimates")
    return joined.select("event_id", F.when(ok, "ok").otherwise("skipped").alias("status"), reason.alias("reason"), *[c for c in found.columns if c != "event_id"])


def implied_moves(events: DataFrame, quotes: DataFrame, max_age_days: int = 14) -> DataFrame:
    """At-the-money straddle of each event: (call + put) / spot of the best valid quote.

    Valid: quoted at or before the event and within ``max_age_days``, not expired, spot above 0,
    prices not negative. Best: fewest days to expiry, nearest strike, youngest. The best quote of each
    second and expiration meets the different event times of its ticker in buckets of ``max_age_days``.
    """
    call = F.coalesce("call_mid", (F.col("call_bid") + F.col("call_ask")) / 2)
    put = F.coalesce("put_mid", (F.col("put_bid") + F.col("put_ask")) / 2)
    day = F.col("event_time").cast("date")
    miss = F.abs(F.col("strike") - F.col("underlying_price")) / F.col("underlying_price")
    width = max_age_days * 86400
    priced = quotes.withColumns({"_call": call, "_put": put}).where((F.col("_call") >= 0) & (F.col("_put") >= 0) & (F.col("underlying_price") > 0))
    offers = priced.groupBy("ticker", F.unix_timestamp("quote_time").alias("_quoted"), "expiration").agg(F.min(F.struct(miss.alias("miss"), "strike", "_call", "_put", "underlying_price")).alias("o"))
    offers = offers.withColumn("_bucket", F.floor(F.col("_quoted") / width))
    times = events.select("ticker", "event_time").distinct()
    bucket = F.floor(F.unix_timestamp("event_time") / width)
    rows = times.withColumn("_bucket", F.explode(F.array(bucket, bucket - 1))).join(offers, ["ticker", "_bucket"])
    rows = rows.withColumns({"_age": F.unix_timestamp("event_time") - F.col("_quoted"), "days_to_expiration": F.date_diff("expiration", day)})
    valid = (F.col("_age") >= 0) & (F.col("_age") <= width) & (F.col("days_to_expiration") >= 0)
    found = rows.where(valid).groupBy("ticker", "event_time").agg(
        F.min(F.struct("days_to_expiration", "o.miss", "_age", "o.strike", "o._call", "o._put", "o.underlying_price")).alias("b")
    )
    best = events.select("event_id", "ticker", "event_time").join(found, ["ticker", "event_time"])
    return best.select("event_id", "b.days_to_expiration", "b.strike", ((F.col("b._call") + F.col("b._put")) / F.col("b.underlying_price")).alias("implied_move"))


def guidance_bridge(events: DataFrame, least_gap: int = 45, largest_gap: int = 190) -> DataFrame:
    """Actual revenue against the guidance of the ticker's previous event, with a status for each row.

    events: event_id, ticker, event_time, actual_revenue, guidance. The previous row counts whatever
    its own state is. Status in this order: bad_timestamp, missing_actual_revenue,
    missing_prior_guidance, duplicate_or_same_day_event, prior_event_gap_too_short, ..._too_long,
    ambiguous (ratio outside .5 to 1.75), ready.
    """
    w = Window.partitionBy("ticker").orderBy("event_time", "event_id")
    rows = events.withColumn("prior_guidance", F.lag("guidance").over(w)).withColumn("_prior", F.lag("event_time").over(w))
    gap = F.date_diff(F.col("event_time").cast("date"), F.col("_prior").cast("date"))
    ratio = F.try_divide(F.col("actual_revenue"), F.col("prior_guidance"))
    status = (
        F.when(F.col("event_time").isNull(), "bad_timestamp").when(F.col("actual_revenue").isNull(), "missing_actual_revenue").when(F.col("prior_guidance").isNull(), "missing_prior_guidance")
        .when(gap == 0, "duplicate_or_same_day_event").when(gap < least_gap, "prior_event_gap_too_short").when(gap > largest_gap, "prior_event_gap_too_long")
        .when(~ratio.between(0.5, 1.75), "ambiguous").otherwise("ready")
    )
    surprise = ratio - 1
    rows = rows.withColumns({"gap_days": gap, "ratio": ratio, "status": status})
    ready = F.col("status") == "ready"
    rank = (F.rank().over(Window.partitionBy("ticker", ready).orderBy(F.round(ratio, 9))) + (F.count("*").over(Window.partitionBy("ticker", ready, F.round(ratio, 9))) - 1) / 2) / F.count("*").over(Window.partitionBy("ticker", ready))
    return rows.withColumns(
        {
            "guidance_direction": F.when(ready, direction(surprise, 0.02)),
            "guidance_magnitude": F.when(ready, labels_above(F.abs(surprise), ((0.10, "large"), (0.04, "medium"), (0.02, "small")), "none")),
            "surprise_rank": F.when(ready, rank),
        }
    ).drop("_prior")


def timestamp_readiness(df: DataFrame) -> DataFrame:
    """Row rules on event_time and release_session: status ok, warn or fail, with the issues, and whether a row only explains."""
    t = F.col("event_time")
    midnight = (F.hour(t) == 0) & (F.minute(t) == 0)
    session = F.coalesce(F.lower(F.trim("release_session")), F.lit("unknown"))
    found = issues(
        (t.isNull(), "missing_event_time"),
        (midnight & (session != "before_open"), "date_only_time"),
        (session == "unknown", "unknown_session"),
        (F.dayofweek(t).isin(1, 7), "weekend_event"),
    )
    status = F.when(t.isNull(), "fail").when(F.size(found) > 0, "warn").otherwise("ok")
    return df.withColumn("timestamp_issues", F.array_join(found, ";")).withColumn("timestamp_status", status).withColumn("explanatory_only", F.col("timestamp_status") != "ok")


def amendment_chains(filings: DataFrame) -> DataFrame:
    """Each amendment (form ends in /A) with the latest earlier original of its issuer: same item first, then same type, then latest.

    Filings: accession, cik, form, accepted_at, item (several are parted by ``;``), event_type. Confidence
    .92 with an item number, .85 without, 0 without an original. Each preference is an as-of step by its own key.
    """
    is_amendment = F.col("form").endswith("/A")
    item = F.nullif(F.trim("item"), F.lit(""))
    probes = filings.where(is_amendment).select("accession", "cik", "accepted_at", item.alias("item"), "event_type")
    originals = filings.where(~is_amendment & F.col("accepted_at").isNotNull()).select("accession", "cik", "accepted_at", F.explode_outer(F.split("item", r"\s*;\s*")).alias("_item"), F.col("event_type").alias("_type"))
    out = probes
    for i, keys in enumerate((("_item", "_type"), ("_item",), ("_type",), ())):
        facts = originals.groupBy("cik", *keys, F.col("accepted_at").alias("_at")).agg(F.max("accession").alias(f"_id{i}"))
        for k in keys:
            facts = facts.where(F.col(k).isNotNull())
        asked = out.withColumnsRenamed({"item": "_item", "event_type": "_type"})
        out = asof_backward(asked, facts.withColumn(f"_at{i}", F.col("_at")), ["cik", *keys], F.col("accepted_at"), F.col("_at"), [f"_id{i}", f"_at{i}"], strict=True)
        out = out.withColumnsRenamed({"_item": "item", "_type": "event_type"})
    best, at = F.coalesce(*[F.col(f"_id{i}") for i in range(4)]), F.coalesce(*[F.col(f"_at{i}") for i in range(4)])
    days = (F.unix_timestamp("accepted_at") - F.unix_timestamp(at)) / 86400
    return out.select(
        F.col("accession").alias("amendment"), best.alias("original"), F.round(days, 4).alias("days_after"), F.when(best.isNull(), 0.0).when(F.col("item").isNotNull(), 0.92).otherwise(0.85).alias("confidence")
    )


def amendment_flags(filings: DataFrame, chains: DataFrame) -> DataFrame:
    """Originals with whether, how often and how soon they were amended."""
    per = chains.where(F.col("original").isNotNull()).groupBy(F.col("original").alias("accession")).agg(F.count("*").alias("amendments"), F.min("days_after").alias("first_after"))
    joined = filings.join(per, "accession", "left")
    return joined.withColumn("amended_later", F.col("amendments").isNotNull()).withColumn("amendments", F.coalesce("amendments", F.lit(0)))


def duplicate_audit(df: DataFrame, key: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """Group size, place, canonical row and duplicate status by a key of expressions."""
    named = df.withColumn("duplicate_key", F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]))
    w = Window.partitionBy("duplicate_key")
    place = F.row_number().over(w.orderBy(*order))
    return named.withColumns(
        {
            "duplicate_count": F.count("*").over(w), "duplicate_place": place, "canonical": F.first(order[-1]).over(w.orderBy(*order)),
        }
    ).withColumn("duplicate_status", F.when(F.col("duplicate_count") == 1, "clear").when(F.col("duplicate_place") == 1, "primary").otherwise("duplicate"))


def occurrence_suffix(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Repeated ids made unique: the second becomes ``id__dup2``."""
    k = F.row_number().over(Window.partitionBy(column).orderBy(*order))
    return df.withColumn(column, F.when(k > 1, F.concat(F.col(column).cast("string"), F.lit("__dup"), k.cast("string"))).otherwise(F.col(column).cast("string")))
