"""Audits of duplicates by domain, triage of failed facts, sector-adjusted targets and projections of features to events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from afterbell.functions.domains import financing_slice, triage_reason
from afterbell.functions.exprs import direction, log_to_simple


def _said(c: str, case: str = "") -> Column:
    text = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.upper(text) if case == "upper" else F.lower(text) if case == "lower" else text


def _number(c: str) -> Column:
    number = F.col(c).cast("double")
    return F.when(number.isNotNull(), F.format_string("%.4f", number)).otherwise("")


def duplicate_keys() -> dict[str, Column]:
    """Key of each domain's duplicate audit, over columns of these names."""
    accession = F.nullif(_said("accession"), F.lit(""))
    return {
        "insider": F.concat_ws("|", _said("ticker", "upper"), _said("owner", "lower"), _said("transaction_date"), _said("code", "upper"), _number("shares"), _number("price")),
        "deal": F.concat_ws("|", _said("target", "upper"), _said("acquirer", "upper"), _said("event_type"), _said("event_date"), _number("price")),
        "ownership": F.concat_ws("|", _said("ticker", "upper"), _said("owner", "lower"), _said("filing_type"), _said("source_url", "lower")),
        "accounting": F.coalesce(accession, F.concat_ws("|", _said("ticker", "upper"), _said("item"), _said("periods"), _said("event_date"))),
        "incident": F.concat_ws("|", _said("ticker", "upper"), _said("discovered"), _said("determined"), _said("source_url", "lower")),
        "trial": F.concat_ws("|", _said("ticker", "upper"), _said("reaction_date"), _said("event_type"), F.coalesce(*[F.nullif(_said(c, "lower"), F.lit("")) for c in ("asset", "trial_id", "indication")], F.lit(""))),
    }


def domain_duplicates(events: DataFrame, domain: str, order: Sequence[str], amended: Column | None = None, excluded: Column | None = None) -> DataFrame:
    """Events with duplicate_key, group size, canonical id (first by ``order``, which ends with event_id), status, risk and whether to count the row.

    A key that says nothing makes no duplicates. ``amended``: rows whose duplicates are of high risk.
    ``excluded``: rows that never count (known before, hard negatives).
    """
    keyed = events.withColumn("duplicate_key", duplicate_keys()[domain])
    blank = F.regexp_replace("duplicate_key", r"\|", "") == ""
    group = F.when(blank, F.concat(F.lit("own "), F.col("event_id").cast("string"))).otherwise(F.col("duplicate_key"))
    w = Window.partitionBy("_group")
    rows = keyed.withColumn("_group", group).withColumns(
        {"duplicate_count": F.count("*").over(w), "canonical_event_id": F.first("event_id").over(w.orderBy(*order)), "_place": F.row_number().over(w.orderBy(*order))}
    )
    many = F.col("duplicate_count") > 1
    status = F.when(~many, "clear").when(F.col("_place") == 1, "primary").otherwise("duplicate")
    risk = F.when(many & F.coalesce(amended, F.lit(False)), "high").when(many, "medium").otherwise("low") if amended is not None else F.when(many, "medium").otherwise("low")
    counts = (F.col("_place") == 1) & ~(F.coalesce(excluded, F.lit(False)) if excluded is not None else F.lit(False))
    return rows.withColumns({"duplicate_status": status, "duplicate_risk": risk, "counts_once": counts}).drop("_group", "_place")


def triage(errors: DataFrame) -> DataFrame:
    """Failures by reason, fact and slice, each of them alone and all together, in one pass.

    errors: status, fact_name, evidence_text, event_type, security_type.
    """
    rows = errors.select(
        triage_reason(F.col("status"), F.col("fact_name"), F.col("evidence_text")).alias("reason"), "fact_name",
        financing_slice(F.col("event_type"), F.col("security_type"), F.col("fact_name")).alias("slice"),
    ).where("reason <> ''")
    sets = [[F.col("reason")], [F.col("fact_name")], [F.col("slice")], [F.col("reason"), F.col("fact_name"), F.col("slice")]]
    grouped = rows.groupingSets(sets, "reason", "fact_name", "slice").agg(F.grouping_id().alias("_g"), F.count("*").alias("failures"))
    level = F.element_at(F.create_map(*[F.lit(x) for pair in ((3, "reason"), (5, "fact"), (6, "slice"), (0, "all")) for x in pair]), F.col("_g").cast("int"))
    return grouped.select(level.alias("level"), "reason", "fact_name", "slice", "failures")


def sector_targets(study: DataFrame, sector: DataFrame, horizons: Sequence[int] = (1, 3, 10), band: float = 0.002) -> DataFrame:
    """The study with its returns less those of the sector: car_sector_h, its simple form, target_positive_sector_h and target_direction_sector_h.

    sector: event_id and sector_h, the sector's return over the same window.
    """
    out = study.join(sector, "event_id", "left")
    for h in horizons:
        car = F.col(f"raw_{h}") - F.col(f"sector_{h}")
        out = out.withColumns({f"car_sector_{h}": car, f"car_sector_simple_{h}": log_to_simple(car), f"target_positive_sector_{h}": F.coalesce(car > 0, F.lit(False)), f"target_direction_sector_{h}": direction(car, band)})
    return out


def usable(events: DataFrame, accepted: Sequence[str] = ("human_verified", "accepted", "auto_accepted"), exclude: Sequence[str] = ("hard_negative_flag", "known_before_flag")) -> DataFrame:
    """Reviewed rows that a study may use: an accepted status, a time and a ticker, and none of the excluding flags (absent columns exclude nothing)."""
    out = events.where(F.col("review_status").isin(*accepted) & F.col("event_time").isNotNull() & (F.trim("ticker") != ""))
    for c in exclude:
        if c in events.columns:
            out = out.where(~F.coalesce(F.col(c), F.lit(False)))
    return out


#: Event columns of a domain's features: event type, subtype and the amount that counts, by the names of the features.
PROJECTIONS: dict[str, Mapping[str, str]] = {
    "financing": {"event_type": "'capital_raise'", "event_subtype": "financing_event_type", "amount": "coalesce(gross_proceeds, offering_amount, convertible_principal, atm_capacity, shelf_capacity)"},
    "contract": {"event_type": "'government_contract'", "event_subtype": "contract_event_type", "amount": "coalesce(obligated_amount, award_amount, ceiling_amount)"},
    "trial": {"event_type": "'biotech_catalyst'", "event_subtype": "catalyst_event_type", "amount": "cast(null as double)"},
    "insider": {"event_type": "'insider_purchase'", "event_subtype": "transaction_class", "amount": "shares * price"},
    "ownership": {"event_type": "'activist_13d'", "event_subtype": "ownership_event_type", "amount": "cast(ownership_pct as double)"},
    "deal": {"event_type": "'merger'", "event_subtype": "deal_event_type", "amount": "coalesce(deal_value, offer_price * shares_outstanding)"},
    "incident": {"event_type": "'cybersecurity_incident'", "event_subtype": "incident_event_type", "amount": "cast(null as double)"},
}


def features_to_events(features: DataFrame, domain: str) -> DataFrame:
    """event_id, ticker, event_time, release_session, event_type, event_subtype and amount from a domain's features; absent feature columns are NULL."""
    import re

    names = {n for e in PROJECTIONS[domain].values() for n in re.findall(r"\b[a-z_]+\b", re.sub(r"'[^']*'", "", e))} - {"coalesce", "cast", "null", "as", "double"}
    missing = {n: F.lit(None).cast("string" if n.endswith("_type") or n.endswith("_class") else "double") for n in names if n not in features.columns}
    rows = features.withColumns(missing) if missing else features
    session = F.coalesce(F.nullif(F.trim("release_session"), F.lit("")), F.lit("unknown")) if "release_session" in features.columns else F.lit("unknown")
    return rows.select("event_id", "ticker", "event_time", session.alias("release_session"), *[F.expr(e).alias(n) for n, e in PROJECTIONS[domain].items()])
