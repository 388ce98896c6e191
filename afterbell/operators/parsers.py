"""Domain documents in one pass: event type, flags, amounts and stated values; earnings facts by metric, role and range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from afterbell.functions import domains as DO
from afterbell.functions import taxonomies as T
from afterbell.operators import evidence as E
from afterbell.operators.projections import scalar_fields

#: Rules, default label and flags of each domain.
DOMAINS = {
    "financing": (T.FINANCING_EVENTS, "unknown", ()),
    "contract": (T.CONTRACT_EVENTS, "unknown", ()),
    "accounting": (T.ACCOUNTING_EVENTS, "unknown", ()),
    "deal": (T.DEAL_EVENTS, "ordinary_material_agreement_control", ()),
    "incident": (DO.INCIDENT_EVENTS, "generic_cyber_risk_control", DO.INCIDENT_FLAGS),
    "distress": (DO.DISTRESS_EVENTS, "unknown", ()),
    "trial": (DO.TRIAL_EVENTS, "other", DO.TRIAL_FLAGS),
}
# Metrics and roles of earnings texts, in order of precedence.
METRICS = (
    ("gross_margin", "gross margin"), ("operating_margin", "operating margin"), ("free_cash_flow", "free cash flow"), ("operating_income", "operating income|income from operations"), ("net_income", "net income"),
    ("eps", "earnings per share|per diluted share"), ("capex", "capital expenditures|capex"), ("revenue", "revenue|net sales"),
)
ROLES = (("consensus", "consensus|analysts expect|street estimate"), ("guidance", r"guidance|outlook|\bexpects?\b|expected to be|anticipates|forecast"), ("forward", "next year|long-term|fiscal year ahead"))
PRIOR = "previously announced|prior offering|as of the date of|year-ago|compared with the prior"
#: What was guided before, in a text about what came; words of a firm's description; definitions of a measure.
GUIDED = r"\b(above|below|within|exceed(ed|ing)?|beat|topped|versus|compared (to|with))\b.{0,60}\b(guidance|outlook|forecast|midpoint)"
DESCRIBED = "with (revenues?|net sales) of (more than|over|approximately)|is defined as|described further below|determined in accordance with"


def document_fields(text: Column) -> dict[str, Column]:
    """Values that ownership and trial texts state (an asset is a name with a number, as in ``ABC-101``), beyond :func:`scalar_fields`; NULL where a text says nothing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    number = lambda pattern, group=1: F.regexp_extract(low, pattern, group).try_cast("double")
    pair = r"(?s)(?:from|previously)\s+([0-9]+(?:\.[0-9]+)?)\s*%.*?(?:to|currently|now)\s+([0-9]+(?:\.[0-9]+)?)\s*%"
    unit = r"\s+([0-9]+(?:\.[0-9]+)?)\s*(?:percentage points|%)"
    change = F.coalesce(number(pair, 2) - number(pair, 1), number("increased by" + unit), -number("decreased by" + unit))
    date = F.regexp_extract(low, r"(?:pdufa|target action)(?: date| goal date)?[^.]{0,40}?\b((?:january|february|march|april|may|june|july|august|september|october|november|december) [0-9]{1,2}, [0-9]{4})", 1)
    phase = F.regexp_extract(low, r"\bphase\s+([0-9](?:/[0-9])?|i{1,3})\b", 1)
    roman = F.when(phase == "i", "1").when(phase == "ii", "2").when(phase == "iii", "3").otherwise(phase)
    raw = F.coalesce(text, F.lit(""))
    name = r"[A-Z]{2,}[A-Za-z0-9]*-[0-9]+[A-Za-z0-9-]*|[A-Z][a-z]+-[0-9]+[A-Za-z0-9-]*|[A-Z]{2,}[0-9]{2,}[A-Za-z0-9]*"
    disease = F.regexp_extract(raw, r"(?i)(?:for (?:the )?treatment of|in patients with) ([^.;,\n]+)", 1)
    return {
        "asset": F.try_element_at(F.filter(F.regexp_extract_all(raw, F.lit(r"\b(" + name + r")\b"), F.lit(1)), lambda x: ~x.rlike("^NCT[0-9]{8}$")), F.lit(1)),
        "indication": F.nullif(F.trim(F.regexp_replace(disease, r"(?i)\s+(and|with) (announced|reported|met|failed).*$", "")), F.lit("")),
        "ownership_change": change,
        "source_of_funds": F.when(low.contains("working capital"), "working_capital").when(low.contains("personal fund"), "personal_funds").when(low.rlike("margin loan|margin account|borrowed|loan"), "financing_or_margin"),
        "trial_phase": F.nullif(roman, F.lit("")),
        "endpoint_met": F.when(low.rlike(r"did not (meet|achieve)|failed to (meet|achieve)"), False).when(low.rlike(r"(met|achieved) (its|the) primary endpoint"), True),
        "votes_against": number(r"voted [0-9]+ to ([0-9]+)"),
        "decision_date": F.try_to_date(F.nullif(F.initcap(date), F.lit("")), "MMMM d, yyyy"),
        "safety_language": low.rlike("serious adverse event|safety signal|clinical hold"),
    }


def parse_documents(docs: DataFrame, domain: str, item_col: str | None = None) -> DataFrame:
    """doc_id, event_type, confidence, flags, security_type (financing), amounts (low, high, mid), percents, and the stated values of each text.

    ``item_col``: the item of a filing, which distress rules look at.
    """
    rules, default, flags = DOMAINS[domain]
    text = F.col("text") if item_col is None else F.concat_ws("\n", F.concat(F.lit("item "), F.coalesce(F.col(item_col), F.lit(""))), F.col("text"))
    label = T.first_label(text, rules, default)
    security = T.first_label(F.col("text"), T.SECURITY_TYPES, "unknown")["label"] if domain == "financing" else F.lit(None).cast("string")
    values = document_fields(F.col("text")) | scalar_fields(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", "text", label.alias("_label"), DO.flags(F.col("text"), flags).alias("flags"), security.alias("security_type"), E.range_or_mid(E.amounts(F.coalesce(F.col("text"), F.lit("")))).alias("_amounts"), E.percents(F.coalesce(F.col("text"), F.lit(""))).alias("percents"))
    return rows.select("doc_id", F.col("_label.label").alias("event_type"), F.col("_label.confidence").alias("confidence"), "flags", "security_type", *[F.col(f"_amounts.{c}").alias(f"amount_{c}") for c in ("low", "high", "mid")], "percents", *[c.alias(n) for n, c in values.items()])


def earnings_facts(segments: DataFrame) -> DataFrame:
    """One fact per segment that names a metric and a value of its unit: fact_name, low, high, value, unit, confidence.

    Money is in dollars, margins are fractions, earnings per share dollars. Guidance of two values is a range in order of
    size, and so is an amount ``plus or minus`` another; other roles have the first value. A result that is told beside
    earlier guidance is a result. Segments about earlier transactions or periods, descriptions of a firm and definitions
    are left out. Confidence: .6, and .1 each
    for a named role, a range and a unit that fits, at most .95.
    """
    low = F.lower(F.col("segment"))
    metric = F.lit(None).cast("string")
    for name, pattern in reversed(METRICS):
        metric = F.when(low.rlike(pattern if name != "eps" else pattern + r"|\beps\b"), name).otherwise(metric)
    role = F.lit("actual")
    for name, pattern in reversed(ROLES):
        role = F.when(low.rlike(pattern), name).otherwise(role)
    role = F.when(low.rlike(GUIDED), "actual").otherwise(role)
    rows = segments.withColumns({"_metric": metric, "_role": role}).where(F.col("_metric").isNotNull() & ~low.rlike(PRIOR) & ~low.rlike(DESCRIBED))
    share = F.col("_metric") == "eps"
    part = F.col("_metric").endswith("margin")
    values = F.when(share, E.per_share(F.col("segment"))).when(part, E.percents(F.col("segment"))).otherwise(E.amounts(F.col("segment")))
    rows = rows.withColumn("_values", values).where(F.size("_values") > 0)
    ranged = F.col("_role").isin("guidance", "forward")
    rows = rows.withColumn("_values", F.when(ranged, F.col("_values")).otherwise(F.slice("_values", 1, 1)))
    rows = rows.withColumn("_range", F.when(ranged & ~share & ~part, E.stated_range(F.col("segment"))).otherwise(E.range_or_mid(F.col("_values"))))
    unit = F.when(share, "usd_per_share").when(part, "fraction").otherwise("usd")
    scaled = share | part | low.rlike("million|billion|thousand")
    confidence = F.least(F.lit(0.95), 0.6 + F.when(F.col("_role") != "actual", 0.1).otherwise(0.0) + F.when(F.size("_values") > 1, 0.1).otherwise(0.0) + F.when(scaled, 0.1).otherwise(0.0))
    return rows.select(
        *segments.columns, F.concat_ws("_", "_metric", "_role").alias("fact_name"), F.col("_range.low").alias("low"), F.col("_range.high").alias("high"), F.col("_range.mid").alias("value"), unit.alias("unit"), F.round(confidence, 6).alias("confidence")
    )
