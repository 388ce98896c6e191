"""Public announcements linked to awards: what of the award they mention, why a link doesn't count, and one link per award."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of sources, other names for them, and which of them the public reads.
ALIASES = {
    "press_release": "company_press_release", "company_release": "company_press_release", "ir_press_release": "investor_relations", "8_k": "sec_8k", "dod": "dod_contract_announcement",
    "defense_contracts": "dod_contract_announcement", "agency": "agency_press_release", "usaspending": "usaspending_only", "usaspending_api": "usaspending_only",
}
PUBLIC = ("company_press_release", "investor_relations", "sec_8k", "dod_contract_announcement", "agency_press_release")
LEAST_CHARS, TERM_CHARS, MOST_TERMS = 3, 6, 8


def source_kind(c: Column) -> Column:
    raw = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[- ]", "_")
    out = raw
    for name, kind in ALIASES.items():
        out = F.when(raw == name, kind).otherwise(out)
    return out


def amount_token(c: Column) -> Column:
    """An amount as texts write it: tenths of billions or millions, without a trailing zero; whole below; empty for none."""
    short = lambda by: F.regexp_replace(F.format_string("%.1f", c / by), r"\.0$", "")
    return F.when(c >= 1e9, short(1e9)).when(c >= 1e6, short(1e6)).when(c > 0, F.format_string("%.0f", c)).otherwise("")


def public_links(events: DataFrame, links: DataFrame, audit_passed: bool, least: float = 0.8) -> DataFrame:
    """Links with source kind, mentions, economics_match, awareness_key, notes (why a link isn't valid), valid, duplicate_status and eligible.

    events (event_id, ticker, recipient_name, contract_number, agency, description, award_amount, obligated_amount, pct_market_cap,
    funded, ceiling_only, mapping_confidence); links (event_id, announcement_time, source_type, source_url, title, excerpt,
    source_confidence, link_confidence). A link has to name the recipient, ticker or contract, and its amount, agency, a word of
    its description or the contract. Links with one awareness key (ticker with contract, else address or title) tell of the same news: the surest
    is primary. Eligible are valid primary links. Missing values fail their check; links of unknown events are kept with a note.
    """
    known = events.dropDuplicates(["event_id"]).withColumn("_known", F.lit(True))
    rows = links.join(known, "event_id", "left")
    low = lambda name: F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))
    text = F.lower(F.regexp_replace(F.concat_ws(" ", "title", "excerpt"), r"\s+", " "))
    held = lambda c, chars=1: (F.length(c) >= chars) & text.contains(c)
    contract, recipient, ticker, agency = (low(c) for c in ("contract_number", "recipient_name", "ticker", "agency"))
    mentions = held(contract) | held(recipient, LEAST_CHARS) | held(ticker, LEAST_CHARS)
    words = F.slice(F.filter(F.split(low("description"), "[^a-z0-9]+"), lambda w: F.length(w) >= TERM_CHARS), 1, MOST_TERMS)
    tokens = [amount_token(F.col(c).cast("double")) for c in ("obligated_amount", "award_amount")]
    economics = held(tokens[0]) | held(tokens[1]) | held(agency) | F.exists(words, lambda w: text.contains(w)) | held(contract)
    kind = source_kind(F.col("source_type"))
    news = F.lower(F.trim(F.coalesce("source_url", F.lit(""))))
    title = F.substring(F.lower(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))), 1, 80)
    key = F.concat(F.upper(ticker), F.lit(":"), F.when(contract != "", F.upper(contract)).when(news != "", news).otherwise(title))
    low_score = lambda name: F.coalesce(F.col(name) < least, F.lit(True))
    no = lambda name: ~F.coalesce(F.col(name), F.lit(False))
    reasons = (
        (F.col("_known").isNull(), "event_id_not_found"), (~kind.isin(*PUBLIC), "announcement_source_not_public_market_source"), (F.col("announcement_time").isNull(), "missing_announcement_time"),
        (~mentions, "announcement_text_does_not_mention_recipient_or_contract"), (~economics, "announcement_text_does_not_match_amount_agency_or_program"),
        (low_score("source_confidence"), "source_confidence_below_0_80"), (low_score("link_confidence"), "link_confidence_below_0_80"), (F.lit(not audit_passed), "parser_audit_not_passed"),
        (low_score("mapping_confidence"), "recipient_mapping_confidence_below_0_80"), (no("funded"), "not_actual_funded_award"), (F.coalesce("ceiling_only", F.lit(False)), "ceiling_only_event"),
        (F.col("award_amount").isNull() & F.col("obligated_amount").isNull(), "missing_award_or_obligated_amount"), (F.col("pct_market_cap").isNull(), "missing_market_cap_materiality_ratio"),
        (kind == "usaspending_only", "timestamp_source_type_usaspending_only"),
    )
    notes = F.array_compact(F.array(*[F.when(c, n) for c, n in reasons]))
    out = rows.select(*links.columns, kind.alias("source_kind"), mentions.alias("mentions"), economics.alias("economics_match"), key.alias("awareness_key"), F.array_join(notes, ";").alias("notes"), (F.size(notes) == 0).alias("valid"))
    surest = Window.partitionBy("awareness_key").orderBy(F.desc_nulls_last("link_confidence"), F.desc_nulls_last("source_confidence"), "event_id", "announcement_time")  # the links of one award
    out = out.withColumn("duplicate_status", F.when(F.col("awareness_key") == ":", "ambiguous").when(F.row_number().over(surest) == 1, "primary").otherwise("duplicate"))
    return out.withColumn("eligible", F.col("valid") & (F.col("duplicate_status") == "primary"))
