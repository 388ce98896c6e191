"""Ordered rule tables: the first rule that a text meets names its label.

A rule's pattern is one regular expression over the lower-cased text, or several that must all be
found; one that begins with ``!`` must not be found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str | tuple[str, ...], float]  # label, pattern or patterns, confidence

# Labels, the words that name them, and their confidence.
SECURITY_TYPES: tuple[Rule, ...] = (
    ("convertible_notes", r"(?s)convertible.*(note|debenture)|(note|debenture).*convertible", 0.88),
    ("common_stock", "common stock|common shares|ordinary shares", 0.86),
    ("preferred_stock", "preferred stock|preferred shares", 0.84),
    ("warrants", "warrant", 0.78),
    ("units", "units", 0.72),
)
CONTRACT_EVENTS: tuple[Rule, ...] = (
    ("subcontract_award", "subcontract", 0.88),
    ("sbir_award", "sbir|small business innovation research", 0.90),
    ("sttr_award", "sttr|small business technology transfer", 0.90),
    ("production_contract", "production contract|production award", 0.86),
    ("recompete_win", "recompete|re-compete", 0.85),
    ("contract_extension", "extension|extended", 0.84),
    ("option_exercise", r"(?s)option.*exercise|exercise.*option|option year|option period", 0.88),
    ("contract_modification", r"modification|\bmod\s", 0.88),
    ("task_order_award", "task order|delivery order", 0.88),
    ("ota_prototype_award", r"other transaction|\bota\b|prototype award", 0.86),
    ("idiq_vehicle_award", "indefinite-delivery|indefinite delivery|indefinite-quantity|idiq|multiple award|contract vehicle", 0.88),
    ("contract_ceiling_only", r"\b(ceiling|not-to-exceed|not to exceed|up to)\s+(of\s+)?\$?\s*\d", 0.80),
    ("new_contract_award", "award|contract", 0.76),
)
_ATM, _ENDED = r"at-the-market|at the market|\batm\b", r"\b(terminat|abandon|cancel|withdraw)\w*\b"
FINANCING_EVENTS: tuple[Rule, ...] = (
    ("unknown", "redemption of public warrants|public warrants are exercisable", 0.70),
    ("registered_direct_offering", "registered direct offering", 0.86),
    ("private_placement", "private placement", 0.80),
    ("completed_equity_offering", ("public offering", "common stock|ordinary shares", "priced|closed|completed|sold|agreed to sell|entered into a securities purchase agreement|gross proceeds"), 0.87),
    ("announced_equity_offering", ("public offering", "common stock|ordinary shares"), 0.82),
    ("convertible_note_offering", ("convertible", "note|debenture"), 0.88),
    ("atm_program_usage_reported", (_ATM, "sold|sales under|net proceeds from sales|gross proceeds from sales", "!may sell"), 0.86),
    ("atm_program_created", _ATM, 0.88),
    ("shelf_registration", "shelf registration|shelf offering|form s-3", 0.82),
    ("prospectus_supplement", "prospectus supplement", 0.76),
    ("going_concern_warning", "going concern", 0.86),
    ("liquidity_warning", ("liquidity", "substantial doubt|cash runway|working capital|continue as a going concern"), 0.78),
)
ACCOUNTING_EVENTS: tuple[Rule, ...] = (
    ("non_reliance_financial_statements", r"should (no longer|not) be relied|non-reliance|item 4\.02", 0.92),
    ("auditor_disagreement", ("disagree", "auditor|accountant|exhibit 16", r"!no\s+disagreements?|not\s+had\s+any\s+disagreements?"), 0.88),
    ("reportable_event", "reportable events?", 0.86),
    ("auditor_resignation", "resign|declined to stand for re-?appointment", 0.86),
    ("accounting_error_correction", ("material weakness|internal control", "restat|error"), 0.78),
    ("internal_control_issue", "material weakness|internal control", 0.72),
    ("restatement_warning", "restat", 0.78),
    ("routine_auditor_change", "dismiss|engaged|appointed", 0.74),
)
DEAL_EVENTS: tuple[Rule, ...] = (
    ("regulatory_block", (_ENDED, r"\b(regulatory|antitrust|ftc|doj|competition authority|blocked|injunction)\b"), 0.86),
    ("financing_failure", (_ENDED, r"\b(financing|debt commitment|funding)\b"), 0.84),
    ("shareholder_vote_failure", (_ENDED, r"(?s)\b(shareholder|stockholder).{0,40}\b(vote|approval|reject|fail)\b"), 0.84),
    ("termination_fee_event", (_ENDED, "termination fee"), 0.84),
    ("deal_termination", _ENDED, 0.86),
    ("acquisition_completion", r"(?s)\b(completed|closed|consummated)\b.{0,80}\b(acquisition|merger|tender offer|business combination)\b", 0.88),
    ("tender_offer", "tender offer", 0.86),
    ("revised_terms", r"(?s)\b(revised|amended|increased|decreased|sweetened|reduced)\b.{0,80}\b(offer|consideration|merger agreement|deal)\b", 0.80),
    ("definitive_merger_agreement", r"(?s)agreement and plan of merger|\bdefinitive\b.{0,80}\b(merger agreement|agreement to acquire|acquisition agreement)\b", 0.90),
    ("acquisition_announcement", "acqui|merger", 0.70),
)
#: Deal and distress events by how their news is digested.
DEAL_SURVIVABILITY = {
    "immediate-gap": ("definitive_merger_agreement", "acquisition_announcement", "tender_offer"),  # on the target's side
    "delayed-digestion": ("revised_terms", "regulatory_block", "financing_failure", "shareholder_vote_failure"),
    "slow-burn repricing": ("deal_termination",),
    "explanation-only": ("acquisition_completion", "ordinary_material_agreement_control"),
}
DISTRESS_CONTROLS = ("compliance_cure", "extension_or_appeal", "reverse_split_plan", "unknown")
LEAST_DOLLAR_VOLUME = 1_000_000
#: Event types of ownership filings by how their news is digested.
SURVIVABILITY = {
    "delayed-digestion": ("board_seat_campaign", "sale_pressure", "strategic_alternatives_13d", "control_intent_13d"),
    "slow-burn repricing": ("initial_activist_13d", "ownership_increase_amendment"),
    "explanation-only": ("passive_13g_control", "passive_or_ambiguous_13d"),
    "immediate-gap": ("ownership_decrease_amendment", "exit_amendment"),
}


def first_label(text: Column, rules: Sequence[Rule], default: str, default_confidence: float = 0.3) -> Column:
    """Struct of label and confidence of the first rule that matches."""
    low = F.lower(F.coalesce(text, F.lit("")))
    entry = lambda label, confidence: F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
    out = F.when(F.lit(False), entry(default, default_confidence))
    for label, pattern, confidence in rules:
        parts = (pattern,) if isinstance(pattern, str) else pattern
        met = F.lit(True)
        for part in parts:
            met &= ~low.rlike(part[1:]) if part.startswith("!") else low.rlike(part)
        out = out.when(met, entry(label, confidence))
    return out.otherwise(entry(default, default_confidence))


def survivability(event_type: Column, session: Column) -> Column:
    """Struct of class, first realistic entry and whether close-to-close returns only explain."""
    kind = F.lower(F.trim(event_type))
    cls = F.when(F.lit(False), "")
    for name, types in SURVIVABILITY.items():
        cls = cls.when(kind.isin(*types), name)
    cls = cls.otherwise("pre-event setup")
    entry = F.when(session == "after_close", "next_open").when(session == "before_open", "same_day_open_or_next_open").otherwise("first_liquid_trade_after_acceptance")
    return F.struct(cls.alias("execution_class"), entry.alias("first_entry"), (cls == "explanation-only").alias("explanatory_only"))


def deal_survivability(event_type: Column, role: Column) -> Column:
    """Class of a deal event; an announcement moves at once only on the target's side."""
    kind = F.lower(F.trim(event_type))
    cls = F.when(F.lit(False), "")
    for name, types in DEAL_SURVIVABILITY.items():
        here = kind.isin(*types)
        cls = cls.when(here & (F.lower(F.trim(role)) == "target") if name == "immediate-gap" else here, name)
    return cls.otherwise("pre-event setup")


def distress_survivability(event_type: Column, session: Column, dollar_volume: Column) -> Column:
    """Class of a distress event: controls and thin names only explain, then the session decides."""
    return (
        F.when(event_type.isin(*DISTRESS_CONTROLS) | F.coalesce(dollar_volume < LEAST_DOLLAR_VOLUME, F.lit(False)), "explanation-only")
        .when(session == "after_close", "immediate-gap")
        .when(session.isin("before_open", "intraday"), "delayed-digestion")
        .otherwise("explanation-only")
    )


def accounting_survivability(event_type: Column, severity: Column, session: Column, non_reliance: Column, disagreement: Column, reportable: Column, hard_negative: Column) -> Column:
    """Class of an accounting event: routine ones only explain unless severe, news outside trading hours gaps, restatements take time to read."""
    kind, level = F.lower(F.trim(F.coalesce(event_type, F.lit("")))), F.lower(F.coalesce(severity, F.lit("")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when((yes(hard_negative) | (kind == "routine_auditor_change")) & (level != "high"), "explanation-only")
        .when(session.isin("after_close", "before_open") & (yes(non_reliance) | yes(disagreement) | yes(reportable)), "immediate-gap")
        .when(yes(non_reliance) | kind.isin("restatement_warning", "accounting_error_correction"), "delayed-digestion")
        .when(kind.isin("internal_control_issue", "reportable_event"), "slow-burn repricing")
        .otherwise("pre-event setup")
    )
