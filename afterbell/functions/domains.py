"""Domain rules beyond the basic tables: incidents, distress, trials, ownership, insiders; flags of false positives, slices and triage.

Patterns are matched on lower-cased text by :func:`afterbell.functions.taxonomies.first_label` and
:func:`flags`. A rule with several patterns needs them all; ``!`` in front means it must not be found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from afterbell.functions.taxonomies import Rule

Flag = tuple[str, str | tuple[str, ...]]  # name, pattern or patterns

# Flags and labels, the words that name them, and their confidence.
_RISK = ("risk factors|cybersecurity risk management|material weaknesses in cyber controls", "!experienced a cybersecurity incident|identified a cybersecurity incident|became aware of a cybersecurity incident|unauthorized access|ransomware")
_VENDOR = (r"\b(vulnerability|zero-day|cve-|security advisory)\b", "third-party|vendor|supplier", "!our systems|company systems|affected our|impacted our|unauthorized access to")
_HARMLESS = r"\bnot\s+material\b|\bnot\s+reasonably\s+likely\s+to\s+materially\b|\bno\s+material\s+(impact|effect)\b"
_DISRUPTED = r"\b(disrupted|disruption|outage|shut down|shutdown|offline|suspend(ed)? operations|business interruption)\b"
INCIDENT_FLAGS: tuple[Flag, ...] = (
    ("generic_cyber_risk_disclosure", _RISK),
    ("vendor_vulnerability_not_tied_to_company", _VENDOR),
    ("non_material_or_no_material_impact_language", _HARMLESS),
    ("incident_known_publicly_before_filing", ("previously disclosed|as previously reported|previously announced", r"!\bitem\s+1\.05\b")),
)
INCIDENT_EVENTS: tuple[Rule, ...] = (
    ("generic_cyber_risk_control", _RISK, 0.92),
    ("generic_cyber_risk_control", _VENDOR, 0.86),
    ("no_material_impact_update", (_HARMLESS, "amend|update|8-k/a"), 0.93),
    ("ransomware", r"\bransomware\b|\bransom\b|\bextortion\b|\bencrypt(ed|ion)\b", 0.92),
    ("business_interruption", (_DISRUPTED, "business interruption"), 0.88),
    ("operational_disruption", _DISRUPTED, 0.88),
    ("customer_data_breach", r"\b(personal information|personally identifiable|customer data|protected health|patient|payment card|social security)\b", 0.86),
    ("third_party_vendor_breach", (r"\b(third[- ]party|vendor|supplier|service provider)\b", "incident|breach|unauthorized access"), 0.82),
    ("incident_update", "update|amendment|8-k/a|investigation is ongoing", 0.75),
    ("material_cyber_incident", r"\bitem\s+1\.05\b|cybersecurity incident", 0.82),
    ("legacy_cyber_disclosure", "unauthorized access|data breach|cyber attack|cyberattack", 0.70),
)
_LISTING = "^item 3[.]01|listing rule|delisting|minimum bid price|stockholders' equity"
_DELISTED = "notice of delisting|delisting determination|will be delisted"
#: For texts that begin with ``item`` and the item's number.
DISTRESS_EVENTS: tuple[Rule, ...] = (
    ("compliance_cure", "regained compliance|now in compliance|compliance has been regained|deficiency has been cured", 0.94),
    ("extension_or_appeal", "extension.+granted|granted.+extension|appeal|hearing panel|additional time to regain compliance", 0.88),
    ("reverse_split_plan", ("reverse stock split|reverse split", "!" + _DELISTED), 0.86),
    ("bankruptcy_receivership", "^item 1[.]03|chapter 11|chapter 7|filed for bankruptcy|bankruptcy court|receiver|receivership", 0.93),
    ("debt_acceleration", ("^item 2[.]04|event of default|covenant default|accelerated|acceleration of|demand for payment", "accelerated|acceleration|demand for payment"), 0.90),
    ("covenant_default", "^item 2[.]04|event of default|covenant default", 0.88),
    ("material_impairment", "^item 2[.]06|impairment charge|non-cash impairment|goodwill impairment|long-lived asset impairment", 0.88),
    ("bid_price_deficiency", (_LISTING, "minimum bid price|bid price requirement"), 0.90),
    ("equity_deficiency", (_LISTING, "stockholders|shareholders", "equity"), 0.90),
    ("delisting_notice", (_LISTING, _DELISTED), 0.88),
    ("failure_to_satisfy_listing_rule", _LISTING, 0.82),
)
_COMMITTEE, _READOUT = r"advisory committee|\badcom\b", "primary endpoint|topline results|top-line results"
_MISSED = r"did not meet|did not achieve|failed to meet|failed to achieve|not statistically significant"
TRIAL_EVENTS: tuple[Rule, ...] = (
    ("fda_complete_response_letter", r"complete response letter|\bcrl\b", 0.96),
    ("trial_halt", "clinical hold", 0.92),
    ("trial_halt", r"(?s)\b(trial|study)\b.{0,80}\b(halted|paused|stopped|suspended)\b|\b(halted|paused|stopped|suspended)\b.{0,80}\b(trial|study)\b", 0.90),
    ("trial_discontinuation", r"(?s)\b(discontinue|discontinued|terminate|terminated|stop development|will not continue)\b.{0,120}\b(trial|study|program|development)\b", 0.88),
    ("label_expansion", ("label expansion|expanded label|expanded approval|supplemental new drug application", "approved|approval"), 0.92),
    ("accelerated_approval", ("accelerated approval", "approved|approval|granted"), 0.93),
    ("fda_approval", r"(?s)\bfda\b.{0,120}\b(approved|approves|approval)\b|\b(approved|approval)\b.{0,120}\bfda\b", 0.94),
    ("fda_advisory_committee_positive", (_COMMITTEE, "recommended approval|voted in favor|positive vote"), 0.84),
    ("fda_advisory_committee_negative", (_COMMITTEE, "recommended against|voted against|negative vote"), 0.84),
    ("phase_3_readout", (r"phase (2/)?(3|iii)\b", _READOUT), 0.88),
    ("phase_2_readout", (r"phase (2|ii)[ab]?\b", _READOUT), 0.86),
    ("endpoint_failure", ("primary endpoint", _MISSED), 0.92),
    ("pivotal_trial_readout", ("pivotal", _READOUT), 0.86),
    ("safety_signal", "serious adverse event|safety signal", 0.80),
)
_RESULT = "!topline results|top-line results|statistically significant|serious adverse event|safety signal|met (its|the) primary endpoint|did not meet"
TRIAL_FLAGS: tuple[Flag, ...] = (
    ("boilerplate_or_risk_factor_not_event", "actual results could differ|results to differ materially|risks and uncertainties"),
    ("previously_announced_not_new", "previously announced|previously disclosed|\\bin (january|february|march|april|may|june|july|august|september|october|november|december|q[1-4]),? we announced\\b"),
    ("publication_or_conference_notice_not_topline", (r"\b(will|plans? to|expects? to|scheduled to|accepted to|accepted for)\s+(present|report|announce|share|publish)\b|poster presentation|oral presentation|accepted for presentation|abstract|published in|publication in", _RESULT)),
    ("enrollment_update_not_binary", "completed enrollment|enrollment completed|enrollment is complete|enrolled first patient"),
    ("trial_initiation_not_binary", "first patient dosed|dosed first patient|initiated dosing|initiated a phase|initiated the phase|trial initiation"),
    ("trial_design_not_binary", ("trial design|study design|protocol amendment|designed to evaluate|designed to assess", _RESULT)),
    ("pipeline_update_not_binary", ("currently being evaluated|is ongoing|ongoing phase|expects to share|expected to share|expected by|readout by", _RESULT)),
    ("background_approval_language_not_decision", "approved under accelerated approval|indication is approved|continued approval|post-approval|support accelerated approval|potential priority review|potential accelerated approval|may be contingent|has not yet been established"),
)
#: What went wrong with an audited fact of a financing: reason, pattern of the evidence ("" for any), facts ("" for any).
TRIAGE: tuple[tuple[str, str, str], ...] = (
    ("par_value_false_price", "par value", "price_per_share"),
    ("exercise_price_false_price", "exercise price", "price_per_share"),
    ("conversion_price_false_offering_price", "conversion price", "price_per_share"),
    ("warrant_terms_false_common_stock_price", "warrant", "price_per_share"),
    ("fee_table_amount_false_gross_proceeds", "rule 457|registration fee|filing fee", ""),
    ("estimated_maximum_offering_amount_false_completed_raise", "assumed offering price|last reported sale price|maximum aggregate offering price|proposed maximum", ""),
    ("atm_commission_percent_false_capacity", "percent|%", ""),
    ("underwriter_option_false_shelf_capacity", "underwriters of the offering to purchase up to an additional|option stock", ""),
    ("convertible_exchange_false_new_financing", "exchange agreement|exchange transaction|exchanged for", ""),
    ("prior_transaction_reference", r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+[0-9]{1,2},\s+[0-9]{4}", ""),
    ("capacity_only_ambiguous_amount", "may offer", "atm_capacity|shelf_capacity"),
    ("convertible_principal_wrong", "", "convertible_principal"),
    ("gross_proceeds_wrong_amount", "", "gross_proceeds|offering_amount|net_proceeds"),
    ("shares_offered_wrong", "", "shares_offered"),
    ("price_per_share_wrong", "", "price_per_share"),
)
#: Upper bounds of market values (exclusive) and the names below them; the last name is for larger ones.
SIZE_CUTS = {
    "five": (((3e8, "micro"), (2e9, "small"), (1e10, "mid"), (2e11, "large")), "mega"),
    "four": (((3e8, "micro_lt_300m"), (2e9, "small_300m_2b"), (1e10, "mid_2b_10b")), "large_gt_10b"),
    "three": (((2e9, "small_cap"), (1e10, "mid_cap")), "large_cap"),
}
KNOWN_ACTIVISTS = "elliott|starboard|valueact|icahn|pershing square|third point|jana|engine capital|ancora|legion partners|land & buildings|sachem head|corvex"
BOARD_CAMPAIGN = r"\b(nominate|nomination|proxy contest|proxy solicitation|board seat|replace directors)\b"
BOARD = "board|director|nominate|nomination|proxy contest|proxy solicitation"
SALE = "strategic alternative|sale of the company|sell the company|merger|business combination|takeover|acquisition proposal"
CONTROL = "influence control|seek control|change in control|control of the issuer|control intent|effect changes|enhance shareholder value|maximize shareholder value|engage with management"
NO_CHANGE = "no material change|no change in intent|amendment is being filed solely|solely to report"
EXIT = r"ceased? to be (the |a )?beneficial owner|less than 5 ?%|more than five percent"
INSIDER_WORDS = r"\b(founder|chief executive|ceo|officer|director)\b"


def met(low: Column, pattern: str | tuple[str, ...]) -> Column:
    out = F.lit(True)
    for part in (pattern,) if isinstance(pattern, str) else pattern:
        out &= ~low.rlike(part[1:]) if part.startswith("!") else low.rlike(part)
    return out


def flags(text: Column, rules: Sequence[Flag]) -> Column:
    """The names of all rules that a text meets, in order, as an array."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(met(low, pattern), name) for name, pattern in rules]))


def size_bucket(market_value: Column, cuts: str) -> Column:
    """Bucket of a market value by one of the cut sets of :data:`SIZE_CUTS`; NULL is ``unknown``."""
    bounds, last = SIZE_CUTS[cuts]
    out = F.when(market_value.isNull(), "unknown")
    for bound, name in bounds:
        out = out.when(market_value < bound, name)
    return out.otherwise(last)


def financing_slice(event_type: Column, security_type: Column, fact_name: Column) -> Column:
    """The audit slice of a financing row, by its event type, security and fact; blank or NULL values say nothing."""
    kind, security, fact = (F.trim(F.coalesce(c, F.lit(""))) for c in (event_type, security_type, fact_name))
    warning = ("going_concern_warning", "liquidity_warning")
    plain = security.isin("", "common_stock", "ordinary_shares", "unknown")
    return (
        F.when(kind.isin(*warning) | fact.isin(*warning), "liquidity_warnings")
        .when((kind == "convertible_note_offering") | (security == "convertible_notes") | fact.isin("convertible_principal", "conversion_price"), "convertible_debt")
        .when(kind.isin("atm_program_created", "atm_program_usage_reported") | (fact == "atm_capacity"), "atm_programs")
        .when(kind.isin("shelf_registration", "prospectus_supplement") | (fact == "shelf_capacity"), "shelf_prospectus")
        .when((kind.isin("completed_equity_offering", "registered_direct_offering") & plain) | ((kind == "private_placement") & (security == "common_stock")), "completed_common_stock")
        .otherwise("other")
    )


def triage_reason(status: Column, fact_name: Column, evidence: Column) -> Column:
    """Why an audited fact failed (blank for rows with status ok)."""
    fact, low = F.lower(F.coalesce(fact_name, F.lit(""))), F.lower(F.coalesce(evidence, F.lit("")))
    out = F.when(F.coalesce(status, F.lit("ok")) == "ok", "")
    for reason, pattern, facts in TRIAGE:
        here = low.rlike(pattern) if pattern else F.lit(True)
        out = out.when(here & fact.isin(*facts.split("|")) if facts else here, reason)
    return out.otherwise("ambiguous_event_type")


def activism(filing_type: Column, amendment: Column, item_4: Column, change: Column, owner: Column) -> Column:
    """Struct of event type and the reason why a row is a hard negative (NULL if it isn't), from an ownership filing.

    amendment: boolean. change: percentage points, may be NULL.
    """
    low, name = F.lower(F.coalesce(item_4, F.lit(""))), F.lower(F.coalesce(owner, F.lit("")))
    control, board, sale = low.rlike(CONTROL), low.rlike(BOARD), low.rlike(SALE)
    activist = control | name.rlike(KNOWN_ACTIVISTS)
    less, more = F.coalesce(change < 0, F.lit(False)), F.coalesce(change > 0, F.lit(False))
    tiny = F.coalesce(F.abs(change) < 0.5, F.lit(False))
    entry = lambda kind, reason=None: F.struct(F.lit(kind).alias("event_type"), F.lit(reason).cast("string").alias("hard_negative_reason"))
    return (
        F.when(F.upper(filing_type).contains("13G"), entry("passive_13g_control", "passive filing"))
        .when(low.rlike(EXIT), entry("exit_amendment", "exit or less than five percent"))
        .when(amendment & less, entry("ownership_decrease_amendment", "ownership decrease"))
        .when(amendment & (low.rlike(NO_CHANGE) | tiny) & ~(board | sale | activist), entry("passive_or_ambiguous_13d", "no new intent or a tiny change"))
        .when(low.rlike(INSIDER_WORDS) & ~(activist | sale | board), entry("passive_or_ambiguous_13d", "insider without control intent"))
        .when(sale, F.when(low.rlike("sale|sell the company"), entry("sale_pressure")).otherwise(entry("strategic_alternatives_13d")))
        .when(low.rlike(BOARD_CAMPAIGN), entry("board_seat_campaign"))
        .when(control, entry("control_intent_13d"))
        .when(amendment & more, entry("ownership_increase_amendment"))
        .when(activist, entry("initial_activist_13d"))
        .otherwise(entry("passive_or_ambiguous_13d", "passive or ambiguous language"))
    )


def insider_class(code: Column, acquired: Column, derivative: Column, shares: Column, price: Column, planned: Column, title: Column, director: Column, officer: Column, ten_percent: Column) -> Column:
    """Class of an insider's transaction: only acquired, unplanned cash purchases are purchases, named by the owner's role."""
    kind, role = F.upper(F.trim(F.coalesce(code, F.lit("")))), F.lower(F.coalesce(title, F.lit("")))
    got = F.upper(F.trim(F.coalesce(acquired, F.lit(""))))
    cash = F.coalesce((shares > 0) & (price > 0), F.lit(False))
    purchase = (
        F.when(planned, "planned_transaction")
        .when((got != "A") | ~cash, "non_open_market_transaction")
        .when(ten_percent & ~(director | officer), "ten_percent_owner_purchase")
        .when(role.rlike(r"chief executive|\bceo\b"), "ceo_purchase")
        .when(role.rlike(r"chief financial|\bcfo\b"), "cfo_purchase")
        .when(director, "director_purchase")
        .otherwise("open_market_purchase")
    )
    return (
        F.when(derivative | (kind == "M"), "option_exercise").when(kind == "F", "tax_withholding").when(kind.isin("G", "J", "A", "D"), "non_open_market_transaction")
        .when((kind == "S") | (got == "D"), "sale_cluster").when(kind == "P", purchase).otherwise("non_open_market_transaction")
    )
