"""Sections, events and facts of releases: the whole texts of ``documents`` between paragraphs of trial news."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.functions import trials as T
from afterbell.operators import sections as S
from afterbell.plans import base
from afterbell.plans.domains import met_sql
from afterbell.plans.registry import register

HEADS = (
    "XYZ announced topline results from the Phase 3 PIVOTAL trial of ABC-123 in patients with relapsed lymphoma. The trial met its primary endpoint of survival with p=0.004 and hazard ratio 0.62.",
    "XYZ received a Complete Response Letter from the FDA for ABC-123 for the treatment of lymphoma.", "The FDA placed a clinical hold on the Phase 2 trial of XYZ-789 after serious adverse events were observed.", "News of the day; nothing is told in this one",
    "XYZ completed enrollment in its Phase 3 study and will present the trial design at the annual meeting.", "FDA granted Fast Track designation to QRS-77 for the treatment of hypertension", "XYZ reports quarterly business updates.\nSummary of Business Highlights",
    "The advisory committee voted 9 to 3 in support of the candidate, it announced. PDUFA target date of March 4, 2025 was set!", "XYZ announced topline results from its Phase 2 trial of ABC-123. The objective response rate was 42.5%",
    "XYZ announced that the study did not meet its primary endpoint.", "  \n - FDA approved KLM-42 in an expanded label approval, it announced",
)
LEADS = (
    "Pipeline: In September, we announced that our Phase 2 trial of ABC-123 met its primary endpoint of safety.", "The study is ongoing and data are expected in 2025. No new safety signals were observed.", "Overall survival was 14.2 months (NCT01234567).",
    "The company's only product candidate is ABC-123? It is in a pivotal trial.", "About XYZ Therapeutics\nIt is headquartered in a town. ABC-123 is evaluated in a Phase 1 trial.", "",
)
TAILS = ("Forward-Looking Statements\nActual results could differ materially from topline results of the trial.", "A serious adverse event was reported in the trial.", "The program was terminated and the study discontinued.")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base.spread(base.table(spark, sf_dir, "documents"))
    pick = lambda of, by: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.col("doc_id") * by, F.lit(len(of))) + 1).cast("int"))
    return d.select("doc_id", F.concat_ws("\n", pick(HEADS, 1), pick(LEADS, 5), F.coalesce("text", F.lit("")), pick(TAILS, 7)).alias("text"))


def _pick_sql(of: tuple[str, ...], by: int) -> str:
    return f"[{', '.join(map(_quoted, of))}][doc_id * {by} % {len(of)} + 1]"


def _protected(c: str) -> str:
    for i, mark in enumerate(".;!?", 1):
        c = f"regexp_replace(regexp_replace({c}, '([0-9])[{mark}]', '\\1' || chr({i}), 'g'), '[{mark}]([0-9])', chr({i}) || '\\1', 'g')"
    return c


def _white(c: str) -> str:
    return f"trim(regexp_replace({c}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


_LEFT = "regexp_replace(part, '^[ \\t\\n\\x0B\\f\\r]+', '')"
SEGMENTS = f"""
releases AS (SELECT doc_id, {_pick_sql(HEADS, 1)} || chr(10) || {_pick_sql(LEADS, 5)} || chr(10) || coalesce(text, '') || chr(10) || {_pick_sql(TAILS, 7)} AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM releases),
placed AS (SELECT doc_id, k, raw, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, {_white("raw")} AS line FROM lines),
headed AS (SELECT *, lower(line) AS low, trim(lower(line), ' :-') AS bare FROM placed WHERE line <> ''),
stated AS (
  SELECT *, regexp_matches(bare, {_quoted(T.ABOUT)}) AS about, row_number() OVER o - 1 AS n,
    coalesce(last_value(CASE WHEN regexp_matches(bare, {_quoted(T.ABOUT)}) THEN 'boilerplate' WHEN regexp_matches(low, '{T.RISKS}') THEN 'risk_factor' WHEN regexp_matches(bare, '{T.HIGHLIGHTS}') THEN 'pipeline_table' END IGNORE NULLS) OVER o, 'body') AS state
  FROM headed WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
sectioned AS (
  SELECT doc_id, k, raw, line, place, CASE WHEN regexp_matches(line, {_quoted(T.LISTED)}) AND state NOT IN ('boilerplate', 'risk_factor') THEN 'pipeline_table' WHEN state <> 'body' THEN state
    WHEN n < {T.HEADLINE_LINES} THEN 'headline' WHEN n < {T.LEAD_LINES} THEN 'lead_paragraph' ELSE 'body' END AS section, string_split_regex({_protected("raw")}, '[.;!?]') AS parts FROM stated WHERE NOT about),
parts AS (SELECT doc_id, k, section, place, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM sectioned),
cut AS (SELECT doc_id, k, section, place + coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, translate(part, chr(1) || chr(2) || chr(3) || chr(4), '.;!?') AS part FROM parts),
fitting AS (SELECT * FROM cut WHERE length({_white("part")}) BETWEEN {S.LEAST_CHARS} AND {S.MOST_CHARS}),
chosen AS (
  SELECT doc_id, section, place, part FROM fitting
  UNION ALL SELECT doc_id, section, place, raw FROM sectioned s ANTI JOIN fitting f ON f.doc_id = s.doc_id AND f.k = s.k WHERE length(line) BETWEEN {S.LEAST_CHARS} AND {S.MOST_CHARS}),
named AS (
  SELECT doc_id, CAST(place + length(part) - length({_LEFT}) AS INTEGER) AS start_char, {_white("part")} AS segment, section AS s0,
    CAST(length(regexp_replace({_LEFT}, '[ \\t\\n\\x0B\\f\\r]+$', '')) AS INTEGER) AS size FROM chosen),
segments AS (
  SELECT doc_id, start_char, start_char + size AS end_char, segment, lower(segment) AS low, CASE WHEN regexp_matches(lower(segment), '{T.RISK_SEGMENT}') THEN 'risk_factor' ELSE s0 END AS section FROM named)
"""
_RANK = "CAST(list_position([" + ", ".join(f"'{s}'" for s in T.SECTIONS) + "], section) - 1 AS INTEGER)"


@register("tx7_sections", f"WITH {SEGMENTS} SELECT doc_id, start_char, end_char, segment, section, {_RANK} AS priority FROM segments")
def tx7_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-7: segments of whole texts with offsets and sections."""
    return S.sectioned(releases(spark, sf_dir))


def _case(pairs, end: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {end} END"


def _has(pattern: str) -> str:
    return f"regexp_matches(low, {_quoted(pattern)})"


_TOLD = {n: f"({_has(p)}" + (" AND NOT finding)" if spared else ")") for n, p, spared in T.REASONS}
_TOLD[T.REASONS[0][0]] = f"({_TOLD[T.REASONS[0][0]]} OR section IN ('boilerplate', 'risk_factor'))"
_rules = lambda rules: _case([(met_sql("low", p), i) for i, (_, p, _) in enumerate(rules)])
_name = lambda names, i: f"[{', '.join(_quoted(n) if isinstance(n, str) else str(n) for n in names)}][CAST({i} AS INTEGER) + 1]"
MARKED = f"""
ended AS (SELECT *, {_RANK} AS priority, {_case([(_has(T.MISSED), "false"), (_has(T.MET), "true")])} AS endpoint FROM segments),
found AS (SELECT *, endpoint IS NOT NULL OR {_has(T.FINDING)} AS finding FROM ended),
judged AS (
  SELECT *, {_case([(c, f"'{n}'") for n, c in _TOLD.items()], f"CASE WHEN section = 'pipeline_table' THEN '{T.PIPELINE_REASON}' END")} AS reason, {_case([(_has(p), i) for i, (_, p, _, _) in enumerate(T.PHASES)])} AS phase,
    list_filter([{", ".join(f"CASE WHEN {_TOLD[n]} THEN '{n}' END" for n in T.ALWAYS_TOLD)}], lambda x: x IS NOT NULL) AS also FROM found),
marked AS (
  SELECT *, reason IS NULL OR reason = '{T.PIPELINE_REASON}' AS news, {_has(T.MENTION)} AS mention,
    (reason IS NULL OR reason = '{T.PIPELINE_REASON}') AND {_has(T.RESULT)} AND {_has(T.SUBJECT)} AND (section <> 'pipeline_table' OR {_has(T.TABLE_RESULT)}) AND (NOT {_has(T.PATIENTS)} OR {_has(T.OUTCOME)}) AS readout,
    {_rules(T.BEFORE_READOUTS)} AS before, {_rules(T.AFTER_READOUTS)} AS after FROM judged),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN news AND before IS NOT NULL THEN before ELSE 99 END, priority, start_char) AS ka, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN news AND after IS NOT NULL THEN after ELSE 99 END, priority, start_char) AS kb,
    row_number() OVER (PARTITION BY doc_id ORDER BY readout DESC, priority, start_char) AS kw, row_number() OVER (PARTITION BY doc_id ORDER BY readout AND (endpoint IS NOT NULL OR phase IS NOT NULL) DESC, priority, start_char) AS ks, row_number() OVER (PARTITION BY doc_id ORDER BY mention DESC, priority, start_char) AS km FROM marked),
texts AS (
  SELECT doc_id, arg_min(phase, start_char) FILTER (WHERE phase IS NOT NULL) AS doc_phase, arg_min(endpoint, start_char) FILTER (WHERE endpoint IS NOT NULL) AS endpoint_met, list_distinct(flatten(list(list_append(also, reason)))) AS told FROM marked GROUP BY doc_id),
winners AS (
  SELECT t.*, CASE WHEN a.doc_id IS NOT NULL THEN 'a' WHEN r.doc_id IS NOT NULL THEN 'r' WHEN b.doc_id IS NOT NULL THEN 'b' ELSE 'none' END AS t, a.before, b.after, r.endpoint AS ended, coalesce(r.phase, doc_phase) AS phase, r.low AS rlow, a.low AS alow, a.segment AS asegment,
    coalesce(a.segment, r.segment, b.segment, m.segment) AS evidence_text, coalesce(a.section, r.section, b.section, m.section) AS section, coalesce(a.start_char, r.start_char, b.start_char, m.start_char) AS start_char, coalesce(a.end_char, r.end_char, b.end_char, m.end_char) AS end_char
  FROM texts t LEFT JOIN (SELECT * FROM ranked WHERE ka = 1 AND news AND before IS NOT NULL) a USING (doc_id) LEFT JOIN (SELECT * FROM ranked WHERE kb = 1 AND news AND after IS NOT NULL) b USING (doc_id)
    LEFT JOIN (SELECT ranked.* FROM ranked JOIN texts USING (doc_id) WHERE readout AND CASE WHEN doc_phase IS NOT NULL THEN kw = 1 ELSE ks = 1 AND endpoint IS NOT NULL END) r USING (doc_id) LEFT JOIN (SELECT * FROM ranked WHERE km = 1 AND mention) m USING (doc_id)),
phased AS (SELECT *, {_name([p[3] for p in T.PHASES], "phase")} AS by_phase, {_name([p[2] for p in T.PHASES], "phase")} AS by_phase_confidence, coalesce(contains(rlow, 'pivotal'), false) OR coalesce(phase = {len(T.PHASES) - 1}, false) AS pivotal FROM winners),
labelled AS (
  SELECT *, CASE t WHEN 'a' THEN CASE WHEN {_name([r[0] for r in T.BEFORE_READOUTS], "before")} = 'committee_vote'
        THEN CASE WHEN CAST(regexp_extract(asegment, '([0-9]{{1,2}}) ?(-|to) ?([0-9]{{1,2}})', 1) AS INTEGER) > CAST(regexp_extract(asegment, '([0-9]{{1,2}}) ?(-|to) ?([0-9]{{1,2}})', 3) AS INTEGER) THEN 'fda_advisory_committee_positive' ELSE 'fda_advisory_committee_negative' END
        ELSE {_name([r[0] for r in T.BEFORE_READOUTS], "before")} END
      WHEN 'r' THEN CASE WHEN NOT ended AND (by_phase IS NULL OR by_phase NOT IN ('phase_2_readout', 'phase_3_readout')) THEN 'endpoint_failure' WHEN NOT ended THEN by_phase WHEN pivotal THEN 'pivotal_trial_readout' ELSE coalesce(by_phase, 'endpoint_success') END
      WHEN 'b' THEN {_name([r[0] for r in T.AFTER_READOUTS], "after")} ELSE 'unknown' END AS event_type FROM phased),
scored AS (
  SELECT *, CASE t WHEN 'a' THEN {_name([r[2] for r in T.BEFORE_READOUTS], "before")} WHEN 'b' THEN {_name([r[2] for r in T.AFTER_READOUTS], "after")} WHEN 'none' THEN 0.3
      ELSE CASE event_type WHEN 'endpoint_failure' THEN 0.92 WHEN 'endpoint_success' THEN 0.84 WHEN 'phase_1_readout' THEN by_phase_confidence ELSE greatest(coalesce(by_phase_confidence, 0), CASE WHEN ended IS NULL THEN 0.82 ELSE 0.86 END) END END AS confidence,
    event_type IN ({", ".join(f"'{x}'" for x in T.READOUTS)}) AS is_readout, event_type IN ({", ".join(f"'{x}'" for x in T.DESIGNATIONS)}) AS designation, event_type IN ({", ".join(f"'{x}'" for x in T.APPROVALS)}) AS approval,
    event_type IN ({", ".join(f"'{x}'" for x in T.NEGATIVE)}) AS negative FROM labelled)
"""


@register(
    "tx7_trial_catalysts",
    f"""WITH {SEGMENTS}, {MARKED}
SELECT doc_id, event_type, CAST(confidence AS DOUBLE) AS confidence, evidence_text, section, start_char, end_char, endpoint_met, {_case([(f"event_type = '{e}'", f"'{a}'") for e, a in T.ACTIONS.items()])} AS fda_action,
  approval OR negative OR event_type IN ('fda_advisory_committee_positive', 'endpoint_success') OR (event_type IN ('phase_1_readout', 'phase_2_readout', 'phase_3_readout', 'pivotal_trial_readout') AND endpoint_met IS NOT NULL) AS binary_catalyst,
  CASE WHEN negative OR endpoint_met = false THEN 'negative' WHEN approval OR designation OR event_type IN ('fda_advisory_committee_positive', 'endpoint_success') OR (endpoint_met AND is_readout) THEN 'positive' WHEN is_readout THEN 'mixed' ELSE 'unknown' END AS direction,
  CASE WHEN event_type IN ('fda_complete_response_letter', 'phase_3_readout', 'pivotal_trial_readout', 'trial_halt', 'trial_discontinuation', 'endpoint_failure') THEN 'high'
    WHEN approval OR event_type IN ('fda_advisory_committee_positive', 'fda_advisory_committee_negative', 'phase_2_readout', 'safety_signal', 'endpoint_success') THEN 'medium' WHEN designation OR event_type = 'phase_1_readout' THEN 'low' ELSE 'unknown' END AS materiality,
  array_to_string(list_sort(list_distinct(list_concat(list_filter(told, lambda x: x IS NOT NULL), list_filter([CASE WHEN t = 'r' AND ended IS NULL THEN 'endpoint_direction_unclear' END, CASE WHEN t = 'a' AND contains(alow, 'clinical hold') THEN 'safety_review_required' END,
    CASE WHEN event_type = 'safety_signal' THEN 'safety_issue_present' END, CASE WHEN designation THEN 'designation_only_weaker_signal' END], lambda x: x IS NOT NULL)))), ';') AS quality_flags
FROM scored""",
)
def tx7_trial_catalysts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-7, TX-9, PJ-18: the event of each release by section and precedence, with evidence and derived fields."""
    return S.trial_events(releases(spark, sf_dir))


def _fact_sql(name: str, patterns, need: str | None, unit: str, confidence: float) -> str:
    stop = f" AND v NOT IN ({', '.join(map(_quoted, T.NOT_NAMES))})" if name in ("trial_name", "drug_asset") else ""
    firsts = "coalesce(" + ", ".join(f"(SELECT v FROM (SELECT regexp_extract(segment, {_quoted(p)}, 1) AS v) WHERE v <> ''{stop})" for p in patterns) + ")"
    value, sure, where = "v", str(confidence), "v IS NOT NULL"
    if name == "nct_id":
        value = "upper(v)"
    elif name == "primary_endpoint":
        cleaned = "trim(regexp_replace(coalesce(v, ''), '(?i)\\b(was|were)\\s+(met|not met|achieved).*$', ''), ' ,')"
        value, sure, where = f"substr(coalesce(nullif({cleaned}, ''), segment), 1, 220)", f"CASE WHEN {cleaned} <> '' THEN 0.76 ELSE 0.66 END", "contains(low, 'primary endpoint')"
    elif name == "indication":
        value = "trim(regexp_replace(v, '(?i)\\s+(and|with) (announced|reported|met|failed).*$', ''), ' ,')"
        where = f"length({value}) BETWEEN 3 AND 140"
    elif name == "sole_asset":
        value = "'1'"
    needs = "".join(f" AND regexp_matches(low, {_quoted(n)})" for n in (need or "").split("&") if n)
    return f"SELECT doc_id, start_char, end_char, section, segment, '{name}' AS fact_name, {value} AS value, '{unit}' AS unit, {sure} AS confidence FROM (SELECT *, {firsts} AS v FROM segments) WHERE {where}{needs}"


_OTHERS = f"""
  SELECT doc_id, start_char, end_char, section, segment, 'trial_phase', {_name([p[0] for p in T.PHASES], "i")}, 'category', {_name([p[2] for p in T.PHASES], "i")} FROM (SELECT *, {_case([(_has(p), i) for i, (_, p, _, _) in enumerate(T.PHASES)])} AS i FROM segments) WHERE i IS NOT NULL
  UNION ALL SELECT doc_id, start_char, end_char, section, segment, 'endpoint_met', CASE WHEN {_has(T.MISSED)} THEN 'false' ELSE 'true' END, 'boolean', 0.92 FROM segments WHERE {_has(T.MISSED)} OR {_has(T.MET)}
  UNION ALL SELECT doc_id, start_char, end_char, section, segment, 'safety_issue', CASE WHEN {_has(T.HARMLESS)} THEN 'false' ELSE 'true' END, 'boolean', 0.82 FROM segments WHERE {_has("safety signal|serious adverse|patient death|toxicity|dose-limiting|clinical hold|boxed warning")}"""


@register(
    "tx8_trial_facts",
    f"""WITH {SEGMENTS}, stating AS ({" UNION ALL ".join(_fact_sql(*f) for f in T.FACTS)} UNION ALL {_OTHERS}),
firsts AS (SELECT * FROM stating QUALIFY row_number() OVER (PARTITION BY doc_id, fact_name ORDER BY start_char) = 1)
SELECT doc_id, fact_name, value, CASE WHEN unit = 'percent' THEN TRY_CAST(value AS DOUBLE) / 100 WHEN unit IN ('number', 'ratio', 'count') THEN TRY_CAST(value AS DOUBLE) END AS number, CASE WHEN unit = 'percent' THEN 'proportion' ELSE unit END AS unit,
  CAST(confidence AS DOUBLE) AS confidence, section, start_char, end_char, segment AS evidence_text FROM firsts WHERE NOT (fact_name = 'safety_issue' AND value = 'false')""",
)
def tx8_trial_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-8: facts of each release with evidence, span and section."""
    return S.trial_facts(releases(spark, sf_dir))


@register(
    "sc20_observation_feed",
    """SELECT 's' || s_suppkey AS slug, s_name AS title, s_nationkey % 2 = 0 AS official_source, [n_name, CAST(s_nationkey AS VARCHAR)] AS tags, s_suppkey % 50 AS sample_size_hint
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0 AND n_name IS NOT NULL""",
)
def sc20_observation_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-20, UD-1: suppliers written as a feed of JSON lines, read back by the data source with filters pushed into it."""
    from afterbell.sources import readers
    from afterbell.sources.shared import shared_dir

    readers.register(spark)
    s, n = base.table(spark, sf_dir, "supplier"), base.table(spark, sf_dir, "nation")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("s"), "s_suppkey").alias("slug"), F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 3 == 0, "other").otherwise("feed").alias("source_kind"), (F.col("s_nationkey") % 2 == 0).alias("official_source"),
        F.array("n_name", F.col("s_nationkey").cast("string")).alias("tags"), (F.col("s_suppkey") % 50).cast("int").alias("sample_size_hint"),
    )
    folder = f"{shared_dir(spark)}/afterbell/feed-{uuid.uuid4().hex}"
    rows.write.json(folder)
    return spark.read.format("observations").load(folder).where("source_kind = 'feed'").select("slug", "title", "official_source", "tags", "sample_size_hint")


#: Openings of filings of 2024, and what they say: facts (name, value), event, amount and its source.
DEALS = (
    ("XYZ announced a public offering of 10,000,000 shares of common stock at a public offering price of $2.50 per share. Gross proceeds are expected to be approximately $25.0 million before expenses.", (("shares_offered", 1e7), ("price_per_share", 2.5), ("gross_proceeds", 25e6)), "completed_equity_offering", 25e6, "gross_proceeds"),
    ("It entered into a registered direct offering of 35,500,000 shares of Class A common stock, par value $0.0001 per share, at a price of $8.50 per Share, for gross proceeds of $301.75 million.", (("shares_offered", 35.5e6), ("price_per_share", 8.5), ("gross_proceeds", 301.75e6)), "registered_direct_offering", 301.75e6, "gross_proceeds"),
    ("A private placement, a sale of 1,000,000 shares at a price of $8.50 per share, was completed. Each warrant is exercisable for one share at an exercise price of $11.50 per share.", (("shares_offered", 1e6), ("price_per_share", 8.5)), "private_placement", 8.5e6, "shares_offered_x_price_per_share"),
    ("XYZ Announces Redemption of Public Warrants. The public warrants are exercisable for shares of common stock at a price of $11.50 per share.", (), "unknown", None, None),
    ("It entered into an at-the-market offering program under which it may sell shares having an aggregate offering price of up to $150 million from time to time.", (("atm_capacity", 150e6),), "atm_program_created", 150e6, "atm_capacity"),
    ("Calculated pursuant to Rule 457(o) based on the proposed maximum aggregate offering price of $75,000,000 of the shelf registration.", (), "shelf_registration", None, None),
    ("Up to 504,859,164 shares, assuming the sale of $8,000,000 of shares at an assumed offering price of $7.77 per share, which was the last reported sale price.", (), "unknown", None, None),
    ("On June 23, 2023, we issued 6,337,039 shares of Class A common stock and received gross proceeds of $25,000,000.\nOn January 5, 2024, we issued 2,000,000 shares.", (("shares_offered", 2e6),), "unknown", None, None),
    ("XYZ priced $300 million aggregate principal amount of convertible senior notes; the conversion price is $12.50 per share.", (("convertible_principal", 300e6), ("conversion_price", 12.5)), "convertible_note_offering", 300e6, "convertible_principal"),
    ("Under exchange agreements, $40 million principal amount of convertible notes was exchanged for shares", (), "convertible_note_offering", None, None),
)


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base.spread(base.table(spark, sf_dir, "documents"))
    lead = F.element_at(F.array(*[F.lit(x[0]) for x in DEALS]), (F.col("doc_id") % len(DEALS) + 1).cast("int"))
    return d.select("doc_id", F.concat_ws("\n", lead, F.coalesce("text", F.lit(""))).alias("text"), F.lit("2024-01-10 16:05:00").cast("timestamp").alias("event_time"))


def _number_sql(v: float | None) -> str:
    return "NULL" if v is None else f"{v!r}::DOUBLE"


@register(
    "tx13_financing_facts",
    "WITH f(k, fact_name, value) AS (VALUES " + ", ".join(f"({i}, '{n}', {v!r}::DOUBLE)" for i, x in enumerate(DEALS) for n, v in x[1]) + f") SELECT doc_id, fact_name, value FROM documents JOIN f ON doc_id % {len(DEALS)} = k",
)
def tx13_financing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-13, TX-7: terms of financings; background deals, fee tables, assumed prices and exercise prices are none."""
    from afterbell.operators.financing import financing_facts

    return financing_facts(deals(spark, sf_dir)).select("doc_id", "fact_name", "value")


@register(
    "pj18_financing_fields",
    "WITH f(k, event_type, amount, amount_source) AS (VALUES " + ", ".join(f"({i}, '{x[2]}', {_number_sql(x[3])}, {'NULL' if x[4] is None else _quoted(x[4])})" for i, x in enumerate(DEALS))
    + f""") SELECT doc_id, event_type, amount, amount_source, event_type IN ('completed_equity_offering', 'registered_direct_offering', 'private_placement', 'convertible_note_offering', 'atm_program_usage_reported') AS completed,
      event_type IN ('atm_program_created', 'shelf_registration') AS capacity_only FROM documents JOIN f ON doc_id % {len(DEALS)} = k""",
)
def pj18_financing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-18: best amount with precedence and implied amounts, and flags of financings."""
    from afterbell.operators.financing import financing_facts, financing_fields

    d = deals(spark, sf_dir)
    return financing_fields(d, financing_facts(d)).select("doc_id", "event_type", "amount", "amount_source", "completed", "capacity_only")
