"""Domain rules, packs, audits and alerts on texts that are put together from sentences by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.functions import domains as DO
from afterbell.functions import taxonomies as T
from afterbell.operators import audits as A
from afterbell.operators import discovery as D
from afterbell.operators import evidence as E
from afterbell.operators import packs as PK
from afterbell.operators import parsers as PA
from afterbell.plans import base
from afterbell.plans.discovery import _cte, gated, observations
from afterbell.plans.registry import register
from afterbell.plans.study import rounded, study_frame

SENTENCES = (
    "Item 1.05 material cybersecurity incident.", "We identified a cybersecurity incident with ransomware on our systems.", "Customer data and patient records were accessed by a third-party vendor.",
    "There was no material impact on operations.", "The outage disrupted production and service.", "Our cybersecurity risk management is described under risk factors.", "A vendor disclosed a zero-day vulnerability.",
    "As previously reported, the investigation is ongoing.", "No evidence that personal information was exposed has been found.", "Forensic experts and outside counsel help us.", "The impact is not yet determined and its scope is open.",
    "The company regained compliance with the listing rule.", "A hearing panel granted an extension.", "The notice concerns the minimum bid price.", "An event of default led to acceleration of the notes.", "It recorded a goodwill impairment.", "It filed for bankruptcy under chapter 11.",
    "The phase 3 trial met its primary endpoint.", "The FDA issued a complete response letter.", "The study was halted by a clinical hold.", "The company completed enrollment and expects to present an abstract.", "FDA approval was granted for the drug.", "The advisory committee voted against it.", "The phase 2 study did not meet the primary endpoint.",
    "We dosed first patient; actual results could differ.", "Diluted EPS was $1.25 against $(0.40) a year ago, up 12.5% or 3 percent.", "Margins fell (4.5)% (7% in constant currency, (2%)) while $2.50 per share was expected.", "Nothing else happened here.", "Employee personal information was viewed.", "Costs associated with the response were small.",
)
_N = len(SENTENCES)
_LIST = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SENTENCES) + "]"
_PLACES = ((1, 0), (7, 3), (11, 5))
TEXTS = "t AS (SELECT p_partkey AS doc_id, " + " || ' ' || ".join(f"{_LIST}[(p_partkey * {a} + p_size * {b}) % {_N} + 1]" for a, b in _PLACES) + " AS text, p_size, p_brand, p_type FROM part)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base.spread(base.table(spark, sf_dir, "part"))
    known = F.array(*[F.lit(s) for s in SENTENCES])
    parts = [F.element_at(known, ((F.col("p_partkey") * a + F.col("p_size") * b) % _N + 1).cast("int")) for a, b in _PLACES]
    return p.select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", *parts).alias("text"), "p_size", "p_brand", "p_type")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def met_sql(low: str, pattern) -> str:
    parts = (pattern,) if isinstance(pattern, str) else pattern
    return "(" + " AND ".join(f"NOT regexp_matches({low}, {_quoted(p[1:])})" if p.startswith("!") else f"regexp_matches({low}, {_quoted(p)})" for p in parts) + ")"


def label_sql(low: str, rules, default: str, confidence: float) -> str:
    one = lambda i, end: "CASE " + " ".join(f"WHEN {met_sql(low, r[1])} THEN {_quoted(r[0]) if i == 0 else r[2]}" for r in rules) + f" ELSE {end} END"
    return f"{one(0, _quoted(default))} AS label, CAST({one(2, confidence)} AS DOUBLE) AS confidence"


def flags_sql(low: str, rules) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {met_sql(low, p)} THEN '{n}' END" for n, p in rules) + ")"


_LOW = "WITH " + TEXTS + ", l AS (SELECT *, lower(text) AS low, 'item ' || ['1.03', '2.04', '2.06', '3.01', '8.01'][p_size % 5 + 1] || chr(10) || lower(text) AS filed FROM t) "


def _labels(df: DataFrame, text: Column, rules, default: str, confidence: float) -> DataFrame:
    return df.select("doc_id", T.first_label(text, rules, default, confidence).alias("x")).select("doc_id", "x.*")


@register("tx7_incident_events", _LOW + "SELECT doc_id, " + label_sql("low", DO.INCIDENT_EVENTS, "generic_cyber_risk_control", 0.35) + " FROM l")
def tx7_incident_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-7, PJ-17: event type of incident texts."""
    return _labels(texts(spark, sf_dir), F.col("text"), DO.INCIDENT_EVENTS, "generic_cyber_risk_control", 0.35)


@register("tx7_distress_events", _LOW + "SELECT doc_id, " + label_sql("filed", DO.DISTRESS_EVENTS, "unknown", 0.0) + " FROM l")
def tx7_distress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-7, PJ-17: event type of distress filings by item and text."""
    return _labels(texts(spark, sf_dir), F.concat(F.lit("item "), _pick(("1.03", "2.04", "2.06", "3.01", "8.01"), "p_size"), F.lit("\n"), F.col("text")), DO.DISTRESS_EVENTS, "unknown", 0.0)


@register("tx7_trial_events", _LOW + "SELECT doc_id, " + label_sql("low", DO.TRIAL_EVENTS, "other", 0.3) + " FROM l")
def tx7_trial_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-7, PJ-17: event type of trial news."""
    return _labels(texts(spark, sf_dir), F.col("text"), DO.TRIAL_EVENTS, "other", 0.3)


@register("tx9_false_positive_flags", _LOW + "SELECT doc_id, " + flags_sql("low", DO.INCIDENT_FLAGS) + " AS incident_flags, " + flags_sql("low", DO.TRIAL_FLAGS) + " AS trial_flags FROM l")
def tx9_false_positive_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-9: hard negatives of incident texts and false positives of trial news."""
    return texts(spark, sf_dir).select("doc_id", *[F.array_join(DO.flags(F.col("text"), r), ";").alias(n) for n, r in (("incident_flags", DO.INCIDENT_FLAGS), ("trial_flags", DO.TRIAL_FLAGS))])


_NUMBER = r"([0-9]+(?:\.[0-9]+)?)\)?\s?(?:%|percent\b)"
_SHARE = r"\(?-?\$\s?\(?-?([0-9]+\.[0-9]{2})\b"


@register(
    "tx5_percents_per_share",
    "WITH " + TEXTS + rf""", r AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '(?i)\beps\b|earnings per share') THEN regexp_replace(text, '(?is)^.*?(\beps\b|earnings per share)', '') ELSE text END AS rest FROM t)
    SELECT doc_id, list_sum(list_transform(list_zip(regexp_extract_all(text, '\(?-?{_NUMBER}\)?', 0), regexp_extract_all(text, '\(?-?{_NUMBER}\)?', 1)), lambda x: CASE WHEN x[1] LIKE '%-%' OR (x[1] LIKE '(%' AND x[1] LIKE '%)%') THEN -1.0 ELSE 1.0 END * CAST(x[2] AS DOUBLE))) AS percents,
      list_sum(list_transform(list_zip(regexp_extract_all(rest, '{_SHARE}', 0), regexp_extract_all(rest, '{_SHARE}', 1)), lambda x: CASE WHEN regexp_matches(x[1], '^[(-]|\$\s?[(-]') THEN -1.0 ELSE 1.0 END * CAST(x[2] AS DOUBLE))) AS per_share FROM r""",
)
def tx5_percents_per_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-5: percentages and amounts per share, here by their sums."""
    total = lambda c, by: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x * by))
    return texts(spark, sf_dir).select("doc_id", total(E.percents(F.col("text")), 100.0).alias("percents"), total(E.per_share(F.col("text")), 1.0).alias("per_share"))


def _claims_sql(pack: PK.Pack) -> str:
    """Per rule the first sentence that holds its pattern; the sentences hold whole matches."""
    parts = []
    for r in pack.rules:
        kept = [f"regexp_matches(e, {_quoted(r.need)})"] if r.need else []
        if r.reject:
            spared = f" AND NOT regexp_matches(e, {_quoted(r.spared)})" if r.spared else ""
            kept.append(f"NOT (regexp_matches(e, {_quoted(r.reject)}){spared})")
        where = " AND ".join(["e IS NOT NULL", *kept])
        value = "e" if r.value == "evidence" else _quoted(r.value)
        parts.append(f"SELECT doc_id, '{r.field}' AS field_name, {value} AS value, {r.confidence}::DOUBLE AS confidence, e AS evidence_text FROM (SELECT doc_id, list_filter(parts, lambda x: regexp_matches(x, {_quoted(r.pattern)}))[1] AS e FROM c) WHERE {where}")
    return " UNION ALL ".join(parts)


def _pack_sql(pack: PK.Pack) -> str:
    # a sentence ends at each full stop: decimals and item numbers end one too
    pieces = r"list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]'), lambda x: trim(x)), lambda x: x <> '')"
    return f"WITH {TEXTS}, c AS (SELECT doc_id, {pieces} AS parts FROM t WHERE regexp_matches(text, {_quoted(pack.detector.pattern)})) {_claims_sql(pack)}"


@register("tx4_press_claims", _pack_sql(PK.PRESS_PACK))
def tx4_press_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-4, UD-2, UD-3, UD-6: candidates and claims of the press-release pack."""
    d = texts(spark, sf_dir).select("doc_id", "text")
    out = PK.extract(d, PK.detect(d, PK.PRESS_PACK), PK.PRESS_PACK)
    return out.select(F.col("source_doc_id").alias("doc_id"), "field_name", "value", "confidence", "evidence_text")


@register("ud5_compatibility", "SELECT 'company_press_releases' AS plugin, u.name, CAST(u.score AS DOUBLE) AS score, CASE WHEN u.name IN ('doc_id', 'text', 'source_url') THEN 'required' ELSE 'optional' END AS basis FROM (SELECT round(avg(CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE 1.0 END), 6) AS published FROM part) p, (VALUES ('doc_id', 1.0), ('text', 1.0), ('source_url', 0.0), ('published_at', NULL), ('company_name', 1.0), ('domain', 0.0)) v(name, fixed), LATERAL (SELECT v.name AS name, coalesce(v.fixed, p.published) AS score) u")
def ud5_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD-5: how well documents suit a pack's manifest."""
    d = texts(spark, sf_dir).withColumns({"published_at": F.when(F.col("p_size") % 4 != 0, "2024-01-01"), "company_name": F.col("p_brand"), "domain": F.lit(" ")})
    return rounded(PK.compatibility(d, PK.PRESS_PACK.manifest))


@register(
    "ud1_press_documents",
    "WITH " + TEXTS + " SELECT doc_id::VARCHAR AS source_record_id, CASE WHEN p_size % 2 = 0 THEN 'canonical' ELSE 'secondary' END AS source_role, trim(regexp_replace(p_type || chr(10) || text, '\\s+', ' ', 'g')) AS text, sha256(trim(regexp_replace(p_type || chr(10) || text, '\\s+', ' ', 'g'))) AS content_hash FROM t",
)
def ud1_press_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD-1: normalised documents of an adapter."""
    rows = texts(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("source_record_id"), F.lit("u").alias("source_url"), F.col("p_type").alias("title"), F.lit("2024-01-01").alias("published_at"),
        F.when(F.col("p_size") % 2 == 1, "secondary").otherwise(" ").alias("source_role"), F.regexp_replace("text", " was ", " <b>was</b> ").alias("text"),
    )
    return PK.PRESS_ADAPTER.normalise(rows).select("source_record_id", "source_role", "text", "content_hash")


_SIZES = ", ".join(
    "CASE WHEN v IS NULL THEN 'unknown' " + " ".join(f"WHEN v < {b} THEN '{n}'" for b, n in bounds) + f" ELSE '{last}' END AS {cuts}" for cuts, (bounds, last) in DO.SIZE_CUTS.items()
)


@register("pj10_size_buckets", f"WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice * o_totalprice END AS v FROM orders) SELECT o_orderkey, {_SIZES} FROM m")
def pj10_size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-10: the three sets of size buckets."""
    o = base.table(spark, sf_dir, "orders")
    v = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") * F.col("o_totalprice"))
    return o.select("o_orderkey", *[DO.size_bucket(v, cuts).alias(cuts) for cuts in DO.SIZE_CUTS])


_KINDS = ("completed_equity_offering", "private_placement", "convertible_note_offering", "atm_program_created", "shelf_registration", "going_concern_warning", "", "unknown")
_SECURITIES = ("common_stock", "convertible_notes", "", "warrants", "unknown")
_FACTS = ("price_per_share", "gross_proceeds", "atm_capacity", "conversion_price", "shares_offered", "shelf_capacity", "convertible_principal")
_PROOF = ("par value $0.001", "the exercise price", "a registration fee", "assumed offering price", "a commission of 3%", "option stock", "exchange agreement", "on March 3, 2021", "we may offer", "sold for cash", "a warrant")


def _pick(names, key: str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.expr(key) % len(names) + 1).cast("int"))


def _pick_sql(names, key: str) -> str:
    return "[" + ", ".join(_quoted(n) for n in names) + f"][{key} % {len(names)} + 1]"


_ERRORS = f"e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'ok' ELSE 'wrong' END AS status, {_pick_sql(_KINDS, 'o_orderkey')} AS event_type, {_pick_sql(_SECURITIES, 'o_custkey')} AS security_type, {_pick_sql(_FACTS, '(o_orderkey // 3)')} AS fact_name, {_pick_sql(_PROOF, '(o_orderkey + o_custkey)')} AS evidence_text FROM orders)"
_SLICE = """CASE WHEN event_type IN ('going_concern_warning', 'liquidity_warning') THEN 'liquidity_warnings' WHEN event_type = 'convertible_note_offering' OR security_type = 'convertible_notes' OR fact_name IN ('convertible_principal', 'conversion_price') THEN 'convertible_debt'
  WHEN event_type = 'atm_program_created' OR fact_name = 'atm_capacity' THEN 'atm_programs' WHEN event_type = 'shelf_registration' OR fact_name = 'shelf_capacity' THEN 'shelf_prospectus'
  WHEN event_type = 'completed_equity_offering' AND security_type IN ('', 'common_stock', 'unknown') OR event_type = 'private_placement' AND security_type = 'common_stock' THEN 'completed_common_stock' ELSE 'other' END"""
_REASON = "CASE WHEN status = 'ok' THEN '' " + " ".join(
    "WHEN " + " AND ".join([*([f"regexp_matches(lower(evidence_text), {_quoted(p)})"] if p else []), *([f"fact_name IN ({', '.join(_quoted(x) for x in f.split('|'))})"] if f else [])]) + f" THEN '{n}'" for n, p, f in DO.TRIAGE
) + " ELSE 'ambiguous_event_type' END"


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "ok").otherwise("wrong").alias("status"), _pick(_KINDS, "o_orderkey").alias("event_type"), _pick(_SECURITIES, "o_custkey").alias("security_type"),
        _pick(_FACTS, "o_orderkey div 3").alias("fact_name"), _pick(_PROOF, "o_orderkey + o_custkey").alias("evidence_text"),
    )


@register("pj19_financing_slices", f"WITH {_ERRORS} SELECT o_orderkey, {_SLICE} AS slice, {_REASON} AS reason FROM e")
def pj19_financing_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-19: audit slice and failure reason of each row."""
    e = errors(spark, sf_dir)
    return e.select("o_orderkey", DO.financing_slice(F.col("event_type"), F.col("security_type"), F.col("fact_name")).alias("slice"), DO.triage_reason(F.col("status"), F.col("fact_name"), F.col("evidence_text")).alias("reason"))


@register(
    "ag25_audit_triage",
    f"""WITH {_ERRORS}, r AS (SELECT {_REASON} AS reason, fact_name, {_SLICE} AS slice FROM e)
    SELECT CASE grouping_id(reason, fact_name, slice) WHEN 3 THEN 'reason' WHEN 5 THEN 'fact' WHEN 6 THEN 'slice' ELSE 'all' END AS level, reason, fact_name, slice, count(*) AS failures FROM r WHERE reason <> ''
    GROUP BY GROUPING SETS ((reason), (fact_name), (slice), (reason, fact_name, slice))""",
)
def ag25_audit_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-25: failures by reason, fact and slice."""
    return A.triage(errors(spark, sf_dir))


_ITEM_4 = ("to nominate directors in a proxy contest", "no material change", "strategic alternatives for the issuer", "the sale of the company", "investment purposes", "seek control of the issuer", "ceased to be a beneficial owner", "the founder and chief executive", "")
_OWNERS = ("Elliott Fund", "Someone", "A Bank", "Starboard LP")
_CHANGES = ("-1.5", "0.2", "2.0", "NULL")


@register(
    "pj17_activism",
    f"""WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'SC 13G' ELSE 'SC 13D/A' END AS form, o_orderkey % 3 > 0 AS amended, {_pick_sql(_ITEM_4, 'o_orderkey')} AS low, lower({_pick_sql(_OWNERS, 'o_custkey')}) AS owner, [-1.5, 0.2, 2.0, NULL][(o_orderkey // 7) % 4 + 1]::DOUBLE AS change FROM orders),
    b AS (SELECT *, regexp_matches(low, '{DO.CONTROL}') AS control, regexp_matches(low, '{DO.BOARD}') AS board, regexp_matches(low, '{DO.SALE}') AS sale, regexp_matches(low, '{DO.CONTROL}') OR regexp_matches(owner, '{DO.KNOWN_ACTIVISTS}') AS activist FROM f)
    SELECT o_orderkey, CASE WHEN contains(form, '13G') THEN 'passive_13g_control' WHEN regexp_matches(low, '{DO.EXIT}') THEN 'exit_amendment' WHEN amended AND change < 0 THEN 'ownership_decrease_amendment'
      WHEN amended AND (regexp_matches(low, '{DO.NO_CHANGE}') OR coalesce(abs(change) < 0.5, false)) AND NOT (board OR sale OR activist) THEN 'passive_or_ambiguous_13d' WHEN regexp_matches(low, '{DO.INSIDER_WORDS}') AND NOT (activist OR sale OR board) THEN 'passive_or_ambiguous_13d'
      WHEN sale THEN CASE WHEN contains(low, 'sale') OR contains(low, 'sell the company') THEN 'sale_pressure' ELSE 'strategic_alternatives_13d' END WHEN regexp_matches(low, '{DO.BOARD_CAMPAIGN}') THEN 'board_seat_campaign' WHEN control THEN 'control_intent_13d'
      WHEN amended AND change > 0 THEN 'ownership_increase_amendment' WHEN activist THEN 'initial_activist_13d' ELSE 'passive_or_ambiguous_13d' END AS event_type FROM b""",
)
def pj17_activism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-17: event type of ownership filings."""
    change = F.element_at(F.array(F.lit(-1.5), F.lit(0.2), F.lit(2.0), F.lit(None).cast("double")), (F.expr("(o_orderkey div 7) % 4") + 1).cast("int"))
    o = base.table(spark, sf_dir, "orders")
    found = DO.activism(F.when(F.col("o_orderkey") % 13 == 0, "SC 13G").otherwise("SC 13D/A"), F.col("o_orderkey") % 3 > 0, _pick(_ITEM_4, "o_orderkey"), change, _pick(_OWNERS, "o_custkey"))
    return o.select("o_orderkey", found["event_type"].alias("event_type"))


_CODES, _TITLES = ("P", "S", "M", "F", "G", "A", "X"), ("Chief Executive Officer", "CFO", "", "Chair")


@register(
    "pj17_insider_classes",
    f"""WITH i AS (SELECT l_orderkey, l_linenumber, {_pick_sql(_CODES, '(l_orderkey + l_linenumber)')} AS code, CASE WHEN l_partkey % 8 = 0 THEN 'D' ELSE 'A' END AS got, l_suppkey % 11 = 0 AS derivative, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END AS shares, l_extendedprice AS price, l_partkey % 7 = 0 AS planned,
      lower({_pick_sql(_TITLES, 'l_partkey')}) AS title, l_suppkey % 2 = 0 AS director, l_suppkey % 3 = 0 AS officer, l_suppkey % 5 = 0 AS ten FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN derivative OR code = 'M' THEN 'option_exercise' WHEN code = 'F' THEN 'tax_withholding' WHEN code IN ('G', 'J', 'A', 'D') THEN 'non_open_market_transaction' WHEN code = 'S' OR got = 'D' THEN 'sale_cluster' WHEN code <> 'P' THEN 'non_open_market_transaction'
      WHEN planned THEN 'planned_transaction' WHEN got <> 'A' OR NOT coalesce(shares > 0 AND price > 0, false) THEN 'non_open_market_transaction' WHEN ten AND NOT (director OR officer) THEN 'ten_percent_owner_purchase' WHEN contains(title, 'chief executive') OR title = 'ceo' THEN 'ceo_purchase'
      WHEN contains(title, 'chief financial') OR title = 'cfo' THEN 'cfo_purchase' WHEN director THEN 'director_purchase' ELSE 'open_market_purchase' END AS class FROM i""",
)
def pj17_insider_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-17: class of insiders' transactions."""
    li = base.table(spark, sf_dir, "lineitem")
    flag = lambda c, n: F.col(c) % n == 0
    found = DO.insider_class(
        _pick(_CODES, "l_orderkey + l_linenumber"), F.when(flag("l_partkey", 8), "D").otherwise("A"), flag("l_suppkey", 11), F.when(~flag("l_partkey", 10), F.col("l_quantity")), F.col("l_extendedprice"), flag("l_partkey", 7),
        _pick(_TITLES, "l_partkey"), flag("l_suppkey", 2), flag("l_suppkey", 3), flag("l_suppkey", 5),
    )
    return li.select("l_orderkey", "l_linenumber", found.alias("class"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as audit rows, with all columns that the keys ask for; many share a key."""
    o = base.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), (c % n).cast("string"))
    return o.select(
        k.alias("event_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("selected_time"), text("t", 40).alias("ticker"), text("Own", 3).alias("owner"), F.date_format("o_orderdate", "yyyy-MM").alias("transaction_date"), F.lit("p").alias("code"),
        (k % 3).cast("double").alias("shares"), F.when(k % 4 > 0, 2.5).alias("price"), text("x", 30).alias("target"), text("y", 5).alias("acquirer"), F.col("o_orderpriority").alias("event_type"), F.date_format("o_orderdate", "yyyy-MM").alias("event_date"),
        F.lit("SC 13D").alias("filing_type"), F.when(k % 5 > 0, text("HTTP://u", 90)).alias("source_url"), F.when(k % 6 == 0, text("acc", 200)).alias("accession"), F.lit("4.02").alias("item"), (k % 2).cast("string").alias("periods"),
        F.date_format("o_orderdate", "yyyy").alias("discovered"), F.lit(None).cast("string").alias("determined"), F.date_format("o_orderdate", "yyyy-MM").alias("reaction_date"), F.when(k % 3 == 0, text("Drug", 4)).alias("asset"), F.when(k % 3 == 1, text("NCT", 6)).alias("trial_id"), F.lit(None).cast("string").alias("indication"),
        (k % 10 == 0).alias("amended"), (k % 12 == 0).alias("known_before"),
    )


_AUDITED = """a AS (SELECT o_orderkey AS event_id, strftime(o_orderdate, '%Y-%m-%d') AS selected_time, upper('t' || o_custkey % 40) AS ticker, lower('Own' || o_custkey % 3) AS owner, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y') AS year,
  CASE WHEN o_orderkey % 4 > 0 THEN '2.5000' ELSE '' END AS price, printf('%.4f', (o_orderkey % 3)::DOUBLE) AS shares, upper('x' || o_custkey % 30) AS target, upper('y' || o_custkey % 5) AS acquirer, o_orderpriority AS event_type, CASE WHEN o_orderkey % 5 > 0 THEN 'http://u' || o_custkey % 90 ELSE '' END AS source_url,
  CASE WHEN o_orderkey % 6 = 0 THEN 'acc' || o_custkey % 200 END AS accession, (o_orderkey % 2)::VARCHAR AS periods, CASE WHEN o_orderkey % 3 = 0 THEN lower('Drug' || o_custkey % 4) WHEN o_orderkey % 3 = 1 THEN lower('NCT' || o_custkey % 6) ELSE '' END AS asset, o_orderkey % 10 = 0 AS amended, o_orderkey % 12 = 0 AS known_before FROM orders)"""
_KEYS = {
    "au1_insider_duplicates": ("insider", "concat_ws('|', ticker, owner, month, 'P', shares, price)", "amended", None),
    "au2_deal_duplicates": ("deal", "concat_ws('|', target, acquirer, event_type, month, price)", None, None),
    "au3_ownership_duplicates": ("ownership", "concat_ws('|', ticker, owner, 'SC 13D', source_url)", None, None),
    "au4_accounting_duplicates": ("accounting", "coalesce(accession, concat_ws('|', ticker, '4.02', periods, month))", None, None),
    "au5_incident_duplicates": ("incident", "concat_ws('|', ticker, year, '', source_url)", None, "known_before"),
    "au6_trial_duplicates": ("trial", "concat_ws('|', ticker, month, event_type, asset)", None, None),
}


def _register_audits() -> None:
    for name, (domain, key, amended, excluded) in _KEYS.items():
        risk = "CASE WHEN n > 1 AND amended THEN 'high' WHEN n > 1 THEN 'medium' ELSE 'low' END" if amended else "CASE WHEN n > 1 THEN 'medium' ELSE 'low' END"
        counts = "k = 1 AND NOT known_before" if excluded else "k = 1"
        sql = f"""WITH {_AUDITED}, w AS (SELECT *, {key} AS duplicate_key FROM a), r AS (SELECT *, count(*) OVER (PARTITION BY duplicate_key) AS n, row_number() OVER (PARTITION BY duplicate_key ORDER BY selected_time, event_id) AS k, first(event_id) OVER (PARTITION BY duplicate_key ORDER BY selected_time, event_id) AS canonical_event_id FROM w)
        SELECT event_id, duplicate_key, n AS duplicate_count, canonical_event_id, CASE WHEN n = 1 THEN 'clear' WHEN k = 1 THEN 'primary' ELSE 'duplicate' END AS duplicate_status, {risk} AS duplicate_risk, {counts} AS counts_once FROM r"""

        def build(spark: SparkSession, sf_dir: str, domain=domain, amended=amended, excluded=excluded) -> DataFrame:
            out = A.domain_duplicates(_audited(spark, sf_dir), domain, ["selected_time", "event_id"], F.col(amended) if amended else None, F.col(excluded) if excluded else None)
            return out.select("event_id", "duplicate_key", "duplicate_count", "canonical_event_id", "duplicate_status", "duplicate_risk", "counts_once")

        build.__doc__ = f"AU-1 to AU-7: duplicates by the key of {domain} rows, with the canonical row."
        register(name, sql)(build)


_register_audits()

_ALERTS = "CASE gate " + " ".join(f"WHEN '{g}' THEN '{{{i}}}'" for i, (g, _, _) in enumerate(D.ALERTS)) + " END"


@register(
    "so6_alert_rows",
    "WITH " + _cte("", "true") + " SELECT slug, gate, CAST(list_position([" + ", ".join(f"'{g}'" for g in D.GATES) + "], gate) - 1 AS BIGINT) AS gate_rank, total, "
    + _ALERTS.format(*[_quoted(s)[1:-1] for _, s, _ in D.ALERTS]) + " AS severity, " + _ALERTS.format(*[_quoted(m)[1:-1] for _, _, m in D.ALERTS]) + f" AS message FROM g WHERE gate IN ({', '.join(_quoted(g) for g, _, _ in D.ALERTS)})",
)
def so6_alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-6: one row per alert, with severity and message."""
    return D.alert_rows(gated(spark, sf_dir, observations(spark, sf_dir))).withColumn("gate_rank", F.col("gate_rank").cast("long"))


@register(
    "rs4_explain",
    "WITH " + _cte("", "true") + ", x AS (SELECT slug, gate, total, " + ", ".join(f"s_{k} AS {k}" for k in D.SCORES) + f" FROM g), u AS (UNPIVOT x ON {', '.join(D.SCORES)} INTO NAME part VALUE score) SELECT slug, gate, total, part, score, "
    + f"CASE WHEN part IN ({', '.join(_quoted(m) for m in D.HARD_MINIMUMS)}) THEN {D.HARD_MINIMUM} END AS minimum, coalesce(part IN ({', '.join(_quoted(m) for m in D.HARD_MINIMUMS)}) AND score < {D.HARD_MINIMUM}, false) AS fails FROM u",
)
def rs4_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RS-4: what makes up a candidate's gate."""
    return D.explain(gated(spark, sf_dir, observations(spark, sf_dir)))


@register(
    "ml10_sector_targets",
    base.STUDY + """, s AS (SELECT event_id, raw_1 - bench_1 / 2 AS c FROM study)
    SELECT event_id, round(c, 6) AS car_sector_1, coalesce(c > 0, false) AS target_positive_sector_1, CASE WHEN c IS NULL THEN 'unknown' WHEN c > 0.002 THEN 'positive' WHEN c < -0.002 THEN 'negative' ELSE 'flat' END AS target_direction_sector_1 FROM s""",
)
def ml10_sector_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-10: targets less the sector's return (here half the benchmark's)."""
    s = study_frame(spark, sf_dir)
    out = A.sector_targets(s, s.select("event_id", (F.col("bench_1") / 2).alias("sector_1")), horizons=(1,))
    return out.select("event_id", F.round("car_sector_1", 6).alias("car_sector_1"), "target_positive_sector_1", "target_direction_sector_1")


@register(
    "pj23_features_to_events",
    "SELECT event_id, ticker, event_time, release_session, 'capital_raise' AS event_type, event_type AS event_subtype, CASE WHEN event_id % 2 = 0 THEN amount ELSE 5.0 END AS amount FROM evts WHERE event_id % 4 <> 1 AND event_id % 7 <> 0".join(["WITH " + base.EVENTS + " ", ""]),
)
def pj23_features_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-21, PJ-23: usable features of a domain as events."""
    e = base.events(spark, sf_dir).withColumns({"financing_event_type": F.col("event_type"), "gross_proceeds": F.when(F.col("event_id") % 2 == 0, F.col("amount")), "offering_amount": F.lit(5.0)})
    e = e.withColumns({"review_status": F.when(F.col("event_id") % 4 == 1, "rejected").otherwise("accepted"), "hard_negative_flag": F.col("event_id") % 7 == 0})
    return A.features_to_events(A.usable(e), "financing")


_STATED = "WITH p AS (SELECT p_partkey AS doc_id, ['Ownership went from 5.1% to 7.4% of the stock with personal funds.', 'It increased by 2.5 percentage points, bought with working capital.', 'Stake decreased by 1%; a margin loan was used.', 'The Phase III trial met its primary endpoint.', 'The phase 2 study did not meet the endpoint; a safety signal was seen.', 'The committee voted 9 to 4.', 'The PDUFA date is set for March 5, 2024.', 'Nothing.'][p_partkey % 8 + 1] AS text FROM part), l AS (SELECT doc_id, lower(text) AS low FROM p)"


@register(
    "tx8_document_fields",
    _STATED + r""" SELECT doc_id, round(CASE WHEN contains(low, 'from 5.1') THEN 7.4 - 5.1 WHEN contains(low, 'increased by') THEN CAST(regexp_extract(low, 'increased by ([0-9.]+)', 1) AS DOUBLE) WHEN contains(low, 'decreased by') THEN -CAST(regexp_extract(low, 'decreased by ([0-9.]+)', 1) AS DOUBLE) END, 6) AS ownership_change,
      CASE WHEN contains(low, 'working capital') THEN 'working_capital' WHEN contains(low, 'personal fund') THEN 'personal_funds' WHEN contains(low, 'loan') THEN 'financing_or_margin' END AS source_of_funds, CASE WHEN contains(low, 'phase iii') THEN '3' WHEN contains(low, 'phase 2') THEN '2' END AS trial_phase,
      CASE WHEN contains(low, 'did not meet') THEN false WHEN contains(low, 'met its primary') THEN true END AS endpoint_met, CAST(nullif(regexp_extract(low, 'voted [0-9]+ to ([0-9]+)', 1), '') AS DOUBLE) AS votes_against, CASE WHEN contains(low, 'pdufa') THEN '2024-03-05' END AS decision_date, contains(low, 'safety signal') AS safety_language FROM l""",
)
def tx8_document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-7, TX-8: values that ownership and trial texts state."""
    names = ("Ownership went from 5.1% to 7.4% of the stock with personal funds.", "It increased by 2.5 percentage points, bought with working capital.", "Stake decreased by 1%; a margin loan was used.", "The Phase III trial met its primary endpoint.", "The phase 2 study did not meet the endpoint; a safety signal was seen.", "The committee voted 9 to 4.", "The PDUFA date is set for March 5, 2024.", "Nothing.")
    d = base.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _pick(names, "p_partkey").alias("text"))
    out = PA.parse_documents(d, "trial").select("doc_id", *[c for c in PA.document_fields(F.lit("")) if c not in ("asset", "indication")])
    return out.withColumns({"ownership_change": F.round("ownership_change", 6), "decision_date": F.col("decision_date").cast("string")})


_FACT_TEXTS = ("Revenue was $1.5 billion", "We expect guidance for revenue of $2.1 million to $1.9 million", "Consensus EPS of $1.10", "EPS was $(0.25)", "Gross margin outlook of 41% to 43%", "Net income of $7 thousand", "Previously announced revenue of $5 million", "No metric of $5 million", "Revenue grew", "We expect net sales of $4.60 billion, plus or minus $200 million", "Revenue is expected to be in the range of $2.20 to $2.50 billion", "Revenues were $2.43 billion, above the midpoint of the guidance range of $2.20 to $2.50 billion", "A leader with revenue of more than $12 billion")
_FACTS_OF = (("revenue_actual", 1.5e9, 1.5e9, "usd", 0.7), ("revenue_guidance", 1.9e6, 2.1e6, "usd", 0.9), ("eps_consensus", 1.1, 1.1, "usd_per_share", 0.8), ("eps_actual", -0.25, -0.25, "usd_per_share", 0.7), ("gross_margin_guidance", 0.41, 0.43, "fraction", 0.9), ("net_income_actual", 7e3, 7e3, "usd", 0.7), None, None, None, ("revenue_guidance", 4.4e9, 4.8e9, "usd", 0.9), ("revenue_guidance", 2.2e9, 2.5e9, "usd", 0.9), ("revenue_actual", 2.43e9, 2.43e9, "usd", 0.7))


@register(
    "tx6_earnings_facts",
    "WITH f(k, fact_name, low, high, unit, confidence) AS (VALUES " + ", ".join(f"({i}, '{n}', {low}::DOUBLE, {high}::DOUBLE, '{u}', {c}::DOUBLE)" for i, (n, low, high, u, c) in ((i, f) for i, f in enumerate(_FACTS_OF) if f))
    + f") SELECT p_partkey, fact_name, round(low, 6) AS low, round(high, 6) AS high, round((low + high) / 2, 6) AS value, unit, confidence FROM part JOIN f ON p_partkey % {len(_FACT_TEXTS)} = k",
)
def tx6_earnings_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-6, TX-13: earnings facts by metric, role and range."""
    p = base.table(spark, sf_dir, "part").select("p_partkey", _pick(_FACT_TEXTS, "p_partkey").alias("segment"))
    return rounded(PA.earnings_facts(p).drop("segment"))


_DEALS, _DISTRESS, _ACCOUNTS = ("definitive_merger_agreement", "revised_terms", "deal_termination", "acquisition_completion", "other"), ("compliance_cure", "covenant_default", "unknown", "delisting_notice"), ("routine_auditor_change", "restatement_warning", "reportable_event", "other")
_OWNED = tuple(t for types in T.SURVIVABILITY.values() for t in types) + ("other",)
_SESSIONS = ("before_open", "intraday", "after_close", "unknown")
_CASES = f"k AS (SELECT o_orderkey, {_pick_sql(_SESSIONS, 'o_custkey')} AS session, {_pick_sql(_DEALS, 'o_orderkey')} AS deal, CASE WHEN o_custkey % 2 = 0 THEN 'target' ELSE 'acquirer' END AS side, {_pick_sql(_DISTRESS, '(o_orderkey // 2)')} AS distress, o_totalprice * 10 AS volume, {_pick_sql(_ACCOUNTS, '(o_orderkey // 3)')} AS account, {_pick_sql(_OWNED, 'o_orderkey')} AS owned FROM orders)"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "orders").select(
        "o_orderkey", _pick(_SESSIONS, "o_custkey").alias("session"), _pick(_DEALS, "o_orderkey").alias("deal"), F.when(F.col("o_custkey") % 2 == 0, "target").otherwise("acquirer").alias("side"), _pick(_DISTRESS, "o_orderkey div 2").alias("distress"),
        (F.col("o_totalprice") * 10).alias("volume"), _pick(_ACCOUNTS, "o_orderkey div 3").alias("account"), _pick(_OWNED, "o_orderkey").alias("owned"),
    )


@register(
    "pj16_survivability",
    f"""WITH {_CASES} SELECT o_orderkey, CASE WHEN deal = 'definitive_merger_agreement' AND side = 'target' THEN 'immediate-gap' WHEN deal = 'revised_terms' THEN 'delayed-digestion' WHEN deal = 'deal_termination' THEN 'slow-burn repricing' WHEN deal = 'acquisition_completion' THEN 'explanation-only' ELSE 'pre-event setup' END AS deal,
      CASE WHEN distress IN ('compliance_cure', 'unknown') OR volume < 1000000 THEN 'explanation-only' WHEN session = 'after_close' THEN 'immediate-gap' WHEN session IN ('before_open', 'intraday') THEN 'delayed-digestion' ELSE 'explanation-only' END AS distress,
      CASE WHEN account = 'routine_auditor_change' THEN 'explanation-only' WHEN session IN ('after_close', 'before_open') AND side = 'target' THEN 'immediate-gap' WHEN side = 'target' OR account = 'restatement_warning' THEN 'delayed-digestion' WHEN account = 'reportable_event' THEN 'slow-burn repricing' ELSE 'pre-event setup' END AS account FROM k""",
)
def pj16_survivability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ-16: how news of deals, distress and accounting is digested."""
    no = F.lit(False)
    return _cases(spark, sf_dir).select(
        "o_orderkey", T.deal_survivability(F.col("deal"), F.col("side")).alias("deal"), T.distress_survivability(F.col("distress"), F.col("session"), F.col("volume")).alias("distress"),
        T.accounting_survivability(F.col("account"), F.lit("low"), F.col("session"), F.col("side") == "target", no, no, no).alias("account"),
    )


@register(
    "ag26_survivability_summary",
    f"WITH {_CASES}, c AS (SELECT CASE " + " ".join(f"WHEN owned IN ({', '.join(_quoted(t) for t in types)}) THEN '{name}'" for name, types in T.SURVIVABILITY.items())
    + " ELSE 'pre-event setup' END AS execution_class, CASE session WHEN 'after_close' THEN 'next_open' WHEN 'before_open' THEN 'same_day_open_or_next_open' ELSE 'first_liquid_trade_after_acceptance' END AS first_entry FROM k) SELECT execution_class, first_entry, count(*) AS events, count(*) FILTER (WHERE execution_class = 'explanation-only') AS explanatory FROM c GROUP BY 1, 2",
)
def ag26_survivability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-26: events by class and first realistic entry."""
    x = _cases(spark, sf_dir).select(T.survivability(F.col("owned"), F.col("session")).alias("x")).select("x.*")
    return x.groupBy("execution_class", "first_entry").agg(F.count("*").alias("events"), F.count_if("explanatory_only").alias("explanatory"))
