"""Facts from order lines, claims from documents, and the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.operators import evidence as E
from afterbell.operators import facts as X
from afterbell.plans import base
from afterbell.plans.registry import register
from afterbell.plans.study import rounded

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
FACTS = """facts AS (
  SELECT l_orderkey AS event_id, n.fact_name, CASE n.fact_name WHEN 'l_quantity' THEN l_quantity WHEN 'l_extendedprice' THEN l_extendedprice WHEN 'l_discount' THEN l_discount ELSE l_tax END AS value,
    round(1 - l_tax * 5 + l_discount / 2, 4) AS confidence, CASE WHEN l_linenumber = 3 THEN '' ELSE l_returnflag || ' ' || l_linestatus || ' ' || l_linenumber::VARCHAR END AS evidence_text
  FROM lineitem, (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) n(fact_name))"""
BEST = """ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id, fact_name ORDER BY confidence DESC, length(evidence_text), value::VARCHAR DESC, evidence_text DESC) AS k,
  count(*) OVER (PARTITION BY event_id, fact_name) AS candidates FROM facts WHERE confidence >= {least})"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = base.table(spark, sf_dir, "lineitem")
    evidence = F.when(F.col("l_linenumber") == 3, "").otherwise(F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")))
    lines = lines.select(F.col("l_orderkey").alias("event_id"), F.round(1 - F.col("l_tax") * 5 + F.col("l_discount") / 2, 4).alias("confidence"), evidence.alias("evidence_text"), *MEASURES)
    long = lines.unpivot(["event_id", "confidence", "evidence_text"], list(MEASURES), "fact_name", "value")
    return long.withColumn("value", F.round("value", 4))


def _cents(c: str) -> F.Column:
    return F.round(F.col(c) * 100).cast("long")


FACTS = FACTS.replace("CASE n.fact_name", "CAST(round(100 * CASE n.fact_name").replace("ELSE l_tax END AS value", "ELSE l_tax END) AS BIGINT) AS value")


def cent_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in hundredths, as whole numbers, so that their texts are the same in every engine."""
    return facts(spark, sf_dir).withColumn("value", _cents("value"))


@register("ag20_best_facts", "WITH " + FACTS + ", " + BEST.format(least=0.7) + " SELECT event_id, fact_name, value, confidence, evidence_text, candidates FROM ranked WHERE k = 1")
def ag20_best_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-20: the best fact per event and name."""
    return X.best_facts(cent_facts(spark, sf_dir), least=0.7).select("event_id", "fact_name", "value", "confidence", "evidence_text", "candidates")


@register(
    "ag19_fact_pivot",
    "WITH " + FACTS + ", " + BEST.format(least=0.7) + """, u AS (SELECT event_id, count(*) AS usable_fact_count FROM facts WHERE confidence >= 0.7 GROUP BY 1)
    SELECT event_id, any_value(usable_fact_count) AS usable_fact_count, """
    + ", ".join(f"max(value) FILTER (WHERE fact_name = '{m}') AS {m}, max(confidence) FILTER (WHERE fact_name = '{m}') AS {m}_confidence, max(evidence_text) FILTER (WHERE fact_name = '{m}') AS {m}_evidence" for m in MEASURES)
    + " FROM ranked JOIN u USING (event_id) WHERE k = 1 GROUP BY 1",
)
def ag19_fact_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-19: facts to one row per event."""
    return X.pivot_facts(cent_facts(spark, sf_dir), MEASURES, 0.7)


@register(
    "ag18_fact_counts",
    "WITH " + FACTS + """ SELECT event_id, count(*) AS fact_count, count(CASE WHEN trim(evidence_text) <> '' THEN 1 END) AS evidence_count, round(avg(confidence), 6) AS mean_confidence,
    string_agg(DISTINCT fact_name, ',' ORDER BY fact_name) AS fact_names FROM facts GROUP BY 1""",
)
def ag18_fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.fact_counts(cent_facts(spark, sf_dir)))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.round(F.col("o_totalprice") * 25).cast("long").alias("expected"))
    rows = o.withColumn("fact_name", F.explode(F.array(F.lit("l_extendedprice"), F.lit("l_discount"))))
    return rows.select(
        "event_id", "fact_name",
        F.when(F.col("fact_name") == "l_discount", F.lit("5")).otherwise(F.col("expected").cast("string")).alias("expected_value"),
        F.when(F.col("fact_name") == "l_discount", "text").otherwise("usd").alias("unit"), F.lit(None).cast("double").alias("tolerance"), (F.col("event_id") % 5 != 0).alias("expected_present"),
    )


_GOLD = """, gold AS (SELECT o_orderkey AS event_id, f.fact_name, CASE WHEN f.fact_name = 'l_discount' THEN '5' ELSE CAST(CAST(round(o_totalprice * 25) AS BIGINT) AS VARCHAR) END AS expected_value,
    CASE WHEN f.fact_name = 'l_discount' THEN 'text' ELSE 'usd' END AS unit, o_orderkey % 5 <> 0 AS expected_present FROM orders, (VALUES ('l_extendedprice'), ('l_discount')) f(fact_name)),
evaluated AS (SELECT gold.*, CAST(r.value AS VARCHAR) AS found_value, CASE WHEN NOT expected_present THEN CASE WHEN r.value IS NULL THEN 'ok' ELSE 'false_positive' END WHEN r.value IS NULL THEN 'missed'
    WHEN CASE WHEN unit = 'usd' THEN abs(r.value - CAST(expected_value AS DOUBLE)) <= 1e6 ELSE CAST(r.value AS VARCHAR) = expected_value END THEN 'ok' ELSE 'wrong_value' END AS status
  FROM gold LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r USING (event_id, fact_name))
"""


@register("jn15_gold_evaluation", "WITH " + FACTS + ", " + BEST.format(least=0.0) + _GOLD + "SELECT event_id, fact_name, expected_value, found_value, status FROM evaluated")
def jn15_gold_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-15: facts against expected values, by unit."""
    return X.evaluate_against_gold(_gold(spark, sf_dir), cent_facts(spark, sf_dir)).select("event_id", "fact_name", "expected_value", "found_value", "status")


@register(
    "jn15_gold_summary",
    "WITH " + FACTS + ", " + BEST.format(least=0.0) + _GOLD
    + """, x AS (SELECT fact_name, expected_present, status FROM evaluated UNION ALL SELECT 'all', expected_present, status FROM evaluated)
    SELECT fact_name, count(*) AS n, round(avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0 END) FILTER (WHERE expected_present), 6) AS recall,
      count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'wrong_value') AS wrong_value, count(*) FILTER (WHERE status = 'missed') AS missed,
      count(*) FILTER (WHERE status = 'false_positive') AS false_positive FROM x GROUP BY 1""",
)
def jn15_gold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.gold_summary(X.evaluate_against_gold(_gold(spark, sf_dir), cent_facts(spark, sf_dir))))


#: A rule pack over the documents' prose: patterns without look-around, the same in both engines.
RULES = (
    E.Rule("credential_leak", r"(token|secret|password) = ", confidence=0.9),
    E.Rule("table_layout", r" \| ", confidence=0.6),
    E.Rule("shouting", r"[A-Z]{4,}!!", confidence=0.7),
    E.Rule("network_address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", confidence=0.75),
    E.Rule("insult", r"(idiot|moron|worthless|loser|scum)", confidence=0.85, reject=r"not "),
    E.Rule("licence", r"(?i)licen[cs]e", confidence=0.8),
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.match_rules(documents(spark, sf_dir), RULES)


def _rule_sql(r: E.Rule) -> str:
    p = r.pattern.replace("'", "''")
    return f"""SELECT doc_id, text, '{r.field}' AS field_name, '{r.value}' AS value, {r.confidence}::DOUBLE AS confidence, '{r.reject or ''}' AS reject,
      length(string_split_regex(text, '{p}')[1]) AS ms, length(regexp_extract(text, '{p}')) AS ml FROM documents WHERE regexp_matches(text, '{p}')"""


MATCHES = (
    "h AS (" + " UNION ALL ".join(map(_rule_sql, RULES)) + """),
s AS (SELECT *, substr(text, 1, ms) AS before, substr(text, ms + ml + 1) AS after FROM h),
b AS (SELECT *, ms - length(string_split_regex(before, '[.!?\\n]')[-1]) AS f, ms + ml + length(string_split_regex(after, '[.!?\\n]')[1]) + CASE WHEN regexp_matches(after, '[.!?\\n]') THEN 1 ELSE 0 END AS l FROM s),
r AS (SELECT *, substr(text, f + 1, l - f) AS raw FROM b),
t AS (SELECT *, regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', '') AS trimmed, f + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS start_char FROM r),
matches AS (SELECT doc_id, field_name, value, confidence, ms AS match_start, start_char, start_char + length(trimmed) AS end_char, trim(regexp_replace(trimmed, '\\s+', ' ', 'g')) AS evidence_text, reject FROM t),
kept AS (SELECT * EXCLUDE (reject) FROM matches WHERE reject = '' OR NOT regexp_matches(evidence_text, reject))"""
)


@register("tx3_rule_claims", "WITH " + MATCHES + " SELECT * FROM kept")
def tx3_rule_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-2, TX-3, TX-4: rules over documents, each hit with its sentence as evidence."""
    return matches(spark, sf_dir)


def _beside(c: str) -> str:
    """Marks beside digits as control characters, which end nothing."""
    for i, mark in enumerate(".;!?", 1):
        c = f"regexp_replace(regexp_replace({c}, '([0-9])[{mark}]', '\\1' || chr({i}), 'g'), '[{mark}]([0-9])', chr({i}) || '\\1', 'g')"
    return c


@register(
    "tx1_segments",
    "WITH m AS (SELECT doc_id, regexp_replace(" + _beside("coalesce(text, '')") + r""", '([.;!?])', '\1' || chr(5), 'g') AS t FROM documents),
    u AS (SELECT doc_id, unnest(string_split_regex(t, '[\x05\n]')) AS piece, unnest(list_concat([''], regexp_extract_all(t, '[\x05\n]'))) AS mark, generate_subscripts(string_split_regex(t, '[\x05\n]'), 1) AS k FROM m),
    s AS (SELECT doc_id, translate(piece, chr(1) || chr(2) || chr(3) || chr(4), '.;!?') AS piece, sum(length(piece) + CASE WHEN mark = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS start FROM u),
    t AS (SELECT doc_id, start + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS start_char, regexp_replace(regexp_replace(piece, '^\s+', ''), '\s+$', '') AS segment FROM s)
    SELECT doc_id, CAST(start_char AS BIGINT) AS start_char, CAST(start_char + length(segment) AS BIGINT) AS end_char, segment FROM t WHERE length(segment) >= 6""",
)
def tx1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-1: sentences and lines with offsets."""
    return E.segments(documents(spark, sf_dir)).withColumn("start_char", F.col("start_char").cast("long")).withColumn("end_char", F.col("end_char").cast("long"))


@register(
    "sk6_evidence_highlight",
    "WITH " + MATCHES + """, d AS (SELECT k.doc_id, k.field_name, greatest(start_char - 180, 0) AS f, start_char AS a, end_char AS b, text FROM kept k JOIN documents USING (doc_id))
    SELECT doc_id, field_name, """ + " || ".join(
        x if x.startswith("'") else f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
        for x in ("substr(text, f + 1, a - f)", "'<mark>'", "substr(text, a + 1, b - a)", "'</mark>'", "substr(text, b + 1, 180)")
    ) + " AS html FROM d",
)
def sk6_evidence_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK-6: escaped text around each evidence span."""
    joined = matches(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return joined.select("doc_id", "field_name", E.highlight(F.col("text"), F.col("start_char"), F.col("end_char")).alias("html"))


@register(
    "sc9_ingest_manifest",
    r"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, length(t) AS n_chars, CASE WHEN length(t) < 200 THEN 'too_short' ELSE '' END AS skip_reason, sha256(t) AS content_hash, count(*) OVER (PARTITION BY sha256(t)) AS copies FROM n""",
)
def sc9_ingest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-9: normalised text, content hash, skip reason and number of copies."""
    from afterbell.sources.documents import ingest

    return ingest(documents(spark, sf_dir), least=200).select("doc_id", "n_chars", "skip_reason", "content_hash", "copies")


@register(
    "sc10_visible_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?(</script\s*>|\z)|<style\b.*?(</style\s*>|\z)|<noscript\b.*?(</noscript\s*>|\z)|<svg\b.*?(</svg\s*>|\z)|<head\b.*?(</head\s*>|\z)|<!--.*?(-->|\z)', ' ', 'g') AS c FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(c, '(?i)</?(p|div|li|ul|ol|br|tr|table|h[1-6]|section|article|header|footer|nav|body)\b[^>]*(>|\z)', chr(10), 'g'), '</?[a-zA-Z!?][^>]*(>|\z)', '', 'g') AS c FROM a),
    e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(c, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS c FROM b)
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(c, '[ \t\r\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n+', chr(10), 'g'), ' ' || chr(10)) AS text FROM e""",
)
def sc10_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-10: visible text of pages by replacement."""
    return base.table(spark, sf_dir, "pages").select("page_id", E.visible_text(F.col("html")).alias("text"))


@register(
    "tx5_amounts",
    r"""WITH t AS (SELECT o_orderkey AS id, 'revenue of $' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) || CASE o_orderkey % 3 WHEN 0 THEN ' million' WHEN 1 THEN 'K' ELSE '' END || ' to $' || CAST(o_custkey AS VARCHAR) || ' billion' AS text FROM orders),
    m AS (SELECT id, regexp_extract_all(text, '\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?(million|billion|thousand|[MBK]\b)?', 1) AS n, regexp_extract_all(text, '\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?(million|billion|thousand|[MBK]\b)?', 2) AS u FROM t),
    v AS (SELECT id, list_transform(range(1, len(n) + 1), lambda i: CAST(replace(n[i], ',', '') AS DOUBLE) * CASE WHEN lower(u[i]) IN ('million', 'm') THEN 1e6 WHEN lower(u[i]) IN ('billion', 'b') THEN 1e9 WHEN lower(u[i]) IN ('thousand', 'k') THEN 1e3 WHEN i = 1 THEN 1e9 ELSE 1 END) AS v FROM m)
    SELECT id, len(v) AS n, list_min(v) AS low, list_max(v) AS high, (list_min(v) + list_max(v)) / 2 AS mid FROM v""",
)
def tx5_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-5: money amounts with units, and their range."""
    o = base.table(spark, sf_dir, "orders")
    unit = F.expr("element_at(array(' million', 'K', ''), cast(o_orderkey % 3 as int) + 1)")
    text = F.concat(F.lit("revenue of $"), F.bround("o_totalprice").cast("long").cast("string"), unit, F.lit(" to $"), F.col("o_custkey").cast("string"), F.lit(" billion"))
    rows = o.select(F.col("o_orderkey").alias("id"), E.amounts(text).alias("v"))
    return rows.select("id", F.size("v").alias("n"), E.range_or_mid(F.col("v")).alias("r")).select("id", "n", "r.*")
