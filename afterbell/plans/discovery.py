"""Discovery and similarity queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.operators import discovery as D
from afterbell.operators import similarity as S
from afterbell.plans import base
from afterbell.plans.registry import register
from afterbell.plans.study import rounded

_OBS = """obs AS (SELECT source AS slug, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'title ' || doc_id::VARCHAR END AS title, lang || '_wire' AS source_name, CASE WHEN lang = 'en' THEN 'federal register' ELSE 'news' END AS source_kind, lang = 'en' AS official_source,
    ['clear', 'public_but_session_ambiguous', 'record_only', 'fuzzy', 'clear'][doc_id % 5 + 1] AS timestamp_quality, 'reason' || (doc_id % (2 + length(source) % 2 * 3))::VARCHAR AS reason, 'negative' || (doc_id % 7)::VARCHAR AS negative,
    'field' || (doc_id % 3)::VARCHAR AS field, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS evidence, ['clean map', 'manual alias', '', 'unmapped'][length(source) - 3] AS mapping_notes,
    CASE WHEN doc_id % 3 = 0 THEN 'mixed' ELSE 'filtered' END AS liquidity_notes, CAST(least(n_chars // 40, 500) AS INTEGER) AS hint, doc_id AS observed_at FROM documents WHERE {where})"""
_SCORED = """c{i} AS (SELECT slug, arg_min(title, observed_at) FILTER (WHERE trim(title) <> '') AS title, count(*) AS n, count(*) FILTER (WHERE official_source) AS official, bool_or(source_kind = 'federal register') AS prim, count(DISTINCT source_name) AS sources,
    count(*) FILTER (WHERE timestamp_quality = 'clear') AS cl, count(*) FILTER (WHERE timestamp_quality = 'public_but_session_ambiguous') AS am, count(*) FILTER (WHERE timestamp_quality = 'record_only') AS ro,
    count(DISTINCT reason) AS r, count(DISTINCT negative) AS neg, count(DISTINCT field) AS f, sum(evidence) AS ev, max(hint) AS hint, string_agg(DISTINCT mapping_notes, ' ') AS m, string_agg(DISTINCT liquidity_notes, ' ') AS q FROM obs{i} GROUP BY 1),
s{i} AS (SELECT *, CASE WHEN official = n THEN 3 WHEN official > 0 THEN 2 WHEN prim THEN 1 ELSE 0 END AS s_official, CASE WHEN cl > 0 AND cl >= am + ro THEN 3 WHEN cl > 0 OR am > 0 THEN 2 WHEN ro > 0 THEN 1 ELSE 0 END AS s_timestamp,
    CASE WHEN r >= 4 THEN 3 WHEN r >= 2 THEN 2 WHEN r >= 1 THEN 1 ELSE 0 END AS s_delayed_digest_reasons, CASE WHEN neg >= 6 THEN 3 WHEN neg >= 3 THEN 2 WHEN neg >= 1 THEN 1 ELSE 0 END AS s_hard_negatives,
    CASE WHEN f >= 4 THEN 3 WHEN f >= 2 THEN 2 WHEN f >= 1 THEN 1 ELSE 0 END AS s_materiality_fields, CASE WHEN hint >= 200 THEN 3 WHEN hint >= 80 THEN 2 WHEN hint >= 30 THEN 1 ELSE 0 END AS s_sample,
    CASE WHEN trim(m) = '' THEN 1 WHEN contains(m, 'unmapped') THEN 0 WHEN contains(m, 'clean') THEN 3 WHEN contains(m, 'manual') THEN 2 ELSE 1 END AS s_mapping, CASE WHEN contains(q, 'mixed') OR contains(q, 'filter') THEN 2 ELSE 1 END AS s_liquidity,
    CASE WHEN neg >= 5 AND ev >= 3 THEN 3 WHEN neg >= 3 THEN 2 WHEN neg >= 1 THEN 1 ELSE 0 END AS s_parser, CASE WHEN sources >= 2 AND hint >= 200 THEN 3 WHEN hint >= 80 OR n >= 3 THEN 2 WHEN hint >= 30 OR n >= 2 THEN 1 ELSE 0 END AS s_fresh FROM c{i}),
fb{i} AS (SELECT *, slug IN ('src3', 'src4') AS penalised FROM s{i}),
p{i} AS (SELECT * EXCLUDE (s_sample, s_fresh), CASE WHEN penalised THEN 0 ELSE s_sample END AS s_sample, CASE WHEN penalised THEN 0 ELSE s_fresh END AS s_fresh FROM fb{i}),
t{i} AS (SELECT *, s_official + s_timestamp + s_delayed_digest_reasons + s_hard_negatives + s_materiality_fields + s_sample + s_mapping + s_liquidity + s_parser + s_fresh AS total FROM p{i}),
g{i} AS (SELECT *, CASE WHEN slug = 'src5' THEN 'monitor_only' WHEN slug = 'src6' THEN 'blocked_by_registry' WHEN s_timestamp < 2 OR s_delayed_digest_reasons < 2 OR s_materiality_fields < 2 OR s_sample < 2 OR total < 24
    THEN CASE WHEN total >= 18 THEN 'feasibility_only' WHEN total >= 12 THEN 'backlog' ELSE 'skip' END ELSE 'full_lifecycle' END AS gate FROM t{i})"""


def _cte(i: str, where: str) -> str:
    return _OBS.replace("obs AS", f"obs{i} AS").replace("{where}", where) + ", " + _SCORED.replace("{i}", i)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base.table(spark, sf_dir, "documents")
    s = lambda e: F.expr(e)
    return d.select(
        "doc_id", F.col("source").alias("slug"), F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.concat(F.lit("title "), F.col("doc_id").cast("string"))).alias("title"), F.concat("lang", F.lit("_wire")).alias("source_name"),
        F.when(F.col("lang") == "en", "federal register").otherwise("news").alias("source_kind"), (F.col("lang") == "en").alias("official_source"),
        s("element_at(array('clear', 'public_but_session_ambiguous', 'record_only', 'fuzzy', 'clear'), cast(doc_id % 5 as int) + 1)").alias("timestamp_quality"),
        s("array(concat('reason', cast(doc_id % (2 + length(source) % 2 * 3) as string)))").alias("delayed_digest_reasons"), s("array(concat('negative', cast(doc_id % 7 as string)))").alias("hard_negatives"),
        s("array(concat('field', cast(doc_id % 3 as string)))").alias("materiality_fields"), s("case when doc_id % 2 = 0 then array('e') else array() end").cast("array<string>").alias("evidence"),
        s("element_at(array('clean map', 'manual alias', '', 'unmapped'), length(source) - 3)").alias("mapping_notes"), F.when(F.col("doc_id") % 3 == 0, "mixed").otherwise("filtered").alias("liquidity_notes"),
        F.least((F.col("n_chars") / 40).cast("int"), F.lit(500)).alias("sample_size_hint"), F.col("doc_id").alias("observed_at"),
    )


def gated(spark: SparkSession, sf_dir: str, obs: DataFrame) -> DataFrame:
    feedback = spark.createDataFrame([("src3", 40, 0), ("src3", 20, 0), ("src4", 900, 9), ("src7", 100, 50), ("src8", 10, 0)], "slug string, source_rows long, positive_rows long")
    registry = spark.createDataFrame([("src5", "Monitor only"), ("src6", "FROZEN since May"), ("src7", "active")], "slug string, status string")
    return D.gate(D.penalise(D.score(D.candidates(obs)), feedback), registry)


_COLUMNS = "slug, title, n AS observations, " + ", ".join(f"s_{k}" for k in D.SCORES) + ", penalised, total, gate"


@register("rs1_candidate_scores", "WITH " + _cte("", "true") + f" SELECT {_COLUMNS} FROM g")
def rs1_candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RS-1, RS-2, RS-3, AG-27, JN-20: observations to scored and gated candidates."""
    return gated(spark, sf_dir, observations(spark, sf_dir)).select("slug", "title", "observations", *[f"s_{k}" for k in D.SCORES], "penalised", "total", "gate")


_RANK = "CASE gate WHEN 'full_lifecycle' THEN 0 WHEN 'feasibility_only' THEN 1 WHEN 'monitor_only' THEN 2 WHEN 'backlog' THEN 3 WHEN 'skip' THEN 4 ELSE 5 END"


@register("so5_top_candidates", "WITH " + _cte("", "true") + f", r AS (SELECT slug, total, gate, CAST(row_number() OVER (ORDER BY {_RANK}, total DESC, slug) AS INTEGER) AS rank FROM g) SELECT * FROM r WHERE rank <= 10")
def so5_top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-4, SO-5: a top ten."""
    return D.top_candidates(gated(spark, sf_dir, observations(spark, sf_dir)), 10).select("slug", "total", "gate", "rank")


@register(
    "so6_alerts",
    "WITH " + _cte("", "true") + """, v AS (SELECT *, CASE gate WHEN 'full_lifecycle' THEN 'high' WHEN 'feasibility_only' THEN 'medium' WHEN 'monitor_only' THEN 'low' WHEN 'backlog' THEN 'low' ELSE 'suppressed' END AS severity FROM g)
    SELECT severity, count(*) AS n, max(total) AS best_total, CASE WHEN severity = 'suppressed' THEN '' ELSE string_agg(slug, ',' ORDER BY slug) END AS slugs FROM v GROUP BY 1""",
)
def so6_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.alerts(gated(spark, sf_dir, observations(spark, sf_dir)))


@register(
    "jn21_snapshot_diff",
    "WITH " + _cte("1", "doc_id % 3 = 0 AND source <> 'src2'") + ", " + _cte("2", "source <> 'src9'") + """, j AS (SELECT coalesce(a.slug, b.slug) AS slug, a.slug AS o, b.slug AS n, a.total::VARCHAR AS ot, b.total::VARCHAR AS nt, a.gate AS og, b.gate AS ng FROM g1 a FULL JOIN g2 b ON a.slug = b.slug)
    SELECT slug, 'added' AS change, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value FROM j WHERE o IS NULL UNION ALL SELECT slug, 'removed', NULL, NULL FROM j WHERE n IS NULL
    UNION ALL SELECT slug, 'total', ot, nt FROM j WHERE o IS NOT NULL AND n IS NOT NULL AND ot IS DISTINCT FROM nt UNION ALL SELECT slug, 'gate', og, ng FROM j WHERE o IS NOT NULL AND n IS NOT NULL AND og IS DISTINCT FROM ng""",
)
def jn21_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-21, SE-4, RS-4: what changed between two snapshots."""
    o = observations(spark, sf_dir)
    return D.snapshot_diff(gated(spark, sf_dir, o.where("doc_id % 3 = 0 and slug <> 'src2'")), gated(spark, sf_dir, o.where("slug <> 'src9'")), ["total", "gate"])


@register(
    "ag28_entity_resolution",
    """WITH h AS (SELECT conv_id, role || '_' || (turn % 3)::VARCHAR AS entity, round(0.4 + (length(text) % 40) / 100, 4) AS confidence, turn % 2 = 0 AS e FROM conversations),
    c AS (SELECT conv_id, entity, count(*) AS hints, round(least(1.0, avg(confidence) + least(count(*) * 0.08, 0.24) + CASE WHEN bool_or(e) THEN 0.08 ELSE 0 END)::DOUBLE, 9) AS confidence FROM h GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER w AS rank, lead(confidence) OVER w AS nx FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY confidence DESC, entity))
    SELECT conv_id, entity, hints, round(confidence, 6) AS confidence, CAST(rank AS INTEGER) AS rank, CASE WHEN rank > 1 THEN 'candidate' WHEN coalesce(confidence - nx <= 0.05 + 1e-12, false) THEN 'ambiguous' ELSE 'resolved' END AS status FROM r""",
)
def ag28_entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-28, AG-29: hints to candidates with a status."""
    h = base.table(spark, sf_dir, "conversations").select(
        "conv_id", F.concat("role", F.lit("_"), (F.col("turn") % 3).cast("string")).alias("entity"), F.round(0.4 + (F.length("text") % 40) / 100, 4).alias("confidence"), (F.col("turn") % 2 == 0).alias("has_evidence")
    )
    return rounded(D.resolve_entities(h, ["conv_id"]))


@register(
    "ag17_readiness",
    """WITH d AS (SELECT s_suppkey AS plugin, n.name, CASE n.name WHEN 'source' THEN abs(s_acctbal) / 10000 WHEN 'time' THEN (s_suppkey % 10) / 10 ELSE (s_nationkey % 5) / 5 END AS score FROM supplier, (VALUES ('source'), ('time'), ('entity')) n(name) WHERE NOT (n.name = 'time' AND s_suppkey % 4 = 0)),
    w AS (SELECT * FROM (VALUES ('discover', 'source', 2.0), ('discover', 'time', 1.0), ('model', 'time', 2.0), ('model', 'entity', 1.0), ('model', 'price', 1.0), ('trade', 'price', 1.0)) w(level, name, weight)),
    k AS (SELECT DISTINCT plugin FROM d), j AS (SELECT k.plugin, level, sum(coalesce(score, 0) * weight) / sum(weight) AS v, count(score) AS c FROM k CROSS JOIN w LEFT JOIN d ON d.plugin = k.plugin AND d.name = w.name GROUP BY 1, 2),
    s AS (SELECT plugin, level, CASE WHEN c > 0 THEN v ELSE 0 END::DOUBLE AS score FROM j)
    SELECT plugin, level, round(score, 6) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' WHEN score >= 0.35 THEN 'low' ELSE 'very_low' END AS band FROM s""",
)
def ag17_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-17: weighted compatibility per readiness level."""
    s = base.table(spark, sf_dir, "supplier")
    value = F.when(F.col("name") == "source", F.abs("s_acctbal") / 10000).when(F.col("name") == "time", (F.col("s_suppkey") % 10) / 10).otherwise((F.col("s_nationkey") % 5) / 5)
    d = s.withColumn("name", F.explode(F.array(F.lit("source"), F.lit("time"), F.lit("entity")))).where("not (name = 'time' and s_suppkey % 4 = 0)").select(F.col("s_suppkey").alias("plugin"), "name", value.alias("score"))
    weights = spark.createDataFrame([("discover", "source", 2.0), ("discover", "time", 1.0), ("model", "time", 2.0), ("model", "entity", 1.0), ("model", "price", 1.0), ("trade", "price", 1.0)], "level string, name string, weight double")
    return rounded(D.readiness(d, weights))


_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


@register(
    "tx11_tfidf_neighbours",
    f"""WITH t AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[\\w\\p{{L}}]{{2,}}')) AS term FROM benchmark),
    f AS (SELECT id, term, count(*) AS tf FROM t WHERE term NOT IN ({_STOP}) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
    w AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM f JOIN df USING (term)), n AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1), u AS (SELECT w.id, term, w / n AS w FROM w JOIN n ON w.id = n.id),
    d AS (SELECT p.id AS probe, o.id, sum(p.w * o.w) AS similarity FROM u p JOIN u o ON p.term = o.term AND p.id <> o.id GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY round(similarity, 9) DESC, id) AS rank FROM d)
    SELECT probe, id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def tx11_tfidf_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-11: most similar texts by TF-IDF cosine."""
    b = base.table(spark, sf_dir, "benchmark")
    return rounded(S.similar(b, "item_id", "text", b, 5))


@register(
    "tx12_analogs",
    """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b, length(p_name)::DOUBLE AS c FROM part), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc FROM p),
    z AS (SELECT p_partkey, (a - ma) / sa AS x, (b - mb) / sb AS y, CASE WHEN sc = 0 THEN c - mc ELSE (c - mc) / sc END AS w FROM p, m), q AS (SELECT * FROM z WHERE p_partkey % 100 = 0),
    d AS (SELECT q.p_partkey AS probe, z.p_partkey, (q.x * z.x + q.y * z.y + q.w * z.w) / nullif(sqrt((q.x * q.x + q.y * q.y + q.w * q.w) * (z.x * z.x + z.y * z.y + z.w * z.w)), 0) AS s FROM q JOIN z ON q.p_partkey <> z.p_partkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY round(s, 9) DESC NULLS LAST, p_partkey) AS rank FROM d)
    SELECT probe, p_partkey, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""",
)
def tx12_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-12: nearest rows of every hundredth part by standardised features."""
    p = base.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), F.length("p_name").cast("double").alias("c"))
    return rounded(S.analogs(p, "p_partkey", ["a", "b", "c"], p.where("p_partkey % 100 = 0"), 8))


@register(
    "jn14_substring_match",
    """WITH pat AS (SELECT DISTINCT p_brand AS pattern, p_brand || ' Inc' AS ticker, 0.7::DOUBLE AS confidence, 1 AS place FROM part UNION ALL SELECT 'ste', 'STEEL', 0.9, 2 UNION ALL SELECT 'e', 'ANY', 0.9, 3),
    n AS (SELECT p_partkey, p_type || ' ' || p_brand AS name FROM part),
    j AS (SELECT p_partkey, ticker, pattern, confidence, row_number() OVER (PARTITION BY p_partkey ORDER BY confidence DESC, length(pattern) DESC, place) AS k, count(*) OVER (PARTITION BY p_partkey) AS hits FROM n JOIN pat ON contains(lower(name), lower(pattern)))
    SELECT n.p_partkey, n.name, ticker, pattern, confidence, coalesce(hits, 0) AS hits FROM n LEFT JOIN (SELECT * FROM j WHERE k = 1) j ON n.p_partkey = j.p_partkey""",
)
def jn14_substring_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-14: best contained pattern of each name."""
    p = base.table(spark, sf_dir, "part")
    brands = p.select(F.col("p_brand").alias("pattern"), F.concat("p_brand", F.lit(" Inc")).alias("ticker"), F.lit(0.7).alias("confidence"), F.lit(1).alias("place")).distinct()
    patterns = brands.unionAll(spark.createDataFrame([("ste", "STEEL", 0.9, 2), ("e", "ANY", 0.9, 3)], "pattern string, ticker string, confidence double, place int"))
    return S.best_substring(p.select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("name")), patterns).select("p_partkey", "name", "ticker", "pattern", "confidence", "hits")


@register(
    "jn16_matched_peers",
    "WITH " + base.BARS + """, e AS (SELECT ticker, d, ticker * 100000 + date_diff('day', DATE '1995-01-01', d) AS event_id FROM bars WHERE date_diff('day', DATE '1995-01-01', d) % 9 = ticker % 9),
    p AS (SELECT b.ticker, d, s_nationkey AS stratum, CASE WHEN volume > 30 THEN NULL ELSE round(price / 1000 + 1e-10, 6) END AS beta, s_suppkey % 3 AS bucket, s_suppkey % 2 AS phase, [n_name, r_name] AS tokens FROM bars b JOIN supplier ON s_suppkey = b.ticker JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    f AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.ticker = p.ticker AND e.d = p.d)),
    j AS (SELECT e.event_id, f.ticker AS peer, round(coalesce(abs(f.beta - p.beta), 1.0) + CASE WHEN f.bucket <> p.bucket THEN 0.5 ELSE 0 END + CASE WHEN f.phase <> p.phase THEN 0.25 ELSE 0 END
      + 0.25 * (1 - len(list_intersect(f.tokens, p.tokens)) / len(list_distinct(list_concat(f.tokens, p.tokens)))), 9) AS s FROM e JOIN p ON e.ticker = p.ticker AND e.d = p.d JOIN f ON f.d = p.d AND f.stratum = p.stratum AND f.ticker <> p.ticker),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s, peer) AS k, count(*) OVER (PARTITION BY event_id) AS candidates FROM j)
    SELECT event_id, peer, round(s + 1e-9, 6) AS score, candidates FROM r WHERE k = 1""",
)
def jn16_matched_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-16: nearest peer of the day and nation without an event."""
    b = base.bars(spark, sf_dir)
    day = F.date_diff("d", F.lit("1995-01-01").cast("date"))
    e = b.where(day % 9 == F.col("ticker") % 9).select("ticker", "d", (F.col("ticker") * 100000 + day).alias("event_id"))
    s, n, r = (base.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    sup = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    p = b.join(sup, b.ticker == sup.s_suppkey).select(
        "ticker", "d", F.col("s_nationkey").alias("stratum"), F.when(F.col("volume") <= 30, F.round(F.col("price") / 1000 + 1e-10, 6)).alias("beta"), (F.col("s_suppkey") % 3).alias("bucket"), (F.col("s_suppkey") % 2).alias("phase"), F.array("n_name", "r_name").alias("tokens")
    )
    return S.matched_peers(e, p).withColumn("score", F.round(F.col("score") + 1e-9, 6))


@register(
    "so7_stratified_sample",
    """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k, o_totalprice FROM orders), f AS (SELECT * FROM r WHERE k <= 20),
    g AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS j FROM r WHERE k > 20)
    SELECT o_orderkey, o_orderpriority, 'bucket' AS picked_by FROM f UNION ALL SELECT o_orderkey, o_orderpriority, 'fill' FROM g WHERE j <= greatest(0, 150 - (SELECT count(*) FROM f))""",
)
def so7_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-7: an audit sample by stratum (a sampling operator)."""
    o = base.table(spark, sf_dir, "orders").withColumn("_neg", -F.col("o_totalprice"))
    return S.stratified_sample(o, "o_orderpriority", ["_neg", "o_orderkey"], 20, 150).select("o_orderkey", "o_orderpriority", "picked_by")


@register(
    "ag21_peer_field_benchmark",
    "WITH c AS (SELECT event_id, user_id % 7 AS g, CASE WHEN contains(props, '6') THEN event_type END AS field_name FROM events), n AS (SELECT g, count(DISTINCT event_id) AS events FROM c GROUP BY 1) "
    "SELECT g, field_name, count(DISTINCT event_id) AS with_field, any_value(events) AS events, round(count(DISTINCT event_id) / any_value(events), 6) AS share FROM c JOIN n USING (g) WHERE field_name IS NOT NULL GROUP BY 1, 2",
)
def ag21_peer_field_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("g"), "props", "event_type")
    claims = e.where(F.col("props").contains("6")).select("event_id", F.col("event_type").alias("field_name"))
    return rounded(S.peer_field_benchmark(e.select("event_id", "g"), claims, "g").select("g", "field_name", "with_field", "events", "share"))
