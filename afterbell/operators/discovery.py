"""From observations to scored, gated and compared candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from afterbell.functions.exprs import blank_to_null

# Fixed values of the scores: cut points (1, 2, 3), words with their score, gates in rank order.
COUNT_CUTS = {"delayed_digest_reasons": (1, 2, 4), "hard_negatives": (1, 3, 6), "materiality_fields": (1, 2, 4)}
SAMPLE_CUTS = (30, 80, 200)
PRIMARY_WORDS = ("sec", "fda", "nhtsa", "occ", "fdic", "federal", "court", "agency", "official")
MAPPING_WORDS = ((0, ("insufficient", "ambiguous", "unmapped", "mapping-risk", "mapping risk")), (3, ("clean", "exact", "high confidence", "cik", "issuer")), (2, ("manual", "alias", "subsidiary", "feasible")))
#: "liquid" also stands in "illiquid", which so scores 3: the order of the rules is kept.
LIQUIDITY_WORDS = ((3, ("liquid", "large cap", "adv")), (2, ("mixed", "filter")), (0, ("illiquid", "halt", "penny")))
GATES = ("full_lifecycle", "feasibility_only", "monitor_only", "backlog", "skip", "blocked_by_registry")
FULL, FEASIBLE, BACKLOG = 24, 18, 12
ALERTS = (
    ("full_lifecycle", "review", "clears the score for the full lifecycle"),
    ("feasibility_only", "feasibility", "should be reviewed for feasibility only"),
    ("monitor_only", "monitor", "stays under watch until its registry says to come back"),
)
HARD_MINIMUMS = ("timestamp", "delayed_digest_reasons", "materiality_fields", "sample")
HARD_MINIMUM = 2
MONITOR, FROZEN = ("monitor",), ("frozen", "closed")
PENALTY_ROWS, PENALTY_YIELD = 50, 0.01

SCORES = ("official", "timestamp", "delayed_digest_reasons", "hard_negatives", "materiality_fields", "sample", "mapping", "liquidity", "parser", "fresh")


def candidates(observations: DataFrame) -> DataFrame:
    """One row per slug: first title, united lists, counts, largest sample hint, joined notes.

    observations: slug, title, source_name, source_kind, official_source, timestamp_quality,
    delayed_digest_reasons, hard_negatives, materiality_fields, evidence (arrays), mapping_notes,
    liquidity_notes, sample_size_hint, observed_at. Sets are united by aggregation, so a slug with
    very many observations costs its distinct values.
    """
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(c), F.array().cast("array<string>"))))))
    quality = lambda *names: F.sum(F.col("timestamp_quality").isin(*names).cast("long"))
    notes = lambda c: F.array_join(F.array_sort(F.collect_set(F.lower(F.col(c)))), " ")
    return observations.groupBy("slug").agg(
        F.min_by("title", F.when(blank_to_null(F.col("title")).isNotNull(), F.struct("observed_at", "title"))).alias("title"),
        F.count("*").alias("observations"),
        F.sum(F.col("official_source").cast("long")).alias("official_count"),
        F.array_sort(F.collect_set("source_kind")).alias("source_kinds"),
        F.count_distinct("source_name").alias("source_count"),
        quality("clear").alias("clear"), quality("public_but_session_ambiguous").alias("ambiguous"), quality("record_only").alias("record_only"),
        *[union(c).alias(c) for c in COUNT_CUTS],
        F.sum(F.size(F.coalesce("evidence", F.array().cast("array<string>")))).alias("evidence_count"),
        F.max("sample_size_hint").alias("sample_hint"), notes("mapping_notes").alias("mapping_notes"), notes("liquidity_notes").alias("liquidity_notes"),
    )


def _cut(n: Column, cuts: Sequence[int]) -> Column:
    low, middle, high = cuts
    return F.when(n >= high, 3).when(n >= middle, 2).when(n >= low, 1).otherwise(0)


def _words(text: Column, table: Sequence[tuple[int, Sequence[str]]], otherwise: int) -> Column:
    out = F.when(F.lit(False), 0)
    for score, words in table:
        out = out.when(F.array_contains(F.array(*[text.contains(w) for w in words]), True), score)
    return out.otherwise(otherwise)


def score(cands: DataFrame) -> DataFrame:
    """The ten sub-scores from 0 to 3 and their total."""
    primary = F.exists("source_kinds", lambda k: F.array_contains(F.array(*[F.lower(k).contains(w) for w in PRIMARY_WORDS]), True))
    n, hint, hard = F.col("observations"), F.coalesce("sample_hint", F.lit(0)), F.size("hard_negatives")
    parts = {
        "official": F.when(F.col("official_count") == n, 3).when(F.col("official_count") > 0, 2).when(primary, 1).otherwise(0),
        "timestamp": F.when((F.col("clear") > 0) & (F.col("clear") >= F.col("ambiguous") + F.col("record_only")), 3).when((F.col("clear") > 0) | (F.col("ambiguous") > 0), 2).when(F.col("record_only") > 0, 1).otherwise(0),
        **{c: _cut(F.size(c), cuts) for c, cuts in COUNT_CUTS.items()},
        "sample": _cut(hint, SAMPLE_CUTS),
        "mapping": F.when(F.trim("mapping_notes") == "", 1).otherwise(_words(F.col("mapping_notes"), MAPPING_WORDS, 1)),
        "liquidity": _words(F.col("liquidity_notes"), LIQUIDITY_WORDS, 1),
        "parser": F.when((hard >= 5) & (F.col("evidence_count") >= 3), 3).otherwise(_cut(hard, (1, 3, 10**6))),
        "fresh": F.when((F.col("source_count") >= 2) & (hint >= 200), 3).when((hint >= 80) | (n >= 3), 2).when((hint >= 30) | (n >= 2), 1).otherwise(0),
    }
    out = cands.withColumns({f"s_{k}": v for k, v in parts.items()})
    return out.withColumn("total", sum((F.col(f"s_{k}") for k in SCORES), F.lit(0)))


def penalise(scored: DataFrame, feedback: DataFrame) -> DataFrame:
    """Candidates whose feedback shows a positive yield of at most 1 % over 50 rows and more lose their sample and freshness scores."""
    per = feedback.groupBy("slug").agg(F.sum("source_rows").alias("_rows"), F.sum("positive_rows").alias("_positive"))
    joined = scored.join(per, "slug", "left")
    poor = F.coalesce((F.col("_rows") >= PENALTY_ROWS) & (F.try_divide(F.col("_positive"), F.col("_rows")) <= PENALTY_YIELD), F.lit(False))
    joined = joined.withColumn("penalised", poor)
    for k in ("sample", "fresh"):
        joined = joined.withColumn(f"s_{k}", F.when(F.col("penalised"), 0).otherwise(F.col(f"s_{k}")))
    return joined.withColumn("total", sum((F.col(f"s_{k}") for k in SCORES), F.lit(0))).drop("_rows", "_positive")


def gate(scored: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """The gate of each candidate: the registry's word first, then the hard minimums, then the thresholds of the total."""
    df = scored if registry is None else scored.join(registry.select("slug", F.lower(F.col("status")).alias("registry_status")), "slug", "left")
    status = F.col("registry_status") if registry is not None else F.lit(None).cast("string")
    holds = lambda words: F.coalesce(F.array_contains(F.array(*[status.contains(w) for w in words]), True), F.lit(False))
    total = F.col("total")
    below = F.when(total >= FEASIBLE, "feasibility_only").when(total >= BACKLOG, "backlog").otherwise("skip")
    weak = F.array_contains(F.array(*[F.col(f"s_{k}") < HARD_MINIMUM for k in HARD_MINIMUMS]), True)
    decision = F.when(holds(MONITOR), "monitor_only").when(holds(FROZEN), "blocked_by_registry").when(weak, below).when(total >= FULL, "full_lifecycle").otherwise(below)
    return df.withColumn("gate", decision)


def gate_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in GATES]), c) - 1


def top_candidates(gated: DataFrame, n: int) -> DataFrame:
    """The first ``n`` by gate, then total, then slug."""
    best = gated.orderBy(gate_rank(F.col("gate")), F.desc("total"), "slug").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(gate_rank(F.col("gate")), F.desc("total"), "slug")))  # n rows


def snapshot_diff(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per change between two snapshots by slug: added, removed, or a column's old and new value."""
    a = old.select("slug", F.lit(True).alias("_old"), *[F.col(c).cast("string").alias(f"o_{c}") for c in columns])
    b = new.select("slug", F.lit(True).alias("_new"), *[F.col(c).cast("string").alias(f"n_{c}") for c in columns])
    both = a.join(b, "slug", "full")
    entry = lambda kind, o, n: F.struct(F.lit(kind).alias("change"), o.alias("old_value"), n.alias("new_value"))
    nothing = F.lit(None).cast("string")
    there = F.col("_old") & F.col("_new")
    changes = F.array_compact(
        F.array(
            F.when(F.col("_old").isNull(), entry("added", nothing, nothing)), F.when(F.col("_new").isNull(), entry("removed", nothing, nothing)),
            *[F.when(there & ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), entry(c, F.col(f"o_{c}"), F.col(f"n_{c}"))) for c in columns],
        )
    )
    return both.select("slug", F.explode(changes).alias("c")).select("slug", "c.*")


def alert_rows(gated: DataFrame) -> DataFrame:
    """One row per candidate that calls for something, with severity, message and gate rank, by which, then by total and slug, they are read."""
    said = F.lit(None).cast("struct<severity:string,message:string>")
    for name, severity, message in ALERTS:
        said = F.when(F.col("gate") == name, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"))).otherwise(said)
    rows = gated.withColumn("_said", said).where(F.col("_said").isNotNull())
    return rows.select("slug", "gate", gate_rank(F.col("gate")).alias("gate_rank"), "total", "_said.*")


def explain(gated: DataFrame) -> DataFrame:
    """A row per candidate and sub-score: the score, the minimum that it has to reach, if any, and whether it fails it."""
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.col(f"s_{k}").cast("int").alias("score"), F.lit(HARD_MINIMUM if k in HARD_MINIMUMS else None).cast("int").alias("minimum")) for k in SCORES])
    rows = gated.select("slug", "gate", "total", F.explode(parts).alias("x")).select("slug", "gate", "total", "x.*")
    return rows.withColumn("fails", F.coalesce(F.col("score") < F.col("minimum"), F.lit(False)))


def alerts(gated: DataFrame) -> DataFrame:
    """Open candidates by severity; blocked and skipped ones are counted, not listed (severity ``suppressed``)."""
    severity = F.when(F.col("gate") == "full_lifecycle", "high").when(F.col("gate") == "feasibility_only", "medium").when(F.col("gate").isin("monitor_only", "backlog"), "low").otherwise("suppressed")
    rows = gated.withColumn("severity", severity)
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.max("total").alias("best_total"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("severity") != "suppressed", F.col("slug")))), ",").alias("slugs"))


def resolve_entities(hints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates per document from hints (doc, entity key, confidence, has_evidence), with a status for the best.

    Confidence is the mean plus .08 a hint (at most .24) plus .08 for evidence, at most 1. The best is
    ``ambiguous`` if the next is within .05, else ``resolved``; others are ``candidate``. Ties go to the lesser key.
    """
    n = F.count("*")
    per = hints.groupBy(*keys, "entity").agg(
        n.alias("hints"), F.round(F.least(F.lit(1.0), F.avg("confidence") + F.least(n * 0.08, F.lit(0.24)) + F.when(F.bool_or("has_evidence"), 0.08).otherwise(0.0)), 9).alias("confidence")
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "entity")
    ranked = per.withColumn("rank", F.row_number().over(w)).withColumn("_next", F.lead("confidence").over(w))
    tied = F.coalesce(F.col("confidence") - F.col("_next") <= 0.05 + 1e-12, F.lit(False))
    return ranked.withColumn("status", F.when(F.col("rank") > 1, "candidate").when(tied, "ambiguous").otherwise("resolved")).drop("_next")


def resolve_times(hints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most confident hint of each kind, and the mean confidence over kinds."""
    best = hints.groupBy(*keys, "kind").agg(F.max(F.struct("confidence", "value")).alias("b"))
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind", F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence")))).alias("hints"), F.avg("b.confidence").alias("confidence"))


def readiness(dimensions: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted score per plugin and level, with its band. A level none of whose dimensions is known scores 0; unknown dimensions count as 0."""
    known = dimensions.select("plugin", F.col("name").alias("_n"), "score")
    grid = dimensions.select("plugin").distinct().join(F.broadcast(weights))  # weights: a fixed small table
    joined = grid.join(known, (grid["plugin"] == known["plugin"]) & (grid["name"] == known["_n"]), "left").select(grid["plugin"], "level", "weight", "score")
    value = F.try_divide(F.sum(F.coalesce("score", F.lit(0.0)) * F.col("weight")), F.sum("weight"))
    out = joined.groupBy("plugin", "level").agg(F.coalesce(F.when(F.count("score") > 0, value), F.lit(0.0)).alias("score"))
    return out.withColumn("band", F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.6, "medium").when(F.col("score") >= 0.35, "low").otherwise("very_low"))
