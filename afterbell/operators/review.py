"""Review queues, overrides, quality, recall, readiness and promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from afterbell.functions.exprs import blank_to_null, issues, truthy

#: Review statuses that a person set and that no rule may change.
HUMAN = ("human_verified", "human_rejected", "accepted", "rejected", "reviewed")
USABLE = ("human_verified", "accepted", "machine_high_confidence")


def claim_queue(claims: DataFrame, evidence: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Claims with their evidence and a status: people's statuses stay, missing evidence needs review, confident claims pass.

    The join is on (evidence_span_id, source_doc_id, claim_id) and matches nulls with nulls; the
    evidence side is deduped first.
    """
    keys = ["evidence_span_id", "source_doc_id", "claim_id"]
    side = evidence.groupBy(*keys).agg(F.min("evidence_text").alias("_evidence")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_evidence")
    joined = claims.join(side, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    present = blank_to_null(F.col("_evidence")).isNotNull()
    status = (
        F.when(F.col("review_status").isin(*HUMAN), F.col("review_status"))
        .when(~present, "needs_review")
        .when(F.col("confidence") >= threshold, "machine_high_confidence")
        .otherwise("needs_review")
    )
    flags = issues((~present, "missing_evidence"), (F.col("confidence") < threshold, "low_confidence"), (blank_to_null(F.col("value")).isNull(), "blank_value"))
    return joined.withColumn("evidence_present", present).withColumn("review_status", status).withColumn("issue_flags", F.array_join(flags, ";")).drop("_evidence", *[f"_{k}" for k in keys])


def override_non_blank(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left rows with the columns of the right row of the same key where these aren't blank. Of several right rows the greatest key order wins."""
    side = right.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).alias("_o"))
    joined = left.join(side, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(blank_to_null(F.col("_o")[c]), F.col(c)))
    return joined.drop("_o")


def override_known(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left rows with the right row's values where they aren't NULL; right keys must be unique."""
    joined = left.join(right.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns]), key, "left")
    return joined.select(*[F.coalesce(f"_r_{c}", c).alias(c) if c in columns else F.col(c) for c in left.columns], *[F.col(f"_r_{c}").alias(c) for c in columns if c not in left.columns])


def field_coverage(claims: DataFrame, events: int | None = None) -> DataFrame:
    """Per field: claims, distinct events, coverage, status counts, yield (verified / (verified + rejected))."""
    status = F.col("review_status")
    total = claims.select(F.count_distinct("event_id").alias("_events")) if events is None else claims.sparkSession.range(1).select(F.lit(events).alias("_events"))
    human, rejected = F.sum(status.isin("human_verified", "accepted").cast("long")), F.sum(status.isin("human_rejected", "rejected").cast("long"))
    per = claims.groupBy("field_name").agg(
        F.count("*").alias("claims"), F.count_distinct("event_id").alias("events"), human.alias("verified"), rejected.alias("rejected"),
        F.sum((status == "needs_review").cast("long")).alias("needs_review"), F.try_divide(human, human + rejected).alias("yield"), F.avg("confidence").alias("mean_confidence"),
    )
    return per.join(F.broadcast(total)).withColumn("coverage", F.try_divide(F.col("events"), F.col("_events"))).drop("_events")  # one row


def exploded_counts(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """How often each trimmed, non-blank part of a separated list occurs."""
    return df.select(F.explode(F.split(F.coalesce(F.col(column), F.lit("")), separator)).alias("v")).select(F.trim("v").alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def missing_claim_recall(claims: DataFrame, missing: DataFrame) -> DataFrame:
    """extracted / (extracted + missing) per field, and for all fields."""
    a = claims.groupBy("field_name").agg(F.count("*").alias("extracted"))
    b = missing.groupBy(F.col("expected_field").alias("field_name")).agg(F.count("*").alias("missing"))
    both = a.join(b, "field_name", "full").select("field_name", F.coalesce("extracted", F.lit(0)).alias("extracted"), F.coalesce("missing", F.lit(0)).alias("missing"))
    every = both.unionByName(both.agg(F.lit("all").alias("field_name"), F.sum("extracted").alias("extracted"), F.sum("missing").alias("missing")))
    return every.withColumn("recall", F.try_divide(F.col("extracted"), F.col("extracted") + F.col("missing")))


def quality_report(claims: DataFrame) -> DataFrame:
    """One row: counts, rates and warnings over all claims."""
    s = F.col("review_status")
    one = claims.agg(
        F.count("*").alias("claims"), F.count_distinct("event_id").alias("events"), F.count_distinct("source_doc_id").alias("documents"),
        F.sum(F.col("evidence_present").cast("long")).alias("with_evidence"), F.sum(s.isin("human_verified", "accepted").cast("long")).alias("verified"),
        F.sum(s.isin("human_rejected", "rejected").cast("long")).alias("rejected"), F.sum((s == "machine_high_confidence").cast("long")).alias("machine"),
        F.sum((s == "needs_review").cast("long")).alias("needs_review"), F.avg("confidence").alias("mean_confidence"),
    )
    rate = lambda a, b: F.try_divide(a, b)
    reviewed = F.col("verified") + F.col("machine")
    one = one.withColumn("review_rate", rate(F.col("needs_review"), F.col("claims"))).withColumn("yield", rate(F.col("verified"), F.col("verified") + F.col("rejected")))
    warnings = issues(
        (F.col("with_evidence") < F.col("claims"), "missing_evidence"),
        (F.coalesce(F.col("review_rate") > 0.5, F.lit(False)), "high_needs_review_rate"),
        (F.coalesce(rate(reviewed, F.col("claims")) < 0.5, F.lit(False)), "low_human_review_coverage"),
    )
    return one.withColumn("reviewed", reviewed).withColumn("warnings", F.array_join(warnings, ";"))


def event_rows(docs: DataFrame, claims: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Documents to event rows: one true/false per field, claim count, review status; the first document of an event stands for it."""
    w = Window.partitionBy("event_id").orderBy("doc_id")
    first = docs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    per = claims.groupBy("event_id").agg(
        *[F.bool_or((F.col("field_name") == f) & truthy(F.col("value"))).alias(f) for f in fields],
        F.count("*").alias("claim_count"), F.bool_and(F.col("review_status").isin(*USABLE)).alias("_all_usable"),
    )
    joined = first.join(per, "event_id", "left")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(f, F.lit(False)))
    status = F.when(F.col("claim_count").isNull(), "no_claims").when(F.col("_all_usable"), "reviewed").otherwise("needs_review")
    return joined.withColumn("review_status", status).withColumn("claim_count", F.coalesce("claim_count", F.lit(0))).drop("_all_usable")


def nested_export(events: DataFrame, claims: DataFrame) -> DataFrame:
    """One JSON text per event that holds its claims in order, each with its evidence."""
    claim = F.struct("field_name", "claim_id", "value", "confidence", F.struct("start_char", "end_char", "evidence_text").alias("evidence"))
    per = claims.groupBy("event_id").agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    joined = events.join(per, "event_id", "left")
    return joined.select("event_id", F.coalesce(F.size("claims"), F.lit(0)).alias("n_claims"), F.to_json(F.struct("event_id", *[c for c in events.columns if c != "event_id"], "claims")).alias("json"))


def readiness_decision(rows: DataFrame, gates: dict[str, Column], minimums: dict[str, int]) -> DataFrame:
    """Per group of ``rows`` a decision from conditional counts: model_ready, needs_review, monitor_only or reject_modeling."""
    counts = rows.agg(F.count("*").alias("rows"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(k) for k, c in gates.items()])
    short = [F.col(k) < n for k, n in minimums.items()]
    failed = issues(*[(s, f"too_few_{k}") for s, k in zip(short, minimums, strict=True)])
    decision = F.when(F.col("rows") == 0, "reject_modeling").when(F.col("eligible") == 0, "monitor_only").when(F.size(failed) > 0, "needs_review").otherwise("model_ready")
    return counts.withColumn("failed_gates", F.array_join(failed, ";")).withColumn("decision", decision)
