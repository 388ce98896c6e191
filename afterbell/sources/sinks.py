"""Publishing: JSON packets, digests, reports and run manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afterbell.operators.quantiles import value_range, with_quantile


def packets(docs: DataFrame, fields: list[str], max_chars: int = 12_000) -> DataFrame:
    """source_doc_id and JSON for an external extractor: document, title, wanted fields and the first ``max_chars`` characters, as its limit asks."""
    packet = F.to_json(F.struct("source_doc_id", "title", F.array(*[F.lit(f) for f in fields]).alias("fields"), F.substring("text", 1, max_chars).alias("text")))
    return docs.select("source_doc_id", packet.alias("packet"))


def write_packets(docs: DataFrame, path: str, fields: list[str], max_chars: int = 12_000) -> None:
    """The packets as JSON lines."""
    packets(docs, fields, max_chars).select(F.col("packet").alias("value")).write.text(path)


def digest(claims: DataFrame, title: str, most: int = 20) -> str:
    """Markdown digest of the first ``most`` accepted claims by document and field, with counts per field."""
    accepted = claims.where(F.col("review_status").isin("human_verified", "accepted", "machine_high_confidence"))
    counts = accepted.groupBy("field_name").count().orderBy(F.desc("count"), "field_name").limit(100).collect()
    rows = accepted.orderBy("source_doc_id", "field_name").limit(most).collect()
    lines = [f"# {title}", "", "| field | claims |", "|-|-|", *[f"| {r.field_name} | {r['count']} |" for r in counts], ""]
    lines += [f"- **{r.field_name}** (document {r.source_doc_id}): {r.evidence_text}" for r in rows]
    return "\n".join(lines) + "\n"


# Fields whose claims a digest of incidents names one by one.
NOTABLE = ("ransomware_mentioned", "customer_data_exposure_mentioned", "operational_disruption_mentioned", "third_party_vendor_mentioned", "reasonably_likely_material_impact_language")


def disclosures_digest(events: DataFrame, claims: DataFrame, start: str | None = None, end: str | None = None, title: str = "Disclosures", most: int = 20, listed: int = 200) -> str:
    """Markdown digest of the events of a period: counts, notable fields, amendments, and the first ``most`` pieces of evidence.

    events: event_id, ticker, event_time, amendment_flag. claims: event_id, field_name, review_status,
    evidence_text. A section lists ``listed`` events at most and says how many more there are.
    """
    chosen = events
    chosen = chosen.where(F.col("event_time") >= F.lit(start).cast("timestamp")) if start else chosen
    chosen = chosen.where(F.col("event_time") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")) if end else chosen
    own = claims.join(chosen.select("event_id").distinct(), "event_id", "left_semi")
    amended = F.coalesce(F.col("amendment_flag"), F.lit(False))
    e = chosen.agg(F.count("*").alias("n"), F.count_distinct(F.nullif(F.trim("ticker"), F.lit(""))).alias("companies"), F.count_if(amended).alias("amendments")).first()
    c = own.agg(F.count("*").alias("n"), F.count_if(F.lower("review_status").isin("reviewed", "approved", "human_verified")).alias("reviewed")).first()
    lines = [f"# {title}", "", f"- events: {e.n}", f"- companies: {e.companies}", f"- amendments: {e.amendments}", f"- reviewed claims: {c.reviewed}", f"- unreviewed claims: {c.n - c.reviewed}"]

    def section(name: str, rows: DataFrame, line) -> None:
        found = rows.limit(listed + 1).collect()
        lines.extend(["", f"## {name}", "", *[line(r) for r in found[:listed]]])
        if not found:
            lines.append("None in this period.")
        elif len(found) > listed:
            lines.append(f"- and {rows.count() - listed} more")

    notable = own.where(F.col("field_name").isin(*NOTABLE)).select("event_id", "field_name").distinct().join(chosen.select("event_id", "ticker"), "event_id")
    section("Notable disclosures", notable.orderBy("field_name", "event_id"), lambda r: f"- **{r.ticker or 'UNKNOWN'}** {r.field_name}: {r.event_id}")
    section("Amendments", chosen.where(amended).orderBy("event_time", "event_id"), lambda r: f"- **{r.ticker or 'UNKNOWN'}** {r.event_time}: {r.event_id}")
    snippets = own.where(F.trim("evidence_text") != "").select("field_name", F.substring("evidence_text", 1, 280).alias("text"), "event_id")
    lines += ["", "## Evidence", "", *[f"- {r.field_name}: {r.text}" for r in snippets.orderBy("event_id", "field_name", "text").limit(most).collect()]]
    return "\n".join(lines).rstrip() + "\n"


def surprise_buckets(study: DataFrame, horizon: int = 1) -> DataFrame:
    """Moments of the abnormal return by surprise bucket (rows without one are left out): n, means, median and the share of significant ones."""
    car = f"car_{horizon}"
    rows = study.where((F.col("status") == "ok") & F.col(car).isNotNull() & (F.coalesce(F.col("surprise_bucket"), F.lit("unknown")) != "unknown"))
    stats = rows.groupBy("surprise_bucket").agg(
        F.count("*").alias("n"), F.avg("surprise_score").alias("mean_surprise"), F.avg(car).alias("mean_car"), F.avg(F.col(f"significant_{horizon}").cast("double")).alias("significant_rate"), value_range(car, 0.5).alias("_between")
    )
    return with_quantile(stats, rows, car, ["surprise_bucket"], 0.5, "median_car", "n", "_between")


def study_report(study: DataFrame, horizon: int = 1) -> str:
    """Markdown report of an event study: coverage, ten most frequent skip reasons, base rates by type, surprise buckets if the study has them, ten largest moves."""
    car = f"car_{horizon}"
    status = study.groupBy("status").count().orderBy(F.desc("count"), "status").limit(11).collect()
    rates = study.where(f"status = 'ok' and {car} is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.avg(car).alias("mean")).orderBy(F.desc("n"), "event_type").limit(100).collect()
    largest = study.where(f"{car} is not null").orderBy(F.desc(F.abs(car)), "event_id").limit(10).collect()
    lines = ["# Event study", "", "| status | events |", "|-|-|", *[f"| {r.status} | {r['count']} |" for r in status], "", "| type | n | mean |", "|-|-|-|"]
    lines += [f"| {r.event_type} | {r.n} | {r['mean']:.4f} |" for r in rates]
    if "surprise_bucket" in study.columns:
        lines += ["", "| surprise | n | mean surprise | mean | median | significant |", "|-|-|-|-|-|-|"]
        lines += [f"| {r.surprise_bucket} | {r.n} | {r.mean_surprise or 0:.4f} | {r.mean_car:.4f} | {r.median_car:.4f} | {r.significant_rate:.4f} |" for r in surprise_buckets(study, horizon).orderBy("surprise_bucket").limit(20).collect()]
    lines += ["", "| event | ticker | abnormal return |", "|-|-|-|"]
    return "\n".join(lines + [f"| {r.event_id} | {r.ticker} | {r[car]:.4f} |" for r in largest]) + "\n"


def canonical_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def run_manifest(spark, name: str, config: dict, inputs: list[str]) -> DataFrame:
    """One row per input file with its SHA-256, next to the run's name and the hash of its configuration. Files are hashed by Spark."""
    files = spark.read.format("binaryFile").load(inputs)
    return files.select(F.lit(name).alias("run"), F.lit(canonical_hash(config)).alias("config_sha256"), "path", "length", F.sha2("content", 256).alias("sha256"))
