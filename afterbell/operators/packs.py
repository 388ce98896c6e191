"""Shipped rule packs, what a pack says about itself, how well documents suit it, and adapters from source tables to documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from afterbell.functions.exprs import collapse_white, stable_id
from afterbell.operators import evidence as E


@dataclass(frozen=True)
class Manifest:
    """What a plug-in supports and needs. ``required`` and ``optional`` name columns of documents."""

    name: str
    version: str
    kind: str
    sources: Sequence[str] = ()
    families: Sequence[str] = ()
    schemas: Sequence[str] = ()
    required: Sequence[str] = ()
    optional: Sequence[str] = ()
    risks: Sequence[str] = ()
    outputs: Sequence[str] = ()


@dataclass(frozen=True)
class Pack:
    """A domain plug-in: manifest, the rule that makes a document a candidate, and the rules of its claims."""

    manifest: Manifest
    detector: E.Rule
    rules: Sequence[E.Rule] = field(default_factory=tuple)
    threshold: float = 0.8


@dataclass(frozen=True)
class Adapter:
    """A source: its manifest and the expressions that make normalised documents of its rows.

    ``columns`` maps source_record_id, source_url, title, published_at, source_role and text to SQL expressions.
    """

    manifest: Manifest
    columns: Mapping[str, str]

    def discover(self, rows: DataFrame, where: Column | None = None) -> DataFrame:
        """The records (all columns but the text) that meet a condition on the source's rows."""
        return (rows if where is None else rows.where(where)).select(*[F.expr(e).alias(n) for n, e in self.columns.items() if n != "text"])

    def normalise(self, rows: DataFrame) -> DataFrame:
        """Documents: id by content, source, title, time, role, text without tags and with single spaces, its hash."""
        named = rows.select(*[F.expr(e).alias(n) for n, e in self.columns.items()])
        text = collapse_white(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "<[^>]+>", " "))
        out = named.withColumn("text", text).withColumn("content_hash", F.sha2("text", 256)).withColumn("source_system", F.lit(self.manifest.name))
        return out.withColumn("doc_id", stable_id("doc", F.lit(self.manifest.name), F.col("source_record_id"), F.col("content_hash")))


def compatibility(docs: DataFrame, manifest: Manifest) -> DataFrame:
    """One row per column the plug-in asks for: plugin, name, score (share of documents that have it), basis. One pass; absent columns score 0."""
    asked = [(c, "required") for c in manifest.required] + [(c, "optional") for c in manifest.optional]
    known = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) if c in docs.columns else F.lit(False)
    shares = docs.agg(*[F.coalesce(F.avg(known(c).cast("double")), F.lit(0.0)).alias(f"s{i}") for i, (c, _) in enumerate(asked)])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"s{i}").alias("score"), F.lit(basis).alias("basis")) for i, (c, basis) in enumerate(asked)])
    return shares.select(F.explode(rows).alias("x")).select(F.lit(manifest.name).alias("plugin"), "x.*")


def detect(docs: DataFrame, pack: Pack) -> DataFrame:
    """Candidates: documents (doc_id, text, and source_role if there is one) that the pack's detector finds, with the sentence as evidence.

    Confidence is the detector's, less .16 for sources that aren't canonical.
    """
    found = E.match_rules(docs, [pack.detector])
    role = docs.select("doc_id", F.col("source_role") if "source_role" in docs.columns else F.lit("canonical").alias("source_role"))
    confidence = F.round(F.col("confidence") - F.when(F.col("source_role") == "canonical", 0.0).otherwise(0.16), 6)
    return found.join(role, "doc_id").select(
        stable_id("event_candidate", F.col("doc_id"), F.col("evidence_text")).alias("event_id"), "doc_id", F.lit(pack.manifest.families[0]).alias("event_family"),
        F.col("value").alias("event_type"), confidence.alias("confidence"), "start_char", "end_char", "evidence_text",
    )


def extract(docs: DataFrame, candidates: DataFrame, pack: Pack) -> DataFrame:
    """Claims of the candidates' documents, with the candidate's id."""
    wanted = candidates.select("doc_id", "event_id")
    matches = E.match_rules(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), pack.rules)
    return E.claims_of(matches).join(wanted.withColumnRenamed("doc_id", "source_doc_id"), "source_doc_id")


# Fields, the words that assert them, and what takes them back.
_DATA = r"(?i)\b(personal information|protected health information|(customer|client|consumer|patient|member) (information|data|records)|pii|phi|records|files|database|email account)\b"
_TAKEN = r"(?i)\b(accessed|exposed|exposure|stolen|copied|viewed|compromised|breached|affected|involved|acquired|contained|included)\b"
_NOT_FOUND = r"(?i)no evidence|not identified|has not identified|no indication|not yet determined|cannot confirm"
_VENDOR = r"(?i)\b(vendor|supplier|service provider|third[- ]party (vendor|supplier|service provider|platform|system|data processor|processor)|external system|data processor)\b"
_NO_IMPACT = r"(?i)no material impact|(has not had|did not have) (a|any) material impact|has not materially impacted|not (reasonably )?likely to (materially impact|have a material impact)|not expected to have a material|not currently expect[^.]{0,80}material impact"
INCIDENT_PACK = Pack(
    Manifest(
        "incident_filings", "1", "pipeline", ("filings",), ("cybersecurity_incident_disclosure",), ("incident_claims",), ("doc_id", "text"), ("form", "published_at"),
        ("regulatory language is hedged",), ("candidate", "claim", "evidence_span"),
    ),
    E.Rule("incident", r"(?i)\bitem\s+1\.05\b|cybersecurity incident|ransomware|unauthorized access|data breach", "cybersecurity_incident", 0.78),
    (
        E.Rule("amendment_flag", r"(?i)\b8-k/a\b", confidence=0.86),
        E.Rule("item_105_flag", r"(?i)\bitem\s+1\.05\b|material cybersecurity incident", confidence=0.96),
        E.Rule("ransomware_mentioned", r"(?i)\b(ransomware|ransom|extortion|encrypted|encryption)\b", confidence=0.90),
        E.Rule("customer_data_exposure_mentioned", r"(?i)\b(customer|client|consumer|patient|member) (data|information|records)|protected health information|\bphi\b|personally identifiable information|\bpii\b|personal information", confidence=0.86, reject=r"(?i)^[^.]*\bemployee", spared=r"(?i)customer|client|consumer|patient|member|protected health|personally identifiable|\b(phi|pii)\b"),
        E.Rule("operational_disruption_mentioned", r"(?i)operational disruption|business interruption|systems? offline|disrupted|disruption|operations? (were )?(affected|interrupted)", confidence=0.88),
        E.Rule("third_party_vendor_mentioned", r"(?i)third[- ]party|vendor|supplier|service provider", confidence=0.84),
        E.Rule("impact_unknown_or_not_determined", r"(?i)impact (has )?not (yet )?been determined|unable to determine|cannot determine|continues? to assess|still assessing|not yet determined", confidence=0.88),
        E.Rule("no_material_impact_language", _NO_IMPACT, confidence=0.91),
        E.Rule("reasonably_likely_material_impact_language", r"(?i)reasonably likely to (materially impact|have a material impact)|materially impact(ed)?", confidence=0.84, reject=_NO_IMPACT + "|not (yet )?determined"),
        E.Rule("financial_impact_language", r"(?i)financial impact|results of operations|financial condition|revenue|costs?|expenses?|material impact", "evidence", 0.80),
        E.Rule("materiality_language", r"(?i)determined [^.]*material|material impact|materially impact", "evidence", 0.82, reject=r"(?i)^(item 1\.05\s*)?material cybersecurity incidents?[.]?$"),
    ),
)
PRESS_PACK = Pack(
    Manifest(
        "company_press_releases", "1", "pipeline", ("press_releases",), ("cybersecurity_incident_disclosure",), ("press_release_claims",), ("doc_id", "text", "source_url"), ("published_at", "company_name", "domain"),
        ("times are less precise than those of filings", "the company chose the words"), ("document", "candidate", "claim", "evidence_span"),
    ),
    E.Rule("incident", r"(?i)\b(cybersecurity incident|ransomware|unauthorized access|data exposure|security incident)\b", "cybersecurity_incident", 0.78),
    (
        E.Rule("ransomware_mentioned", r"(?i)\bransomware\b", confidence=0.88),
        E.Rule("operational_disruption_mentioned", r"(?i)\b(disrupted|disruption|operations? (were )?affected|operational impact|service outage)\b", confidence=0.80),
        E.Rule("third_party_vendor_mentioned", _VENDOR, confidence=0.72, reject=r"(?i)forensic|(cybersecurity|response) (expert|advisor|consultant|team|firm|provider)|outside counsel|investigator|advisor|consultant", spared=r"(?i)\b(involved|originated|accessed|compromised|affected|breached|exposed|platform|system|processor|vendor|supplier|service provider)\b"),
        E.Rule("customer_data_exposure_mentioned", _DATA, confidence=0.76, need=_TAKEN, reject=_NOT_FOUND),
        E.Rule("impact_unknown_or_not_determined", r"(?i)\b(not yet determined|unable to determine|continues to assess)\b[^.!?]{0,80}\b(impact|scope)\b", confidence=0.74),
        E.Rule("no_material_impact_language", _NO_IMPACT, confidence=0.78),
        E.Rule("financial_impact_language", r"(?i)\b(financial impact|costs? associated with|expenses? associated with|material impact)\b", "evidence", 0.68),
    ),
    0.7,
)
PRESS_ADAPTER = Adapter(
    PRESS_PACK.manifest,
    {"source_record_id": "source_record_id", "source_url": "source_url", "title": "title", "published_at": "published_at", "source_role": "coalesce(nullif(trim(source_role), ''), 'canonical')", "text": "concat_ws('\\n', title, text)"},
)
PACKS = {p.manifest.name: p for p in (INCIDENT_PACK, PRESS_PACK)}
