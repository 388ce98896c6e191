"""Facts in long form (event_id, fact_name, value, unit, confidence, evidence_text, ...): dedupe, pivot, counts, gold evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from afterbell.functions.exprs import blank_to_null, collapse_white


def better(priority: Column | None = None) -> Column:
    """Order of facts of one key: confidence, priority, shorter evidence, then the larger value, so that ties are decided."""
    return F.struct(
        F.coalesce(F.col("confidence"), F.lit(-1.0)).alias("a"), (priority if priority is not None else F.lit(0)).alias("b"),
        (-F.length(F.coalesce("evidence_text", F.lit("")))).alias("c"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("d"), F.coalesce("evidence_text", F.lit("")).alias("e"),
    )


def best_facts(facts: DataFrame, keys: Sequence[str] = ("event_id", "fact_name"), least: float = 0.0, priority: Column | None = None) -> DataFrame:
    """One fact per key, the best by :func:`better`; map-side maxima, no window over a key's rows."""
    kept = facts.where(F.col("confidence") >= least)
    types = dict(facts.dtypes)
    order = better(priority)
    # what the order holds already is read back from it, so a row carries its value and evidence once
    held = {
        "confidence": F.col("_b.o.a").cast(types["confidence"]),
        "value": F.when(F.col("_b.v"), F.col("_b.o.d")).cast(types["value"]),
        "evidence_text": F.when(F.col("_b.t"), F.col("_b.o.e")),
    }
    if types["value"] not in ("string", "tinyint", "smallint", "int", "bigint", "boolean"):
        del held["value"]  # its text may not give it back
    if types["confidence"] not in ("double", "float"):
        del held["confidence"]
    rest = [c for c in facts.columns if c not in keys and c not in held]
    one = F.struct(order.alias("o"), F.col("value").isNotNull().alias("v"), F.col("evidence_text").isNotNull().alias("t"), *[F.col(c).alias(f"r_{c}") for c in rest])
    best = kept.groupBy(*keys).agg((F.max(one) if _ordered(facts, rest) else F.max_by(one, order)).alias("_b"), F.count("*").alias("candidates"))
    return best.select(*keys, *[(held[c] if c in held else F.col(f"_b.r_{c}")).alias(c) for c in facts.columns if c not in keys], "candidates")


def _ordered(facts: DataFrame, columns: Sequence[str]) -> bool:
    """Whether the columns can be compared (maps can't)."""
    return not any("map<" in t or "variant" in t for c, t in facts.dtypes if c in columns)


def pivot_facts(facts: DataFrame, names: Sequence[str], least: float = 0.7) -> DataFrame:
    """One row per event with value, confidence and evidence of each named fact, and the number of usable facts before the choice."""
    usable = facts.where(F.col("confidence") >= least)
    aggregates: list[Column] = [F.count("*").alias("usable_fact_count")]
    order = better()
    for n in names:
        best = F.max_by(F.struct("value", "confidence", "evidence_text"), F.when(F.col("fact_name") == n, order))
        aggregates += [best["value"].alias(n), best["confidence"].alias(f"{n}_confidence"), best["evidence_text"].alias(f"{n}_evidence")]
    return usable.groupBy("event_id").agg(*aggregates)


def fact_counts(facts: DataFrame) -> DataFrame:
    """Per event: facts, facts with evidence, mean confidence, sorted distinct names joined by commas."""
    return facts.groupBy("event_id").agg(
        F.count("*").alias("fact_count"),
        F.count(blank_to_null(F.col("evidence_text"))).alias("evidence_count"),
        F.avg("confidence").alias("mean_confidence"),
        F.array_join(F.array_sort(F.collect_set("fact_name")), ",").alias("fact_names"),
    )


#: Tolerance of a value by its unit, where the gold row names none.
TOLERANCES = {"usd": 1e6, "shares": 1.0, "usd_per_share": 0.01, "fraction": 0.0025}


def evaluate_against_gold(gold: DataFrame, facts: DataFrame) -> DataFrame:
    """Each gold row (event_id, fact_name, expected_value, unit, tolerance, expected_present) against the most confident fact.

    ok, wrong_value, missed, or false_positive (a fact where none is expected). Units usd, shares,
    usd_per_share and fraction compare as numbers within the tolerance, others as texts.
    """
    found = best_facts(facts).select("event_id", "fact_name", F.col("value").cast("string").alias("found_value"), F.col("confidence").alias("found_confidence"))
    rows = gold.join(found, ["event_id", "fact_name"], "left")
    tolerance = F.col("tolerance")
    for unit, t in TOLERANCES.items():
        tolerance = F.coalesce(tolerance, F.when(F.col("unit") == unit, t))
    a, b = F.col("found_value").try_cast("double"), F.col("expected_value").cast("string").try_cast("double")
    numeric = F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    text = F.coalesce(F.lower(collapse_white(F.col("found_value"))) == F.lower(collapse_white(F.col("expected_value").cast("string"))), F.lit(False))
    same = F.when(F.col("unit").isin(*TOLERANCES), numeric).otherwise(text)
    status = (
        F.when(~F.col("expected_present"), F.when(F.col("found_value").isNull(), "ok").otherwise("false_positive"))
        .when(F.col("found_value").isNull(), "missed")
        .when(same, "ok")
        .otherwise("wrong_value")
    )
    return rows.withColumn("status", status)


def gold_summary(evaluated: DataFrame) -> DataFrame:
    """Accuracy and recall per fact, and over all (fact_name ``all``)."""
    present = F.col("expected_present")
    hit = (F.col("status") == "ok").cast("double")
    rows = evaluated.withColumn("fact_name", F.explode(F.array(F.col("fact_name"), F.lit("all"))))
    return rows.groupBy("fact_name").agg(
        F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(F.when(present, hit)).alias("recall"),
        *[F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("ok", "wrong_value", "missed", "false_positive")],
    )


def validate_external_facts(packets: DataFrame, docs: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Facts out of external packets (source_doc_id, facts array), with offsets, and what is wrong with each.

    issue: unknown_document, unknown_fact, not_numeric, missing_evidence (the evidence doesn't occur
    in the text), or empty. Callers that want to stop use :func:`raise_on_issues`.
    """
    rows = packets.select("source_doc_id", F.posexplode("facts").alias("fact_index", "f")).select("source_doc_id", "fact_index", "f.*")
    joined = rows.join(docs.select(F.col("source_doc_id"), F.col("text").alias("_text")), "source_doc_id", "left")
    start = F.expr("instr(_text, evidence_text)")
    issue = (
        F.when(F.col("_text").isNull(), "unknown_document")
        .when(~F.col("fact_name").isin(*allowed), "unknown_fact")
        .when(F.col("value").cast("string").try_cast("double").isNull(), "not_numeric")
        .when(blank_to_null(F.col("evidence_text")).isNull() | (start == 0), "missing_evidence")
        .otherwise("")
    )
    return joined.withColumn("issue", issue).withColumn("start_char", F.when(F.col("issue") == "", start - 1)).withColumn(
        "end_char", F.when(F.col("issue") == "", start - 1 + F.length("evidence_text"))
    ).drop("_text")


def raise_on_issues(validated: DataFrame, most: int = 5) -> DataFrame:
    bad = validated.where("issue <> ''").limit(most).collect()  # at most ``most`` rows
    if bad:
        raise ValueError("invalid facts: " + "; ".join(f"{r.source_doc_id}#{r.fact_index}: {r.issue}" for r in bad))
    return validated
