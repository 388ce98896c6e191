"""Sections of releases and filings, and trial news read by section: events, facts with evidence, what isn't news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from afterbell.functions import trials as T
from afterbell.functions.domains import met
from afterbell.functions.exprs import collapse_white, starts_of

#: A mark between digits or beside one is part of a number.
SENTENCE_END = r"(?<![0-9])[.;!?](?![0-9])"
LEAST_CHARS, MOST_CHARS = 12, 900


def sectioned(docs: DataFrame) -> DataFrame:
    """Segments of (doc_id, text) with offsets, each in its section: doc_id, start_char, end_char, segment (white space collapsed), section, priority.

    Headings set the section of the lines after them: the running state is a window of the last known heading. Lines of a body are
    its headline and lead paragraph by their place; bulleted and labelled lines are a table; risk words make any segment a risk
    factor. A line whose parts are all too short or too long is one segment. Null texts have none; a doc_id is one text.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    cut = docs.select("doc_id", lines.alias("_lines"))
    placed = cut.select("doc_id", F.arrays_zip(starts_of(F.transform("_lines", lambda x: F.length(x) + 1)).alias("start"), F.col("_lines").alias("line")).alias("_l"))
    rows = placed.select("doc_id", F.posexplode_outer("_l").alias("_k", "l")).select("doc_id", "_k", F.col("l.start").alias("_at"), F.col("l.line").alias("_raw"))
    rows = rows.withColumn("_line", collapse_white(F.col("_raw"))).where("_line <> ''").withColumn("_low", F.lower("_line"))
    bare = F.expr("trim(BOTH ' :-' FROM _low)")
    about = bare.rlike(T.ABOUT)
    heading = F.when(about, "boilerplate").when(F.col("_low").rlike(T.RISKS), "risk_factor").when(bare.rlike(T.HIGHLIGHTS), "pipeline_table")
    order = Window.partitionBy("doc_id").orderBy("_k")
    rows = rows.withColumns({"_about": about, "_heading": heading}).withColumns({"_state": F.coalesce(F.last("_heading", ignorenulls=True).over(order), F.lit("body")), "_n": F.row_number().over(order) - 1})
    listed = F.col("_line").rlike(T.LISTED) & ~F.col("_state").isin(*T.NOT_NEWS)
    section = F.when(listed, "pipeline_table").when(F.col("_state") != "body", F.col("_state")).when(F.col("_n") < T.HEADLINE_LINES, "headline").when(F.col("_n") < T.LEAD_LINES, "lead_paragraph").otherwise("body")
    rows = rows.where(~F.col("_about")).select("doc_id", "_at", "_raw", "_line", section.alias("_section"), F.split("_raw", SENTENCE_END, -1).alias("_parts"))
    parts = F.zip_with("_parts", starts_of(F.transform("_parts", lambda x: F.length(x) + 1)), lambda p, a: F.struct(p.alias("text"), a.alias("at"), collapse_white(p).alias("clean")))
    fits = lambda c: F.length(c).between(LEAST_CHARS, MOST_CHARS)
    whole = F.array(F.struct(F.col("_raw").alias("text"), F.lit(0).alias("at"), F.col("_line").alias("clean")))
    rows = rows.withColumn("_kept", F.filter(parts, lambda p: fits(p["clean"])))
    chosen = F.when(F.size("_kept") > 0, F.col("_kept")).when(fits(F.col("_line")), whole)
    # outer, as an inner one would cut each line again to see that there is something to explode
    out = rows.select("doc_id", "_at", "_section", F.explode_outer(chosen).alias("p")).where("p is not null").select("doc_id", "_section", (F.col("_at") + F.col("p.at")).alias("_at"), F.col("p.text").alias("_text"), F.col("p.clean").alias("segment"))
    left = F.regexp_replace("_text", r"^\s+", "")
    start = F.col("_at") + F.length("_text") - F.length(left)
    out = out.withColumns({"start_char": start, "end_char": start + F.length(F.regexp_replace(left, r"\s+$", ""))})
    out = out.withColumn("section", F.when(F.lower("segment").rlike(T.RISK_SEGMENT), "risk_factor").otherwise(F.col("_section")))
    return out.select("doc_id", "start_char", "end_char", "segment", "section", (F.array_position(F.array(*map(F.lit, T.SECTIONS)), F.col("section")) - 1).cast("int").alias("priority"))


def _first(rules, low: Column) -> Column:
    """Number of the first rule that a segment meets, NULL for none."""
    out = F.lit(None).cast("int")
    for i, (_, pattern, _) in reversed(list(enumerate(rules))):
        out = F.when(met(low, pattern), i).otherwise(out)
    return out


def _marked(segments: DataFrame) -> DataFrame:
    """Segments with what they say: reasons against them, whether the endpoint was met, the phase, events and readouts."""
    low = F.lower("segment")
    endpoint = F.when(low.rlike(T.MISSED), False).when(low.rlike(T.MET), True)
    rows = segments.withColumns({"low": low, "endpoint": endpoint}).withColumn("finding", F.col("endpoint").isNotNull() | F.col("low").rlike(T.FINDING))
    low = F.col("low")
    told = {name: low.rlike(pattern) & ~F.col("finding") if spared else low.rlike(pattern) for name, pattern, spared in T.REASONS}
    told[T.REASONS[0][0]] |= F.col("section").isin(*T.NOT_NEWS)
    reason = F.when(F.col("section") == "pipeline_table", T.PIPELINE_REASON)
    for name, cond in reversed(told.items()):
        reason = F.when(cond, name).otherwise(reason)
    phase = F.lit(None).cast("int")
    for i, (_, pattern, _, _) in reversed(list(enumerate(T.PHASES))):
        phase = F.when(low.rlike(pattern), i).otherwise(phase)
    rows = rows.withColumns({"reason": reason, "phase": phase, "also": F.array_compact(F.array(*[F.when(told[n], n) for n in T.ALWAYS_TOLD]))})
    news = F.col("reason").isNull() | (F.col("reason") == T.PIPELINE_REASON)
    readout = news & low.rlike(T.RESULT) & low.rlike(T.SUBJECT) & ((F.col("section") != "pipeline_table") | low.rlike(T.TABLE_RESULT)) & (~low.rlike(T.PATIENTS) | low.rlike(T.OUTCOME))
    return rows.withColumns({"before": F.when(news, _first(T.BEFORE_READOUTS, low)), "readout": readout, "after": F.when(news, _first(T.AFTER_READOUTS, low)), "mention": low.rlike(T.MENTION)})


def _pick(names, index: Column, kind: str = "string") -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index).cast(kind)


def first_value(patterns, text: Column, not_in=()) -> Column:
    """First group of the first pattern that matches with a value that is not blank nor one of ``not_in``."""
    values = [F.regexp_extract(text, p, 1) for p in patterns]
    return F.coalesce(*[F.when((v != "") & ~v.isin(*not_in) if not_in else v != "", v) for v in values])


def trial_events(docs: DataFrame) -> DataFrame:
    """One row per text with segments: the event that its best segment tells, with evidence, span, section and quality flags, and what follows from it.

    Rules have precedence, then sections (a headline before a table), then place. Segments of boilerplate, about what was announced
    before or is only planned, tell nothing. The winner is a minimum of (rule, section, place) per document, so each text is read
    once and partial results are merged before the shuffle; a readout takes the phase of its segment, else the first phase of the text.
    """
    rows = _marked(sectioned(docs))
    place = ["priority", "start_char", "end_char", "section", "segment"]
    best = lambda cond, *first: F.min(F.when(cond, F.struct(*first, *place, "endpoint", "phase", "low")))
    known = F.col("endpoint").isNotNull() | F.col("phase").isNotNull()
    docs_rows = rows.groupBy("doc_id").agg(
        best(F.col("before").isNotNull(), "before").alias("a"),
        best(F.col("readout") & known).alias("s"),
        best(F.col("readout")).alias("w"),
        best(F.col("after").isNotNull(), "after").alias("b"),
        best(F.col("mention")).alias("m"),
        F.min(F.when(F.col("phase").isNotNull(), F.struct("start_char", "phase")))["phase"].alias("doc_phase"),
        F.min(F.when(F.col("endpoint").isNotNull(), F.struct("start_char", "endpoint")))["endpoint"].alias("doc_endpoint"),
        F.collect_set(F.concat("also", F.array_compact(F.array("reason")))).alias("told"),
    )
    # without a phase anywhere a readout has to say how it ended
    docs_rows = docs_rows.withColumn("r", F.when(F.col("doc_phase").isNotNull(), F.col("w")).otherwise(F.col("s")))
    docs_rows = docs_rows.withColumn("t", F.when(F.col("a").isNotNull(), "a").when(F.col("r").isNotNull(), "r").when(F.col("b").isNotNull(), "b").otherwise("none"))
    phase = F.coalesce(F.col("r.phase"), F.col("doc_phase"))
    pivotal = F.col("r.low").contains("pivotal") | (_pick([p[0] for p in T.PHASES], phase) == "pivotal")
    by_phase = _pick([p[3] for p in T.PHASES], phase)
    late = by_phase.isin("phase_3_readout", "phase_2_readout")
    ended = F.col("r.endpoint")
    readout = (
        F.when(~ended, F.when(late, by_phase).otherwise("endpoint_failure"))
        .when(F.coalesce(pivotal, F.lit(False)), "pivotal_trial_readout")
        .otherwise(F.coalesce(by_phase, F.lit("endpoint_success")))
    )
    sure = F.greatest(F.coalesce(_pick([p[2] for p in T.PHASES], phase, "double"), F.lit(0.0)), F.when(ended.isNull(), 0.82).otherwise(0.86))
    readout_confidence = F.when(readout == "endpoint_failure", 0.92).when(readout == "endpoint_success", 0.84).when(readout == "phase_1_readout", _pick([p[2] for p in T.PHASES], phase, "double")).otherwise(sure)
    votes = [first_value(f[1], F.col("a.segment")).cast("int") for f in T.FACTS if f[0] in ("votes_for", "votes_against")]
    early = _pick([r[0] for r in T.BEFORE_READOUTS], F.col("a.before"))
    early = F.when(early == "committee_vote", F.when(votes[0] > votes[1], "fda_advisory_committee_positive").otherwise("fda_advisory_committee_negative")).otherwise(early)
    late_label = _pick([r[0] for r in T.AFTER_READOUTS], F.col("b.after"))
    by = lambda a, r, b, none: F.when(F.col("t") == "a", a).when(F.col("t") == "r", r).when(F.col("t") == "b", b).otherwise(none)
    out = docs_rows.select(
        "doc_id",
        by(early, readout, late_label, F.lit("unknown")).alias("event_type"),
        by(_pick([r[2] for r in T.BEFORE_READOUTS], F.col("a.before"), "double"), readout_confidence, _pick([r[2] for r in T.AFTER_READOUTS], F.col("b.after"), "double"), F.lit(0.3)).alias("confidence"),
        *[by(F.col(f"a.{c}"), F.col(f"r.{c}"), F.col(f"b.{c}"), F.col(f"m.{c}")).alias(n) for c, n in (("segment", "evidence_text"), ("section", "section"), ("start_char", "start_char"), ("end_char", "end_char"))],
        F.col("doc_endpoint").alias("endpoint_met"),
        F.array_distinct(F.flatten("told")).alias("told"),
        ((F.col("t") == "r") & ended.isNull()).alias("unclear"),
        ((F.col("t") == "a") & F.col("a.low").contains("clinical hold")).alias("held"),
    )
    return _derived(out)


def _derived(events: DataFrame) -> DataFrame:
    """What follows from an event and the endpoint: action, binary, direction, materiality, flags."""
    kind, ended = F.col("event_type"), F.col("endpoint_met")
    readout, designation, approval = kind.isin(*T.READOUTS), kind.isin(*T.DESIGNATIONS), kind.isin(*T.APPROVALS)
    failed = F.coalesce(~ended, F.lit(False))
    success = (kind == "endpoint_success") | F.coalesce(ended & readout, F.lit(False))
    binary = approval | kind.isin(*T.NEGATIVE, "fda_advisory_committee_positive", "endpoint_success") | (kind.isin("phase_1_readout", "phase_2_readout", "phase_3_readout", "pivotal_trial_readout") & ended.isNotNull())
    direction = F.when(kind.isin(*T.NEGATIVE) | failed, "negative").when(approval | (kind == "fda_advisory_committee_positive") | success | designation, "positive").when(readout, "mixed").otherwise("unknown")
    materiality = (
        F.when(kind.isin("fda_complete_response_letter", "phase_3_readout", "pivotal_trial_readout", "trial_halt", "trial_discontinuation", "endpoint_failure"), "high")
        .when(approval | kind.isin("fda_advisory_committee_positive", "fda_advisory_committee_negative", "phase_2_readout", "safety_signal", "endpoint_success"), "medium")
        .when(designation | (kind == "phase_1_readout"), "low")
        .otherwise("unknown")
    )
    action = F.lit(None).cast("string")
    for event, name in T.ACTIONS.items():
        action = F.when(kind == event, name).otherwise(action)
    more = F.array_compact(F.array(F.when(F.col("unclear"), "endpoint_direction_unclear"), F.when(F.col("held"), "safety_review_required"), F.when(kind == "safety_signal", "safety_issue_present"), F.when(designation, "designation_only_weaker_signal")))
    return events.select(
        "doc_id", "event_type", "confidence", "evidence_text", "section", "start_char", "end_char", "endpoint_met", action.alias("fda_action"), binary.alias("binary_catalyst"), direction.alias("direction"), materiality.alias("materiality"),
        F.array_join(F.array_sort(F.array_union("told", more)), ";").alias("quality_flags"),
    )


def trial_facts(docs: DataFrame) -> DataFrame:
    """The facts that trial news states, each from the first segment that states it: doc_id, fact_name, value, number, unit, confidence, section, span, evidence_text.

    Percents become fractions. A first safety passage that says there was nothing is no fact.
    """
    rows = sectioned(docs).withColumn("low", F.lower("segment"))
    text, low = F.col("segment"), F.col("low")
    fact = lambda name, value, unit, confidence: F.when(value.isNotNull(), F.struct(F.lit(name).alias("fact_name"), value.alias("value"), F.lit(unit).alias("unit"), confidence.alias("confidence")))
    found = []
    for name, patterns, need, unit, confidence in T.FACTS:
        value = first_value(patterns, text, T.NOT_NAMES if name in ("trial_name", "drug_asset") else ())
        sure = F.lit(confidence)
        if name == "nct_id":
            value = F.upper(value)
        elif name == "primary_endpoint":
            cleaned = F.expr(r"trim(BOTH ' ,' FROM regexp_replace(_v, '(?i)\\b(was|were)\\s+(met|not met|achieved).*$', ''))".replace("_v", "_endpoint"))
            rows = rows.withColumn("_endpoint", F.coalesce(value, F.lit("")))
            sure = F.when(cleaned != "", confidence).otherwise(0.66)
            value = F.when(low.contains("primary endpoint"), F.substring(F.coalesce(F.nullif(cleaned, F.lit("")), text), 1, 220))
        elif name == "indication":
            value = F.expr(r"trim(BOTH ' ,' FROM regexp_replace(_v, '(?i)\\s+(and|with) (announced|reported|met|failed).*$', ''))".replace("_v", "_indication"))
            rows = rows.withColumn("_indication", first_value(patterns, text))
            value = F.when(F.length(value).between(3, 140), value)
        elif name == "sole_asset":
            value = F.when(value.isNotNull(), "1")
        for part in (need or "").split("&"):
            value = F.when(low.rlike(part), value) if part else value
        found.append(fact(name, value, unit, sure))
    phase = F.lit(None).cast("int")
    for i, (_, pattern, _, _) in reversed(list(enumerate(T.PHASES))):
        phase = F.when(low.rlike(pattern), i).otherwise(phase)
    endpoint = F.when(low.rlike(T.MISSED), "false").when(low.rlike(T.MET), "true")
    safety = F.when(low.rlike("safety signal|serious adverse|patient death|toxicity|dose-limiting|clinical hold|boxed warning"), F.when(low.rlike(T.HARMLESS), "false").otherwise("true"))
    found += [
        fact("trial_phase", _pick([p[0] for p in T.PHASES], phase), "category", _pick([p[2] for p in T.PHASES], phase, "double")),
        fact("endpoint_met", endpoint, "boolean", F.lit(0.92)),
        fact("safety_issue", safety, "boolean", F.lit(0.82)),
    ]
    exploded = rows.withColumn("f", F.explode_outer(F.array_compact(F.array(*found)))).where("f is not null").select("doc_id", "start_char", "end_char", "section", "segment", "f.*")
    first = exploded.groupBy("doc_id", "fact_name").agg(F.min(F.struct("start_char", "end_char", "section", "segment", "value", "unit", "confidence")).alias("x"))
    number = F.expr("try_cast(x.value AS double)")
    return first.select(
        "doc_id", "fact_name", F.col("x.value").alias("value"), F.when(F.col("x.unit") == "percent", number / 100).when(F.col("x.unit").isin("number", "ratio", "count"), number).alias("number"),
        F.when(F.col("x.unit") == "percent", "proportion").otherwise(F.col("x.unit")).alias("unit"), F.col("x.confidence").alias("confidence"), F.col("x.section").alias("section"), F.col("x.start_char").alias("start_char"), F.col("x.end_char").alias("end_char"), F.col("x.segment").alias("evidence_text"),
    ).where("NOT (fact_name = 'safety_issue' AND value = 'false')")
