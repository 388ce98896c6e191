import pytest

from afterbell.operators.sections import sectioned, trial_events, trial_facts

RELEASES = {
    "track": "XYZ announced that the FDA granted Fast Track designation to ABC-123 for the treatment of pulmonary arterial hypertension.",
    "topline": "XYZ reported topline results from the Phase 3 PIVOTAL trial of ABC-123 in patients with relapsed lymphoma. The trial met its primary endpoint of progression-free survival with p=0.004 and hazard ratio 0.62. "
    "No new safety signals were observed. ClinicalTrials.gov identifier NCT01234567.",
    "letter": "XYZ received a Complete Response Letter from the FDA for ABC-123 for the treatment of lymphoma.",
    "hold": "The FDA placed a clinical hold on the Phase 2 trial of XYZ-789 after serious adverse events were observed.",
    "enrolled": "XYZ completed enrollment in its Phase 3 study of ABC-123 and will present the trial design at the annual meeting. No efficacy or safety results were announced.",
    "pathway": "FDA granted RMAT designation to ABC-123. Similar to Breakthrough Therapy designation, RMAT provides opportunities to discuss ways to support accelerated approval, and potential priority review.",
    "about": "XYZ appoints a new director.\nAbout XYZ Therapeutics\nXYZ is developing oncology candidates. ABC-123 is currently being evaluated in a Phase 2 clinical trial for lymphoma. Forward-Looking Statements\n"
    "Actual results could differ materially and negative results may be observed in clinical trials.",
    "before": "XYZ reports quarterly business updates.\nSummary of Business Highlights\nPipeline: In September, we announced that our Phase 2 SYCAMORE clinical trial of ABC-123 met its primary endpoint of safety. We plan to present the Phase 2 data at a medical conference.",
    "now": "XYZ announced topline results from its Phase 2 trial of ABC-123 in lymphoma. The study met its primary endpoint of objective response rate with p=0.01. The objective response rate was 42.5% and overall survival was 14.2 months.",
    "vote": "The advisory committee voted 9 to 3 in support of the candidate, the company announced.\nPDUFA target date of March 4, 2025 was set.",
    "missed": "XYZ announced that the study did not meet its primary endpoint.",
    "nothing": "",
    "null": None,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(RELEASES.items()), "doc_id string, text string")


@pytest.fixture(scope="module")
def events(docs):
    return {r.doc_id: r for r in trial_events(docs).collect()}


@pytest.mark.parametrize(
    ("doc", "event", "direction", "flag"),
    [
        ("track", "fast_track_designation", "positive", "designation_only_weaker_signal"),
        ("topline", "pivotal_trial_readout", "positive", "endpoint_direction_unclear"),
        ("letter", "fda_complete_response_letter", "negative", ""),
        ("hold", "trial_halt", "negative", "safety_review_required"),
        ("enrolled", "unknown", "unknown", "enrollment_update_not_binary;publication_or_conference_notice_not_topline"),
        ("pathway", "unknown", "unknown", "background_approval_language_not_decision"),
        ("about", "unknown", "unknown", "boilerplate_or_risk_factor_not_event"),
        ("before", "unknown", "unknown", "previously_announced_not_new"),
        ("now", "phase_2_readout", "positive", ""),
        ("vote", "fda_advisory_committee_positive", "positive", ""),
        ("missed", "endpoint_failure", "negative", ""),
    ],
)
def test_events_by_section(events, doc, event, direction, flag):
    got = events[doc]
    assert got.event_type == event and all(f in got.quality_flags for f in flag.split(";"))
    assert got.direction == direction
    assert got.binary_catalyst == (event not in ("unknown", "fast_track_designation"))


def test_empty_texts_have_no_rows(events):
    assert "nothing" not in events and "null" not in events and events["track"].fda_action == "fast_track_designation"


def test_spans_are_the_text(docs):
    rows = sectioned(docs).collect()
    assert len(rows) > 20
    for r in rows:
        assert " ".join(RELEASES[r.doc_id][r.start_char : r.end_char].split()) == r.segment
    sections = {(r.doc_id, r.section) for r in rows}
    assert {("topline", "headline"), ("about", "risk_factor"), ("before", "pipeline_table")} <= sections


def test_facts_have_values_spans_and_sections(docs):
    facts = {(r.doc_id, r.fact_name): r for r in trial_facts(docs).collect()}
    value = lambda doc, name: (f := facts.get((doc, name))) and (f.number if f.number is not None else f.value)
    assert value("topline", "hazard_ratio") == 0.62 and value("topline", "p_value") == 0.004 and value("topline", "nct_id") == "NCT01234567"
    assert value("topline", "endpoint_met") == "true" and value("topline", "trial_phase") == "phase_3" and value("topline", "drug_asset") == "ABC-123" and value("topline", "indication") == "relapsed lymphoma"
    assert value("topline", "primary_endpoint").startswith("progression-free survival") and ("topline", "safety_issue") not in facts and value("topline", "trial_name") == "PIVOTAL"
    assert value("now", "response_rate") == 0.425 and value("now", "overall_survival") == "14.2 months" and facts["now", "response_rate"].unit == "proportion"
    assert (value("vote", "votes_for"), value("vote", "votes_against"), value("vote", "decision_date")) == (9.0, 3.0, "March 4, 2025")
    assert value("hold", "safety_issue") == "true" and value("missed", "endpoint_met") == "false"
    for f in facts.values():
        assert " ".join(RELEASES[f.doc_id][f.start_char : f.end_char].split()) == f.evidence_text and f.section


def test_sections_of_very_many_lines(spark):
    text = "\n".join(["A headline of some length", "About the company"] + ["It makes things of many kinds. " * 3] * 20_000)
    rows = sectioned(spark.createDataFrame([("a", text)], "doc_id string, text string")).groupBy("section").count().collect()
    assert {r.section: r["count"] for r in rows} == {"headline": 1, "boilerplate": 60_000}
