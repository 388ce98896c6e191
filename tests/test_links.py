from pyspark.sql import functions as F

from afterbell.operators.links import amount_token, public_links

EVENT = "event_id string, ticker string, recipient_name string, contract_number string, agency string, description string, award_amount double, obligated_amount double, pct_market_cap double, funded boolean, ceiling_only boolean, mapping_confidence double"
LINK = "event_id string, announcement_time string, source_type string, source_url string, title string, excerpt string, source_confidence double, link_confidence double"


def test_links_are_validated_and_counted_once(spark):
    award = ("KTOS", "KRATOS DEFENSE", "W911TEST", "Department of Defense", "drone command and control systems", 5e7, 5e7, 0.05, True, False, 0.95)
    events = spark.createDataFrame([("E1", *award), ("E2", *award), ("E3", "ABC", "Firm", None, None, None, None, None, None, False, True, None)], EVENT)
    text = "Kratos Defense received a $50 million Department of Defense award for drone command and control systems under contract W911TEST."
    links = spark.createDataFrame(
        [
            ("E1", "2024-01-02T08:30:00", "company_press_release", "https://example.com/a", "Kratos receives award", text, 0.95, 0.95),
            ("E2", "2024-01-03T08:30:00", "8-K", "https://example.com/b", "Again", text, 0.95, 0.9),
            ("E1", "2024-01-02T12:00:00", "usaspending_api", None, "USAspending award", text, 0.95, 0.85),
            ("E3", None, "press release", None, "Other", "nothing of it", None, 0.5),
            ("E9", "2024-01-02", "dod", "u", "Lost", text, 0.9, 0.9),
        ],
        LINK,
    )
    rows = {(r.event_id, r.source_type): r for r in public_links(events, links, True).collect()}
    one, two, third, bad, lost = (rows[k] for k in (("E1", "company_press_release"), ("E2", "8-K"), ("E1", "usaspending_api"), ("E3", "press release"), ("E9", "dod")))
    assert one.eligible and one.duplicate_status == "primary" and one.awareness_key == "KTOS:W911TEST" and one.notes == ""
    assert two.valid and two.duplicate_status == "duplicate" and not two.eligible and two.source_kind == "sec_8k"
    assert third.notes == "announcement_source_not_public_market_source;timestamp_source_type_usaspending_only" and not third.valid
    assert bad.notes.split(";")[:3] == ["missing_announcement_time", "announcement_text_does_not_mention_recipient_or_contract", "announcement_text_does_not_match_amount_agency_or_program"]
    assert {"not_actual_funded_award", "ceiling_only_event", "missing_award_or_obligated_amount", "missing_market_cap_materiality_ratio"} <= set(bad.notes.split(";"))
    assert lost.notes.startswith("event_id_not_found") and not lost.mentions
    assert {r.valid for r in public_links(events, links, False).collect()} == {False}
    assert [r.x for r in spark.createDataFrame([(5e7,), (1.25e9,), (2e6,), (0.0,), (None,), (950.0,)], "a double").select(amount_token(F.col("a")).alias("x")).collect()] == ["50", "1.3", "2", "", "", "950"]
