import json

import pytest
from pyspark.sql import functions as F

from afterbell.operators import study as S
from afterbell.operators.windows import sparse_returns
from afterbell.sources import corpora as C
from afterbell.sources import sinks as K


def test_universes(spark):
    assert C.preset(spark, "Cloud Software").count() == 14 and C.preset(spark, "semis", sectors=True).first().sector_benchmark == "SMH"
    with pytest.raises(ValueError, match="unknown universe"):
        C.preset(spark, "nothing")
    t = spark.createDataFrame([("a", "x"), ("A", " y"), ("b", "Y"), (None, "y"), (" ", None)], "ticker string, sector_benchmark string")
    assert sorted(map(tuple, C.universe_of(t).collect())) == [("A", "Y"), ("B", "Y")]
    assert C.universe_of(t.drop("sector_benchmark")).first().sector_benchmark is None
    assert C.universe_of(t.limit(0)).count() == 0


def test_earnings_rows(spark):
    rows = [("aa", "2024-02-01", "2023-12-31", "1.1", "1.0"), ("aa", "2024-05-01", "2024-03-31", "x", "1.0"), ("aa", "2024-05-01", "2024-03-31", "0.5", "1.0"), ("aa", "bad", None, "1", "1"), ("bb", "2024-03-01", None, "1", "0"), (None, "2024-03-01", None, "1", "0")]
    h = spark.createDataFrame(rows, "ticker string, reported_date string, fiscal_period_end string, actual_eps string, consensus_eps string")
    out = {r.event_id: r for r in C.earnings_rows(h, "after_close").collect()}
    assert set(out) == {"earnings_AA_20240201_20231231", "earnings_AA_20240501_20240331", "earnings_BB_20240301_unknown"}
    assert out["earnings_AA_20240201_20231231"].eps_surprise_pct == pytest.approx(0.1) and out["earnings_BB_20240301_unknown"].eps_surprise_pct is None
    assert out["earnings_AA_20240501_20240331"].actual_eps == 0.5 and str(out["earnings_AA_20240501_20240331"].event_time) == "2024-05-01 16:05:00"
    assert {r.event_id[9:11] for r in C.earnings_rows(h, last=1, end="2024-03-31").collect()} == {"AA", "BB"}


def test_earnings_filings(spark):
    rows = [("0-1", "a", "8-K", "2024-01-02 08:00:00", "2.02;9.01", ""), ("0-2", "a", "8-K/A", "2024-01-02 17:00:00", None, "Quarterly results"), ("0-3", "a", "10-Q", "2024-01-02 17:00:00", "2.02", ""), ("0-4", "a", "8-K", "2024-01-02 17:00:00", "8.01", None)]
    f = spark.createDataFrame(rows, "accession string, ticker string, form string, accepted_at string, items string, title string").withColumn("accepted_at", F.col("accepted_at").cast("timestamp"))
    assert sorted((r.event_id, r.event_subtype, r.release_session) for r in C.earnings_filings(f).collect()) == [("earnings_A_01", "results", "before_open"), ("earnings_A_02", "amended_results", "after_close")]


def test_award_rows(spark):
    one = {"Award ID": "W-1/2", "Recipient Name": "ACME, Inc", "Start Date": "2024-01-05", "Award Amount": 5.0, "Contract Award Type": "DEFINITIVE CONTRACT", "generated_internal_id": "CONT_1"}
    texts = [json.dumps(one), json.dumps(one | {"Award ID": "B", "Contract Award Type": "BPA", "Recipient Name": "Other"}), "no json", None, json.dumps({"x": 1})]
    mapping = spark.createDataFrame([("acme inc", "acm", 0.9), ("acme inc", "bad", 0.2), ("other", "oth", 0.5)], "recipient_name string, mapped_ticker string, recipient_mapping_confidence double")
    out = {r.event_id: r for r in C.award_rows(spark.createDataFrame([(t,) for t in texts], "value string"), mapping).collect()}
    assert set(out) == {"government_contract_ACM_W_1_2", "government_contract_UNMAPPED_B"}
    a, b = out["government_contract_ACM_W_1_2"], out["government_contract_UNMAPPED_B"]
    assert (a.ticker, a.obligated_amount, a.contract_ceiling, str(a.event_time)) == ("ACM", 5.0, None, "2024-01-05 12:00:00")
    assert (b.ticker, b.obligated_amount, b.contract_ceiling) == ("", None, 5.0)


def test_demo_tables_go_through_a_study_and_its_report(spark):
    bars = C.demo_bars(spark, ["AAA", "BBB", "SPY"], 260)
    assert bars.count() == 780
    assert bars.agg(F.sum("price")).first()[0] == pytest.approx(C.demo_bars(spark, ["AAA", "BBB", "SPY"], 260).repartition(3).agg(F.sum("price")).first()[0])
    events = C.demo_events(bars.where("ticker <> 'SPY'"), 10)
    returns = sparse_returns(bars)
    study = S.event_study(events, S.market_rows(returns.where("ticker <> 'SPY'"), returns.where("ticker = 'SPY'")))
    study = study.withColumn("surprise_score", F.col("actual_eps") - F.col("consensus_eps")).withColumn("surprise_bucket", F.when(F.col("surprise_score") > 0, "beat").when(F.col("surprise_score") < 0, "miss").otherwise("unknown")).cache()
    buckets = {r.surprise_bucket: r for r in K.surprise_buckets(study).collect()}
    assert set(buckets) <= {"beat", "miss"} and sum(r.n for r in buckets.values()) <= study.where("status = 'ok'").count() > 5
    assert "| surprise |" in K.study_report(study) and "| ok |" in K.study_report(study)


def test_falsification_pass_and_report(spark):
    from afterbell.operators import pipelines as PL

    bars = C.demo_bars(spark, ["AAA", "BBB", "CCC", "SPY"], 260)
    events = C.demo_events(bars.where("ticker <> 'SPY'"), 8)
    returns = sparse_returns(bars)
    parts = PL.study_pipeline(events, returns.where("ticker <> 'SPY'"), returns.where("ticker = 'SPY'"), bars.where("ticker <> 'SPY'"), least=1)
    study = parts["study"].cache()
    preds = study.where("status = 'ok' and car_1 is not null").select("event_id", "event_type", "reaction_start", F.lit(0.7).alias("p"), F.col("car_1").alias("ret"))
    out = PL.falsification_pass(study, parts["controls"], preds, iterations=20, least=5)
    gates = {r.name: r.passed for r in out["gates"].collect()}
    assert set(gates) == {"enough_events", "controls_differ", "shuffles_differ", "no_single_ticker", "survives_costs"}
    assert gates["enough_events"] and not gates["shuffles_differ"]
    text = PL.falsification_report(out)
    assert "## gates" in text and "| cost_bps |" in text.replace("event_type | ", "")


def test_digest_of_a_period(spark):
    events = spark.createDataFrame([("e1", "A", "2024-01-02 10:00:00", True), ("e2", " ", "2024-02-02 23:00:00", None), ("e3", "C", "2024-03-01 00:00:00", False)], "event_id string, ticker string, event_time string, amendment_flag boolean")
    events = events.withColumn("event_time", F.col("event_time").cast("timestamp"))
    claims = spark.createDataFrame([("e1", "ransomware_mentioned", "reviewed", "We paid."), ("e2", "ransomware_mentioned", None, "Ransom."), ("e2", "x", None, None), ("e3", "x", None, "No.")], "event_id string, field_name string, review_status string, evidence_text string")
    text = K.disclosures_digest(events, claims, "2024-01-01", "2024-02-02")
    assert "- events: 2" in text and "- companies: 1" in text and "- reviewed claims: 1" in text and "- unreviewed claims: 2" in text
    assert "**A** ransomware_mentioned: e1" in text and "No." not in text and "Ransom." in text
    assert "and 1 more" in K.disclosures_digest(events, claims, listed=1)
    assert "None in this period." in K.disclosures_digest(events.limit(0), claims)
