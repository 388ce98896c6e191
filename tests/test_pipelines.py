from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from afterbell.operators import projections as P
from afterbell.operators.evidence import Rule
from afterbell.operators.pipelines import RulePack, evidence_pipeline, study_pipeline
from afterbell.operators.windows import sparse_returns


def test_evidence_pipeline(spark):
    docs = spark.createDataFrame(
        [(1, "e1", "The firm had a breach on Monday. Systems were down."), (2, "e1", "No breach here, not a breach."), (3, "e2", "Nothing to see."), (4, "e3", "Customer data was stolen.")], "doc_id int, event_id string, text string"
    )
    pack = RulePack("incidents", (Rule("breach", "breach", confidence=0.9, reject="[Nn]o "), Rule("data", "(?i)customer data", confidence=0.6)))
    claim = {r.field_name: r.claim_id for r in evidence_pipeline(docs, pack)["claims"].collect()}
    reviews = spark.createDataFrame([(claim["data"], "human_verified"), (claim["breach"], " ")], "claim_id string, review_status string")
    out = evidence_pipeline(docs, pack, reviews)
    rows = {r.event_id: r for r in out["events"].collect()}
    assert (rows["e1"].breach, rows["e1"].data, rows["e1"].review_status) == (True, False, "reviewed")
    assert rows["e2"].review_status == "no_claims" and rows["e3"].data
    assert out["quality"].first().verified == 1


def test_study_pipeline_with_controls(spark):
    r = np.random.default_rng(1)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(400)]
    bars = spark.createDataFrame([(t, d, float(p)) for t in "ABC" for d, p in zip(days, 50 * np.exp(np.cumsum(r.normal(0, 0.02, 400))), strict=True)], "ticker string, d date, price double")
    bench = spark.createDataFrame([(d, float(x)) for d, x in zip(days, r.normal(0, 0.01, 400), strict=True)], "d date, log_ret double")
    events = spark.createDataFrame([(i, "ABC"[i % 3], datetime(2020, 1, 1) + timedelta(days=160 + 17 * i), "t", "unknown") for i in range(12)], "event_id int, ticker string, event_time timestamp, event_type string, release_session string")
    out = study_pipeline(events, sparse_returns(bars), bench, bars)
    assert out["study"].where("status = 'ok'").count() == 12 and out["base_rates"].first().n == 12
    kinds = {k.control: k.n for k in out["controls"].groupBy("control").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"placebo": 12, "peer_control": 12}
    verdict = P.compare_controls(out["study"], out["controls"], "car_3", 5).collect()
    assert {v.control for v in verdict} == {"placebo", "peer_control"}


def test_aliases_and_repeated_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("x", "x", "consensus")
    out = P.rename_aliases(df, {"consensus": "eps_consensus", "x": "consensus"})
    assert out.columns == ["x", "consensus", "eps_consensus"] and out.first() == (1, 3, 3)
