import numpy as np
import pytest
from pyspark.sql import functions as F

from afterbell.functions import domains as DO
from afterbell.functions.taxonomies import first_label
from afterbell.operators import audits as A
from afterbell.operators import backtest as B
from afterbell.operators import evidence as E
from afterbell.operators import packs as PK
from afterbell.operators import similarity as S


def texts(spark, *found):
    return spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")


def test_press_claims_keep_their_guards(spark):
    d = texts(
        spark,
        "We had a cybersecurity incident. Customer data was accessed. A vendor platform was compromised.",
        "After a security incident there is no evidence that customer data was accessed.",
        "Ransomware hit us. Forensic experts of our vendor help.",
        "A quiet quarter with customer data.",
        None,
    )
    found = PK.detect(d, PK.PRESS_PACK)
    assert {r.doc_id: r.confidence for r in found.collect()} == {0: 0.78, 1: 0.78, 2: 0.78}
    claims = {(r.source_doc_id, r.field_name) for r in PK.extract(d, found, PK.PRESS_PACK).collect()}
    assert {(0, "customer_data_exposure_mentioned"), (0, "third_party_vendor_mentioned"), (2, "ransomware_mentioned")} <= claims
    assert (1, "customer_data_exposure_mentioned") not in claims and not any(d == 3 for d, _ in claims)
    secondary = PK.detect(d.withColumn("source_role", F.lit("secondary")), PK.PRESS_PACK).first()
    assert secondary.confidence == pytest.approx(0.62)


def test_incident_claims(spark):
    d = texts(
        spark,
        "Item 1.05 Material cybersecurity incident. It is not reasonably likely to have a material impact.",
        "A data breach exposed employee personal information. Encrypted systems offline.",
        "Item 1.05 The data breach exposed personal information of employees and customers.",
    )
    claims = {(r.source_doc_id, r.field_name) for r in PK.extract(d, PK.detect(d, PK.INCIDENT_PACK), PK.INCIDENT_PACK).collect()}
    assert (0, "item_105_flag") in claims and (0, "no_material_impact_language") in claims and (0, "reasonably_likely_material_impact_language") not in claims
    assert (1, "customer_data_exposure_mentioned") not in claims and (2, "customer_data_exposure_mentioned") in claims
    assert {(1, "ransomware_mentioned"), (1, "operational_disruption_mentioned")} <= claims


def test_labels_and_flags_of_nothing(spark):
    rows = texts(spark, None, "", "The CRL came.").select(
        first_label(F.col("text"), DO.TRIAL_EVENTS, "other")["label"].alias("a"), DO.flags(F.col("text"), DO.TRIAL_FLAGS).alias("b"), DO.size_bucket(F.lit(None).cast("double"), "five").alias("c"), DO.size_bucket(F.lit(3e8), "four").alias("d")
    )
    assert [tuple(r) for r in rows.collect()] == [("other", [], "unknown", "small_300m_2b")] * 2 + [("fda_complete_response_letter", [], "unknown", "small_300m_2b")]


def test_amounts_of_texts(spark):
    row = texts(spark, "up 5%, down (2.5)% and -1 percent; EPS of $1.20 against $(0.30)").select(E.percents(F.col("text")).alias("p"), E.per_share(F.col("text")).alias("e")).first()
    assert row.p == pytest.approx([0.05, -0.025, -0.01]) and row.e == pytest.approx([1.2, -0.3])


def test_blank_duplicate_keys_make_no_groups(spark):
    columns = "event_id long, ticker string, discovered string, determined string, source_url string, t long"
    rows = [(1, None, None, "", None, 5), (2, "", None, None, None, 4), (3, "A", None, None, "U", 3), (4, "a", "", None, "u", 2), (5, "A", None, None, "U", 1)]
    out = {r.event_id: r for r in A.domain_duplicates(spark.createDataFrame(rows, columns), "incident", ["t", "event_id"], excluded=F.col("event_id") == 5).collect()}
    assert [out[i].duplicate_status for i in (1, 2, 3, 4, 5)] == ["clear", "clear", "duplicate", "duplicate", "primary"]
    assert out[3].canonical_event_id == 5 and not out[5].counts_once and out[1].counts_once


def test_features_without_all_columns(spark):
    rows = [(1, "A", None, "x", 7.0), (2, "B", None, " ", None)]
    e = spark.createDataFrame(rows, "event_id long, ticker string, event_time timestamp, release_session string, award_amount double")
    assert [(r.event_type, r.event_subtype, r.amount, r.release_session) for r in A.features_to_events(e, "contract").orderBy("event_id").collect()] == [("government_contract", None, 7.0, "x"), ("government_contract", None, None, "unknown")]
    assert A.usable(e.withColumn("review_status", F.lit("accepted"))).count() == 0


def test_analogs_with_categories_match_one_hot_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, float(a) if i % 7 else None, float(b), str(c) if i % 5 else None) for i, (a, b, c) in enumerate(zip(r.normal(size=60), r.normal(size=60), r.integers(0, 4, 60), strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string")
    x = np.array([[np.nan if v is None else v for v in row[1:3]] for row in rows])
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    levels = ["unknown", "0", "1", "2", "3"]
    v = np.hstack([x, [[float((row[3] or "unknown") == level) for level in levels] for row in rows]])
    cosine = (v @ v.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    for block in (2_000, 4):
        got = {(o.probe, o.id): o.similarity for o in S.analogs(df, "id", ["a", "b"], df.where("id < 12"), 5, ["c"], block).collect()}
        assert len(got) == 60
        for (p, i), s in got.items():
            assert s == pytest.approx(cosine[p, i]) and i != p
        for p in range(12):
            best = sorted((-round(cosine[p, i], 9), i) for i in range(60) if i != p)[:5]
            assert {i for q, i in got if q == p} == {i for _, i in best}


def test_patterns_that_names_hold(spark):
    names = spark.createDataFrame([("steel works",), ("nothing",), (None,)], "name string")
    patterns = spark.createDataFrame([(f"x{i}", "X", 0.9, i) for i in range(40)] + [("steel", "S", 0.8, 1), ("work", "W", 0.8, 2), (" ", "B", 0.9, 3)], "pattern string, ticker string, confidence double, place int")
    assert {r.name: (r.ticker, r.hits) for r in S.best_substring(names, patterns).collect()} == {"steel works": ("S", 2), "nothing": (None, 0), None: (None, 0)}


def walk_by_hand(rows, purge=5, least=10):
    """Each row's probability from plain gradient descent on the rows more than ``purge`` days before it."""
    out = {}
    for day, row_id, x, c, y in rows:
        before = [r for r in rows if r[0] < day]
        train = [r for r in rows if r[0] < day - purge]
        base = np.mean([r[4] for r in before]) if before else None
        if len(train) < least or len({r[4] for r in train}) < 2:
            out[row_id] = base if not before else np.mean([r[4] for r in sorted(rows) if r[0] < day])
            continue
        v = np.array([r[2] for r in train], float)
        middle = np.nanmedian(v)
        v = np.where(np.isnan(v), middle, v)
        mean, std = v.mean(), v.std()
        levels = sorted({r[3] or "unknown" for r in train})
        row = lambda a, b: [(middle if np.isnan(a) else a) / std - mean / std, *[float((b or "unknown") == k) for k in levels], 1.0]
        m, t = np.array([row(r[2], r[3]) for r in train]), np.array([r[4] for r in train])
        weight = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (1 - t).sum()))
        w = np.zeros(m.shape[1])
        for _ in range(6000):
            w -= 0.02 * (m.T @ (weight * (1 / (1 + np.exp(-m @ w)) - t)) + w)
        out[row_id] = 1 / (1 + np.exp(-np.array(row(x, c)) @ w))
    return out


def test_walk_forward_against_a_plain_version(spark):
    r = np.random.default_rng(9)
    rows = [(int(d), i, float("nan") if i % 9 == 0 else float(r.normal()), None if i % 6 == 0 else "ab"[i % 2], float(r.integers(0, 2))) for i, d in enumerate(np.sort(r.integers(0, 40, 60)))]
    df = spark.createDataFrame([("k", d, i, None if np.isnan(x) else x, c, y) for d, i, x, c, y in rows], "key string, d int, id long, x double, c string, y double")
    df = df.withColumn("at", F.expr("timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, d)"))
    want = walk_by_hand(rows)
    got = {o.id: o.probability for o in B.purged_walk_forward(df, "key", "at", "id", ["x"], "y", least_train=10, categorical=["c"]).collect()}
    assert len(got) == 60
    for i, p in got.items():
        assert (p is None and want[i] is None) or p == pytest.approx(want[i], abs=2e-3)
    mean = lambda x, y: lambda z: np.full(len(z), y.mean())
    other = B.purged_walk_forward(df, "key", "at", "id", ["x"], "y", least_train=10, fit=mean)
    assert {o.status for o in other.collect()} >= {"ok", "skipped_not_enough_train"}


def test_fields_of_trial_texts(spark):
    from afterbell.operators import parsers as PA

    d = texts(spark, "ABC-101 for the treatment of rare disease and met its primary endpoint in NCT01234567.", "Nothing.", None)
    out = {r.doc_id: r for r in PA.parse_documents(d, "trial").collect()}
    assert (out[0].asset, out[0].indication, out[0].endpoint_met, out[0].trial_id) == ("ABC-101", "rare disease", True, "NCT01234567")
    assert (out[1].asset, out[1].indication, out[1].event_type) == (None, None, "other") and out[2].percents == []
    assert PA.parse_documents(d, "distress", "text").count() == 3


def test_accounting_events_by_how_their_news_is_digested(spark):
    from afterbell.functions.taxonomies import accounting_survivability

    rows = [("routine_auditor_change", "low", "after_close", True, None, None, None), ("routine_auditor_change", "high", "after_close", True, None, None, None), ("x", None, "intraday", True, None, None, None), ("reportable_event", None, None, None, None, True, None), ("other", None, "intraday", None, None, None, True), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d boolean, e boolean, f boolean, g boolean")
    found = [r.x for r in df.select(accounting_survivability(*[F.col(c) for c in "abcdefg"]).alias("x")).collect()]
    assert found == ["explanation-only", "immediate-gap", "delayed-digestion", "slow-burn repricing", "explanation-only", "pre-event setup"]
