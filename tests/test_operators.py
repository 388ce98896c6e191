from datetime import date, datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from afterbell.functions import calendar as C
from afterbell.functions import exprs as X
from afterbell.functions import taxonomies as T
from afterbell.operators import backtest as B
from afterbell.operators import discovery as D
from afterbell.operators import evidence as E
from afterbell.operators import expectations as P
from afterbell.operators import facts as FA
from afterbell.operators import review as R
from afterbell.operators import study as S
from afterbell.operators import windows as W
from afterbell.operators.asof import asof_backward, asof_forward


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_expressions(spark):
    df = spark.createDataFrame([("$1,234",), ("12%",), ("-3.5",), ("n/a",), ("",), (None,)], "s string")
    assert values(df, X.clean_number(F.col("s"))) == [1234.0, 0.12, -3.5, None, None, None]
    assert values(df, X.blank_to_null(F.lit(" NaN "))) == [None] * 6
    one = spark.range(1)
    assert values(one, X.safe_pct_delta(F.lit(3.0), F.lit(-2.0))) == [2.5]
    assert values(one, X.safe_pct_delta(F.lit(3.0), F.lit(0.0))) == [None]
    assert values(one, X.horizontal_mean([F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0)])) == [2.0]
    for z, p in ((0.0, 0.5), (1.96, 0.9750021), (-1.0, 0.1586553)):
        assert values(one, X.normal_cdf(F.lit(z)))[0] == pytest.approx(p, abs=2e-7)
    with pytest.raises(Exception, match="outside"):
        values(one, X.unit_interval(F.lit(1.5), "score"))
    assert values(one, X.safe_id(F.lit("a b/c?d"))) == ["a_b_c_d"]


def test_calendar(spark):
    assert C.market_holidays(2024) == [date(2024, *d) for d in ((1, 1), (1, 15), (2, 19), (3, 29), (5, 27), (6, 19), (7, 4), (9, 2), (11, 28), (12, 25))]
    rows = {r.day: r for r in C.calendar(spark, 2024, 2024).collect()}
    assert len(rows) == 366
    assert rows[date(2024, 3, 29)].same_or_next == date(2024, 4, 1) and rows[date(2024, 3, 28)].next_day == date(2024, 4, 1)
    assert rows[date(2024, 7, 4)].previous_day == date(2024, 7, 3)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9)), max_size=15), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9), st.booleans()), min_size=1, max_size=10))
def test_asof_joins_against_a_loop(spark, facts, probes):
    f = spark.createDataFrame([(k, t) for k, t in set(facts)], "k int, at int")
    p = spark.createDataFrame([(i, k, t, s) for i, (k, t, s) in enumerate(probes)], "i int, k int, t int, strict boolean")
    f = f.withColumn("found", F.col("at"))
    ahead = {r.i: r.found for r in asof_forward(p, f, ["k"], F.col("t"), F.col("at"), ["found"], strict=F.col("strict")).collect()}
    behind = {r.i: r.found for r in asof_backward(p, f, ["k"], F.col("t"), F.col("at"), ["found"], strict=F.col("strict")).collect()}
    for i, (k, t, s) in enumerate(probes):
        own = [a for q, a in facts if q == k]
        assert ahead[i] == min((a for a in own if a > t or (a == t and not s)), default=None)
        assert behind[i] == max((a for a in own if a < t or (a == t and not s)), default=None)


def test_market_model_against_least_squares(spark):
    r = np.random.default_rng(2)
    x, y = r.normal(0, 0.01, 300), r.normal(0, 0.02, 300)
    y[40:60] = np.nan
    rows = [("T", date.fromordinal(737000 + i), None if np.isnan(y[i]) else float(y[i]), float(x[i])) for i in range(300)]
    out = W.market_model(spark.createDataFrame(rows, "ticker string, d date, y double, x double")).orderBy("d").collect()
    for i in (0, 64, 65, 100, 125, 126, 200, 299):
        a, b = max(0, i - 125), max(0, i - 5)
        ok = ~np.isnan(y[a:b])
        assert out[i].est_n == ok.sum()
        if ok.sum() < 60:
            assert out[i].beta is None and out[i].resid_vol is None
            continue
        beta, alpha = np.polyfit(x[a:b][ok], y[a:b][ok], 1)
        residual = y[a:b][ok] - alpha - beta * x[a:b][ok]
        assert (out[i].beta, out[i].alpha) == pytest.approx((beta, alpha), rel=1e-6, abs=1e-9)
        assert out[i].resid_vol == pytest.approx(np.sqrt((residual**2).sum() / (ok.sum() - 2)), rel=1e-6)


def test_event_study_skips_are_rows(spark):
    days = [date.fromordinal(737000 + i) for i in range(200)]
    r = np.random.default_rng(3)
    returns = spark.createDataFrame([(t, d, float(r.normal())) for t in "AB" for d in days], "ticker string, d date, log_ret double")
    bench = spark.createDataFrame([(d, float(r.normal())) for d in days], "d date, log_ret double")
    at = lambda i: datetime.combine(days[i], datetime.min.time())
    events = [(1, "A", at(150), "before_open"), (2, "A", at(150), "after_close"), (3, "A", at(20), "unknown"), (4, "Z", at(150), "unknown"), (5, "B", at(199), "after_close"), (6, "B", at(195), "intraday")]
    out = {e.event_id: e for e in S.event_study(spark.createDataFrame(events, "event_id int, ticker string, event_time timestamp, release_session string"), S.market_rows(returns, bench)).collect()}
    assert [out[i].status for i in range(1, 7)] == ["ok", "ok", "not_enough_history", "ticker_not_found", "no_trading_day", "ok"]
    assert out[1].reaction_start == days[150] and out[2].reaction_start == days[151]
    assert out[6].car_3 is not None and out[6].car_10 is None and out[6].direction_10 == "unknown" and not out[6].significant_10


def test_robust_statistics(spark):
    x = [0.5, -0.1, 0.2, 0.05, -0.3, 0.9, 0.01]
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(x)], "i int, g string, v double")
    lo, hi = np.quantile(x, [0.05, 0.95])
    assert S.winsorised_mean(df, "v", ["g"]).first().winsorised_mean == pytest.approx(np.clip(x, lo, hi).mean())
    loo = [(sum(x) - v) / 6 for v in x]
    row = S.leave_one_out_range(df, "v", ["g"]).first()
    assert (row.least_mean, row.largest_mean) == pytest.approx((min(loo), max(loo)))
    top = S.top_k_exclusion(df, "v", ["g"], "i").first()
    assert top.mean_without_1 == pytest.approx((sum(x) - 0.9) / 6) and top.share_top_1 == pytest.approx(0.9 / sum(map(abs, x)))


def test_calibration_and_auc(spark):
    preds = [(0.0, 0), (0.1, 1), (0.1000001, 0), (0.55, 1), (1.0, 1), (1.2, 1), (None, 1)]
    df = spark.createDataFrame(preds, "p double, y int")
    bins = {r.bin: r for r in B.calibration(df, "p", "y").collect()}
    assert len(bins) == 10 and bins[1].n == 2 and bins[2].n == 1 and bins[10].n == 2 and bins[5].n == 0 and bins[5].mean_p is None
    r = np.random.default_rng(1)
    p, y = np.round(r.random(300), 2), r.integers(0, 2, 300)
    df = spark.createDataFrame([("a", float(a), int(b)) for a, b in zip(p, y, strict=True)], "g string, p double, y int")
    want = np.mean([(1.0 if a > b else 0.5 if a == b else 0.0) for a in p[y == 1] for b in p[y == 0]])
    assert B.classification_metrics(df, "p", "y", ["g"]).first().roc_auc == pytest.approx(want)


def test_nested_thresholds_use_only_rows_before(spark):
    r = np.random.default_rng(4)
    n = 80
    p, g = np.round(r.random(n), 3), np.round(r.normal(0, 0.05, n), 6)
    df = spark.createDataFrame([("k", i, float(p[i]), float(np.log1p(g[i]))) for i in range(n)], "k string, i int, p double, ret double")
    out = {o.i: o for o in B.nested_thresholds(df, "p", "ret", ["k"], ["i"]).collect()}
    for i in (0, 29, 30, 45, 79):
        best = None
        for t in (0.5, 0.55, 0.6, 0.65, 0.7):
            side = np.where(p[:i] >= t, 1, np.where(p[:i] <= 1 - t, -1, 0))
            net = side[side != 0] * g[:i][side != 0] - 0.001
            if len(net):
                best = max(best or (-9, 0, 0), (round(float(net.mean()), 12), len(net), -t))
        assert out[i].threshold == pytest.approx(0.6 if i < 30 else -best[2])


def test_walk_forward_and_null_shuffle(spark):
    r = np.random.default_rng(5)
    n = 160
    x = r.normal(size=n)
    rows = [("k", datetime.fromordinal(737000 + i), i, float(x[i]), float(x[i] + 0.5 * r.normal() > 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, at timestamp, i int, x double, y double")
    out = sorted(B.purged_walk_forward(df, "k", "at", "i", ["x"], "y").collect(), key=lambda o: o.i)
    assert len(out) == n and out[30].status == "skipped_not_enough_train" and out[60].train_n == 55
    late = [o for o in out if o.status == "ok"]
    assert np.mean([(o.probability >= 0.5) == (o.target == 1) for o in late]) > 0.75
    preds = spark.createDataFrame([("k", i, 0.9 if x[i] > 0 else 0.1, float(np.sign(x[i]) * 0.02)) for i in range(n)], "k string, i int, p double, ret double")
    assert B.null_shuffle(preds, "p", "ret", "i", ["k"], iterations=50).first().p_value == pytest.approx(1 / 51)


def test_rules_and_offsets(spark):
    text = "First line here.\nThe firm paid $1.2 million to $3 billion é. It did not say why! End"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    seg = [(s.start_char, s.end_char, s.segment) for s in E.segments(docs).collect()]
    assert [text[a:b] for a, b, _ in seg] == [s for _, _, s in seg] and seg[1][2].endswith("billion é.")
    hits = {h.field_name: h for h in E.match_rules(docs, [E.Rule("paid", "paid"), E.Rule("said", "say", reject="not")]).collect()}
    assert set(hits) == {"paid"}
    assert text[hits["paid"].start_char : hits["paid"].end_char] == hits["paid"].evidence_text == "The firm paid $1."
    assert values(docs.where("doc_id = 1"), E.amounts(F.col("text"))) == [[1.2e6, 3e9]]
    assert values(docs.where("doc_id = 1"), E.highlight(F.lit("a<b & c"), F.lit(2), F.lit(3))) == ["a&lt;<mark>b</mark> &amp; c"]


def test_facts_gold_and_external_packets(spark):
    facts = spark.createDataFrame([("e", "revenue", "10", 0.9, "long text"), ("e", "revenue", "11", 0.9, "text"), ("e", "eps", "1", 0.5, "x"), ("f", "eps", "2", 0.8, "y")], "event_id string, fact_name string, value string, confidence double, evidence_text string")
    assert {(r.event_id, r.fact_name): r.value for r in FA.best_facts(facts).collect()}["e", "revenue"] == "11"
    wide = {r.event_id: r for r in FA.pivot_facts(facts, ["revenue", "eps"], 0.7).collect()}
    assert wide["e"].revenue == "11" and wide["e"].eps is None and wide["e"].usable_fact_count == 2
    gold = [("e", "revenue", "11.2", "usd", 0.5, True), ("e", "eps", "1", "text", None, False), ("f", "eps", "3", "usd_per_share", None, True), ("g", "eps", "3", "text", None, True)]
    got = FA.evaluate_against_gold(spark.createDataFrame(gold, "event_id string, fact_name string, expected_value string, unit string, tolerance double, expected_present boolean"), facts)
    assert sorted(r.status for r in got.collect()) == ["false_positive", "missed", "ok", "wrong_value"]
    packets = spark.createDataFrame([("d", [("eps", "1.5", "eps of 1.5"), ("eps", "x", "eps"), ("odd", "1", "eps"), ("eps", "1", "absent")]), ("u", [("eps", "1", "eps")])], "source_doc_id string, facts array<struct<fact_name:string,value:string,evidence_text:string>>")
    docs = spark.createDataFrame([("d", "The eps of 1.5 rose")], "source_doc_id string, text string")
    checked = FA.validate_external_facts(packets, docs, ["eps"])
    assert sorted(r.issue for r in checked.collect()) == ["", "missing_evidence", "not_numeric", "unknown_document", "unknown_fact"]
    with pytest.raises(ValueError, match="invalid facts"):
        FA.raise_on_issues(checked)


def test_review_keeps_human_words(spark):
    claims = spark.createDataFrame([("c1", "d", None, "v", 0.9, "human_rejected"), ("c2", "d", "s2", "v", 0.9, "x"), ("c3", "d", "s3", "v", 0.9, "x"), ("c4", "d", None, " ", 0.5, "x")], "claim_id string, source_doc_id string, evidence_span_id string, value string, confidence double, review_status string")
    spans = spark.createDataFrame([("s2", "d", "c2", "text"), ("s2", "d", "c2", "text"), (None, "d", "c4", "by null")], "evidence_span_id string, source_doc_id string, claim_id string, evidence_text string")
    got = {r.claim_id: (r.review_status, r.evidence_present, r.issue_flags) for r in R.claim_queue(claims, spans).collect()}
    assert got == {"c1": ("human_rejected", False, "missing_evidence"), "c2": ("machine_high_confidence", True, ""), "c3": ("needs_review", False, "missing_evidence"), "c4": ("needs_review", True, "low_confidence;blank_value")}


def test_leaks_stop_a_run(spark):
    e = spark.createDataFrame([(1, datetime(2024, 1, 2))], "event_id int, event_time timestamp")
    ok = spark.createDataFrame([(1, datetime(2024, 1, 2))], "event_id int, asof_time timestamp")
    assert P.raise_on_leaks(ok, e) is ok
    with pytest.raises(ValueError, match="after their event"):
        P.raise_on_leaks(spark.createDataFrame([(1, datetime(2024, 1, 3))], ok.schema), e)


def test_scores_gates_and_illiquid(spark):
    row = ("a", "t", "w", "sec", True, "clear", ["r1", "r2"], ["n1"], ["f1", "f2"], ["e"], "exact cik", "illiquid", 90, 1)
    schema = "slug string, title string, source_name string, source_kind string, official_source boolean, timestamp_quality string, delayed_digest_reasons array<string>, hard_negatives array<string>, materiality_fields array<string>, evidence array<string>, mapping_notes string, liquidity_notes string, sample_size_hint int, observed_at int"
    got = D.gate(D.score(D.candidates(spark.createDataFrame([row], schema)))).first()
    assert got.s_liquidity == 3 and got.s_mapping == 3 and got.s_official == 3 and got.total == 3 + 3 + 2 + 1 + 2 + 2 + 3 + 3 + 1 + 2 and got.gate == "feasibility_only"


def test_taxonomies(spark):
    df = spark.createDataFrame([("Senior convertible debentures",), ("Common Stock and warrants",), ("nothing",)], "s string")
    assert [r.label for r in values(df, T.first_label(F.col("s"), T.SECURITY_TYPES, "unknown"))] == ["convertible_notes", "common_stock", "unknown"]
    df = spark.createDataFrame([("Task order under IDIQ",), ("ceiling of $5 for work",), ("contract awarded",)], "s string")
    assert [r.label for r in values(df, T.first_label(F.col("s"), T.CONTRACT_EVENTS, "ambiguous"))] == ["task_order_award", "contract_ceiling_only", "new_contract_award"]
    texts = {
        "financing": (T.FINANCING_EVENTS, [("At-the-market program: shares sold", "atm_program_usage_reported"), ("ATM under which it may sell; sold", "atm_program_created"), ("Public offering of common stock priced", "completed_equity_offering"), ("public offering of ordinary shares", "announced_equity_offering")]),
        "accounting": (T.ACCOUNTING_EVENTS, [("Statements should no longer be relied upon", "non_reliance_financial_statements"), ("There were no disagreements with the accountant, who resigned", "auditor_resignation"), ("The auditor disagreed", "auditor_disagreement")]),
        "deals": (T.DEAL_EVENTS, [("The merger was terminated after the FTC sued", "regulatory_block"), ("It completed its acquisition", "acquisition_completion"), ("Agreement and Plan of Merger", "definitive_merger_agreement")]),
    }
    for rules, cases in texts.values():
        got = values(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, s string").coalesce(1).orderBy("i"), T.first_label(F.col("s"), rules, "none"))
        assert [g.label for g in got] == [want for _, want in cases]
    one = spark.range(1)
    assert values(one, T.deal_survivability(F.lit("tender_offer"), F.lit("Target"))) == ["immediate-gap"]
    assert values(one, T.deal_survivability(F.lit("tender_offer"), F.lit("acquirer"))) == ["pre-event setup"]
    assert values(one, T.distress_survivability(F.lit("delisting"), F.lit("after_close"), F.lit(2e6))) == ["immediate-gap"]
    assert values(one, T.distress_survivability(F.lit("delisting"), F.lit("after_close"), F.lit(2e5))) == ["explanation-only"]
    assert values(spark.range(1), T.survivability(F.lit("exit_amendment"), F.lit("after_close")))[0].first_entry == "next_open"


def test_forward_asof_takes_one_pass_over_a_large_key(spark):
    import time

    from afterbell.operators.asof import asof_forward
    from pyspark.sql import functions as F

    n = 200_000
    facts = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("t"), F.col("id").alias("v"))
    probes = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 3 + 1).alias("at"), F.col("id").alias("p"))
    began = time.time()
    out = asof_forward(probes, facts, ["k"], F.col("at"), F.col("t"), ["v"])
    assert out.where("v = p + 1").count() == n - 1 and out.where("v is null").count() == 1
    assert time.time() - began < 60


def test_segments_of_a_long_text_have_their_offsets(spark):
    from afterbell.operators.evidence import segments

    text = "A sentence is here. Another one!\n" * 30_000
    out = segments(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"))
    assert out.count() == 60_000
    last = out.orderBy("start_char", ascending=False).first()
    assert text[last.start_char : last.end_char] == last.segment == "Another one!"
    assert last.end_char == len(text) - 1


def test_segments_end_at_marks_that_stand_beside_no_digit(spark):
    text = "In 2024.Revenue grew; costs fell!Why? It was 2.5% of all in 2024. Next one\nlast line ;;; x"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [s.segment for s in E.segments(docs).orderBy("start_char").collect()]
    assert got == ["In 2024.Revenue grew;", "costs fell!", "It was 2.5% of all in 2024. Next one", "last line ;"]


def test_money_ranges_and_signs(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(E.amounts(F.lit("from $3 to $5 billion, then $1,442 million"))) == [3e9, 5e9, 1.442e9]
    assert tuple(one(E.stated_range(F.lit("sales of approximately $4.60 billion, plus or minus $200 million")))) == (4.4e9, 4.8e9, 4.6e9)
    assert [round(v) for v in one(E.stated_range(F.lit("revenue of $3.20 billion, +/- $100 million")))] == [3.1e9, 3.3e9, 3.2e9]
    assert [round(v) for v in one(E.stated_range(F.lit("revenue of $2 billion ± 5%")))] == [1.9e9, 2.1e9, 2e9]
    assert tuple(one(E.stated_range(F.lit("range of $6.5 billion to $6.8 billion")))) == (6.5e9, 6.8e9, 6.65e9)
    assert one(E.percents(F.lit("grew (5% in constant currency), fell (4.5)%, (3%) and -2 percent"))) == pytest.approx([0.05, -0.045, -0.03, -0.02])


@pytest.mark.parametrize("piece", ["<svg ", "<!--", "<script>", "<p ", "< ", "</style>", "<a href=", "<head><svg>"])
def test_a_megabyte_of_open_markup_takes_a_moment(spark, piece):
    import time

    df = spark.createDataFrame([(piece * (1_000_000 // len(piece)),)], "html string")
    began = time.time()
    df.select(F.length(E.visible_text(F.col("html")))).collect()
    assert time.time() - began < 15


def test_hidden_elements_end_with_their_own_tag(spark):
    one = lambda html: spark.createDataFrame([(html,)], "html string").select(E.visible_text(F.col("html")).alias("x")).first().x
    assert one("<p>a</p><script>var s = '</style>'; no()</script><p>5 < 6 and b</p><style>never closed") == "a\n5 < 6 and b"
